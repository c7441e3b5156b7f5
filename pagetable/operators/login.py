"""Does a stored page look like a login form?

Layout is unknown in stored HTML, so ``hidden``, ``disabled`` and ``type=hidden`` stand in for
invisible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.functions import markup as M
from pagetable.functions.strings import strip
from pagetable.operators.selectors import select
from pagetable.sources.nodes import dom_nodes, is_text, subtree

# User fields in order of preference.
USER_SELECTORS = (
    "input[type=email]",
    "input[autocomplete=username]",
    "input[name*=email i]", "input[id*=email i]",
    "input[name*=user i]", "input[id*=user i]",
    "input[name*=login i]", "input[id*=login i]",
    "input[type=text]",
)
# Texts that mark a button as the one to submit, and texts that rule it out.
SUBMIT_TEXTS = (
    "se connecter", "connexion", "log in", "login", "sign in", "iniciar", "entrar", "continuer",
    "continue", "next", "suivant", "submit", "s'identifier",
)
SKIP_TEXTS = (
    "forgot", "cancel", "back", "create", "register", "sign up", "s'inscrire", "phone", "google",
    "apple", "facebook", "microsoft",
)
ERROR_SELECTORS = ("[class*=error i]", "[id*=error i]", "[role=alert]")


def _visible(node: Column) -> Column:
    attrs = node["attrs"]
    return (
        (node["zone"].bitwiseAND(M.ZONE_HIDDEN) == 0)
        & attrs["disabled"].isNull()
        & (F.coalesce(F.lower(attrs["type"]), F.lit("")) != "hidden")
    )


def _any_visible(nodes: Column, selector: str) -> Column:
    return F.exists(select(nodes, selector), _visible)


def _text(nodes: Column, element: Column) -> Column:
    """Shown text below an element, blanks collapsed."""
    shown = F.filter(
        subtree(nodes, element),
        lambda n: is_text(n) & (n["zone"].bitwiseAND(M.ZONE_UNSEEN | M.ZONE_HIDDEN) == 0),
    )
    joined = F.array_join(F.transform(shown, lambda n: n["text"]), "")
    return strip(F.regexp_replace(joined, r"\s+", " "))


def _submits(button: Column, nodes: Column) -> Column:
    attrs = button["attrs"]
    kind = F.lower(attrs["type"])
    # A button without a valid type submits; an input has to say so.
    submit_type = F.when(
        button["tag"] == "button", ~F.coalesce(kind.isin("button", "reset"), F.lit(False))
    ).otherwise((button["tag"] == "input") & F.coalesce(kind == "submit", F.lit(False)))
    label = F.lower(
        F.coalesce(
            F.nullif(_text(nodes, button), F.lit("")),
            F.nullif(attrs["value"], F.lit("")),
            attrs["aria-label"],
            F.lit(""),
        )
    )
    named = F.lit(False)
    for text in SUBMIT_TEXTS:
        named = named | label.contains(text)
    skipped = F.lit(False)
    for text in SKIP_TEXTS:
        skipped = skipped | label.contains(text)
    return submit_type | named | ((label != "") & ~skipped)


def login_forms(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``page_id, user_selector, has_password, has_submit, error_text`` for every page.

    ``most`` keeps that many characters of the error text.
    """
    parsed = pages.select("page_id", dom_nodes(F.col("html"), spaces=True).alias("nodes"))
    nodes = F.col("nodes")
    user = F.coalesce(*[F.when(_any_visible(nodes, s), F.lit(s)) for s in USER_SELECTORS])
    buttons = select(
        nodes, "button[type=submit], input[type=submit], button, div[role=button]"
    )
    # Each selector offers its first element; the first of them with text wins.
    errors = [F.get(select(nodes, s), F.lit(0)) for s in ERROR_SELECTORS]
    error = F.coalesce(
        *[F.nullif(F.when(e.isNotNull(), _text(nodes, e)), F.lit("")) for e in errors]
    )
    return parsed.select(
        "page_id",
        user.alias("user_selector"),
        _any_visible(nodes, "input[type=password]").alias("has_password"),
        F.exists(buttons, lambda b: _visible(b) & _submits(b, nodes)).alias("has_submit"),
        (error if most is None else F.substring(error, 1, most)).alias("error_text"),
    )
