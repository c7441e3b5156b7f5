"""Node array to Markdown with higher-order functions.

Every kept node contributes an opening and a closing piece of text. Sorting the pieces by document
position and joining them gives the page; breaks travel as control characters until the end, so
that neighbouring breaks can be merged with regular expressions. Images are ignored, links kept,
lines not wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagetable.functions import markup as M
from pagetable.functions.strings import let, strip
from pagetable.sources.nodes import is_text

# Control characters standing for layout until the last step.
_PARAGRAPH, _LINE, _ITEM, _BLANK, _QUOTE, _BULLET = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"

# What elements look like in Markdown.
_BLOCKS = (
    "p", "div", "article", "section", "main", "figure", "figcaption", "form", "fieldset",
    "address", "center", "dl", "dt", "dd", "table", "details", "summary", "hgroup", "body",
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "u": "_", "del": "~~", "s": "~~",
          "strike": "~~", "code": "`", "tt": "`", "kbd": "`"}
_LISTS = ("ul", "ol")
_CELLS = ("td", "th")

_KEPT = M.ZONE_DROP | M.ZONE_RAW | M.ZONE_BOILER | M.ZONE_BODY


def _mark(tag: Column) -> Column:
    out = None
    for name, mark in _MARKS.items():
        out = F.when(tag == name, mark) if out is None else out.when(tag == name, mark)
    return out


def _is_link(node: Column) -> Column:
    href = node["attrs"]["href"]
    return (node["tag"] == "a") & href.isNotNull() & ~href.startswith("#")


# What would make a list of a line: the mark, and the mark escaped.
_LIST_STARTS = (
    (r"(?m)^(\s*\d+)\.(?=\s)", r"$1\\."),
    (r"(?m)^(\s*)\+(?=\s)", r"$1\\+"),
    (r"(?m)^(\s*)-(?=[\s-])", r"$1\\-"),
)


def _escaped(text: Column) -> Column:
    for pattern, replacement in _LIST_STARTS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _text(node: Column, nodes: Column) -> Column:
    plain = F.regexp_replace(node["text"], r"[\x01-\x06]", "")
    kept = F.regexp_replace(
        F.translate(F.regexp_replace(plain, r"^\n|\s+\z", ""), " ", _BLANK),
        "\n", _LINE + _BLANK * 4,
    )
    in_pre = node["zone"].bitwiseAND(M.ZONE_PRE) != 0
    in_code = F.element_at(nodes, node["parent"])["tag"].isin("code", "tt", "kbd")
    shown = F.when(in_code, plain).otherwise(_escaped(plain))
    return F.when(in_pre, kept).otherwise(F.regexp_replace(shown, r"[ \t\n\x0B\f\r]+", " "))


def _open(node: Column, nodes: Column) -> Column:
    tag = node["tag"]
    block = F.concat(F.lit(_PARAGRAPH), F.repeat(F.lit(_QUOTE), node["quotes"]))
    parent = F.element_at(nodes, node["parent"])
    number = F.coalesce(
        F.regexp_extract(parent["attrs"]["start"], r"^\d{1,9}$", 0).try_cast("int"), F.lit(1)
    )
    bullet = F.when(
        parent["tag"] == "ol", F.concat((number + node["nth"] - 1).cast("string"), F.lit("."))
    ).otherwise("*")
    return (
        F.when(is_text(node), _text(node, nodes))
        .when(tag.isin(*_BLOCKS), block)
        .when(
            tag.isin(*_HEADINGS),
            F.concat(block, F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")),
        )
        .when(_mark(tag).isNotNull() & (node["zone"].bitwiseAND(M.ZONE_PRE) == 0), _mark(tag))
        .when(_is_link(node), "[")
        .when(tag == "br", _BLANK * 2 + _LINE)
        .when(tag == "hr", F.concat(block, F.lit("* * *"), F.lit(_PARAGRAPH)))
        .when(tag == "blockquote", F.concat(block, F.lit(_QUOTE)))
        .when(tag == "pre", F.concat(block, F.lit(_BLANK * 4)))
        .when(tag.isin(*_LISTS), F.when(node["lists"] == 0, _PARAGRAPH))
        .when(
            tag == "li",
            F.concat(
                F.lit(_ITEM),
                F.repeat(F.lit(_BLANK * 2), node["lists"]),
                bullet,
                F.lit(_BULLET),
            ),
        )
        .when(tag.isin(*_CELLS) & (node["nth"] > 1), "| ")
    )


def _close(node: Column, nodes: Column) -> Column:
    tag = node["tag"]
    attrs = node["attrs"]
    name = F.when(attrs["title"] != "", F.concat(F.lit(' "'), attrs["title"], F.lit('"')))
    parent = F.element_at(nodes, node["parent"])
    first_row = (node["nth"] == 1) & ((parent["tag"] == "table") | (parent["nth"] == 1))
    end_row = F.lit(_BLANK * 2 + _LINE)
    rule = F.concat(F.repeat(F.lit("---|"), node["cells"] - 1), F.lit("---"), end_row)
    return (
        F.when(tag.isin(*_BLOCKS, *_HEADINGS, "blockquote", "pre"), _PARAGRAPH)
        .when(_mark(tag).isNotNull() & (node["zone"].bitwiseAND(M.ZONE_PRE) == 0), _mark(tag))
        .when(
            _is_link(node),
            F.concat(F.lit("]("), attrs["href"], F.coalesce(name, F.lit("")), F.lit(")")),
        )
        .when(tag.isin(*_LISTS), F.when(node["lists"] == 0, _PARAGRAPH))
        .when(tag == "tr", F.when(first_row, F.concat(end_row, rule)).otherwise(end_row))
    )


def _tidy(joined: Column) -> Column:
    """Merge neighbouring breaks and turn the control characters into text."""
    steps = [
        (r" *([\x01-\x03]) *", "$1"),  # no blanks around breaks
        (r"\x06[ \x01]+", "\x06"),  # a paragraph opening a list item
        (r"[\x01-\x04]*\x01\x05*(?=[\x01\x03])", ""),  # breaks before a paragraph or item break
        (r"([\x01\x05])\x03", "$1"),
        (r"\x01[\x02\x03]+", "\x01"),
        (r"[\x02\x04]+\x01", "\x01"),
        (r" {2,}", " "),
    ]
    for pattern, replacement in steps:
        joined = F.regexp_replace(joined, pattern, replacement)
    for mark, text in (
        (_PARAGRAPH, "\n\n"), (_LINE, "\n"), (_ITEM, "\n"), (_BLANK, " "), (_QUOTE, "> "),
        (_BULLET, " "),
    ):
        joined = F.replace(joined, F.lit(mark), F.lit(text))
    return joined


def to_markdown(nodes: Column) -> Column:
    """Markdown of the body without furniture; ``nodes`` must hold elements and blank texts."""
    kept = F.filter(nodes, lambda n: n["zone"].bitwiseAND(_KEPT) == M.ZONE_BODY)

    def piece(position: Column, phase: int, depth: Column, text: Column) -> Column:
        return F.struct(
            position.alias("at"), F.lit(phase).alias("phase"), (-depth).alias("depth"),
            F.coalesce(text, F.lit("")).alias("text"),
        )

    def render(kept: Column) -> Column:
        opening = F.transform(kept, lambda n: piece(n["id"], 0, n["depth"], _open(n, nodes)))
        closing = F.transform(
            F.filter(kept, lambda n: ~is_text(n)), lambda n: piece(n["last"], 1, n["depth"], _close(n, nodes))
        )
        pieces = F.sort_array(F.concat(opening, closing))
        return F.array_join(F.transform(pieces, lambda p: p["text"]), "")

    return strip(_tidy(let(kept, render)))
