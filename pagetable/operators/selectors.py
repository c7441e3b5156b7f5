"""A small CSS selector language, compiled to expressions over the node array or for the node job."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from pagetable.sources.matching import ATTRIBUTE, CLASS, ID, NTH, TAG, Simple, Step

Test = Callable[[Column], Column]

_NAME = r"(?:[A-Za-z0-9_-]|[^\x00-\x7f])+"
_SIMPLE = re.compile(
    rf"""(?P<tag>\*|{_NAME})
       | \.(?P<cls>{_NAME})
       | \#(?P<id>{_NAME})
       | \[\s*(?P<attr>{_NAME})\s*
            (?:(?P<op>[\^$*~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))\s*
               (?P<fold>[iI])?\s*)?\]
       | :first-child(?P<first>) (?![\w-])
       | :nth-child\(\s*(?P<nth>\d+|odd|even)\s*\)
    """,
    re.VERBOSE,
)
_COMBINATOR = re.compile(r"\s*(>)\s*|\s+")


class SelectorError(ValueError):
    """The selector uses something outside the supported subset."""


def _has_word(value: Column, word: str) -> Column:
    padded = F.concat(F.lit(" "), F.translate(value, "\t\n\r\f", "    "), F.lit(" "))
    return padded.contains(f" {word} ")


def _attribute_test(simple: Simple) -> Test:
    def test(node: Column) -> Column:
        value = node["attrs"][simple.name]
        if simple.op is None:
            return value.isNotNull()
        text = F.lower(value) if simple.fold else value
        want = simple.wanted
        if simple.op == "=":
            return text == want
        return {
            "^=": text.startswith,
            "$=": text.endswith,
            "*=": text.contains,
            "~=": lambda w: _has_word(text, w),
            "": lambda w: F.lit(False),
        }[simple.op](want)

    return test


def _simple(m: re.Match) -> Simple:
    if m["tag"] is not None:
        return Simple(TAG, m["tag"].lower())
    if m["cls"] is not None:
        return Simple(CLASS, m["cls"])
    if m["id"] is not None:
        return Simple(ID, m["id"])
    if m["attr"] is not None:
        wanted = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
        # HTML compares values of ``type`` without regard to letter case.
        fold = m["fold"] is not None or m["attr"].lower() == "type"
        op = m["op"]
        if op not in (None, "=") and (not wanted or (op == "~=" and re.search(r"\s", wanted))):
            op = ""  # matches nothing
        return Simple(ATTRIBUTE, m["attr"].lower(), op, wanted.lower() if wanted and fold else wanted, fold)
    if m["first"] is not None:
        return Simple(NTH, "1")
    return Simple(NTH, m["nth"])


def _column_test(simple: Simple) -> Test:
    name = simple.name
    if simple.kind == TAG:
        return lambda n: n["tag"].isNotNull() if name == "*" else n["tag"] == name
    if simple.kind == CLASS:
        return lambda n: _has_word(n["attrs"]["class"], name)
    if simple.kind == ID:
        return lambda n: n["attrs"]["id"] == name
    if simple.kind == ATTRIBUTE:
        return _attribute_test(simple)
    if name in ("odd", "even"):
        return lambda n: n["nth"] % 2 == (1 if name == "odd" else 0)
    return lambda n: n["nth"] == int(name)


def _parse_one(text: str) -> list[Step]:
    """``[(combinator before, tests)]``, leftmost first; the first combinator is ``''``."""
    steps: list[Step] = []
    at, combinator = 0, ""
    while True:
        tests = []
        while m := _SIMPLE.match(text, at):
            if m["tag"] is not None and tests:
                break
            tests.append(_simple(m))
            at = m.end()
        if not tests:
            raise SelectorError(f"unsupported selector: {text!r}")
        steps.append((combinator, tuple(tests)))
        if at == len(text):
            return steps
        gap = _COMBINATOR.match(text, at)
        if not gap:
            raise SelectorError(f"unsupported selector: {text!r}")
        combinator, at = gap[1] or " ", gap.end()


_LIST_PIECE = re.compile(r"""\[(?:[^\]"']|"[^"]*"|'[^']*')*\]|,|\[|[^,\[]+""")


def _split_list(selector: str) -> list[str]:
    """Split at commas outside brackets."""
    parts = [""]
    for piece in _LIST_PIECE.findall(selector):
        if piece == ",":
            parts.append("")
        else:
            parts[-1] += piece
    return [p.strip() for p in parts]


def _all(tests: list[Test], node: Column) -> Column:
    out = tests[0](node)
    for t in tests[1:]:
        out = out & t(node)
    return out


def steps_of(selector: str) -> list[list[Step]]:
    """The steps of each selector of a list."""
    return [_parse_one(part) for part in _split_list(selector)]


def check(selector: str) -> None:
    """Raise :class:`SelectorError` unless the selector is supported."""
    steps_of(selector)


def select(nodes: Column, selector: str) -> Column:
    """The elements of the page that match, in document order.

    Each step filters the node array by its own cheap tests first and only then looks for a
    matching parent or ancestor among the (few) matches of the step before.
    """
    found = [_select_steps(nodes, steps) for steps in steps_of(selector)]
    if len(found) == 1:
        return found[0]
    ids = F.array_distinct(F.concat(*[F.transform(f, lambda n: n["id"]) for f in found]))
    return F.transform(F.sort_array(ids), lambda i: F.element_at(nodes, i))


def _select_steps(nodes: Column, steps: list[Step]) -> Column:
    matched = None
    for combinator, tests in steps:
        matched = _next_matches(nodes, matched, combinator, [_column_test(t) for t in tests])
    return matched


def _next_matches(nodes, before, combinator: str, tests: list[Test]) -> Column:
    if before is None:
        return F.filter(nodes, lambda n: _all(tests, n))

    def related(n: Column, outer: Column) -> Column:
        if combinator == ">":
            return F.exists(outer, lambda a: a["id"] == n["parent"])
        return F.exists(outer, lambda a: (a["id"] < n["id"]) & (n["id"] <= a["last"]))

    # ``before`` is bound once instead of being filtered anew for every node.
    bound = F.transform(
        F.array(before),
        lambda outer: F.filter(nodes, lambda n: _all(tests, n) & related(n, outer)),
    )
    return F.element_at(bound, 1)
