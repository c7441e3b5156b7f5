"""Selectors matched while a page is parsed: one walk for any number of them.

Each step of each selector has a bit. An open element carries the steps that it matches and, as a signature, those
that it or an ancestor matches; a new element needs its parent's two numbers only to tell what it matches
itself.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import NamedTuple

from pyspark import cloudpickle

# The matcher travels to the workers with the node job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG, CLASS, ID, ATTRIBUTE, NTH = "tag", "class", "id", "attribute", "nth"


class Simple(NamedTuple):
    """One test of an element; an ``op`` of ``""`` matches nothing."""

    kind: str
    name: str
    op: str | None = None
    wanted: str | None = None
    fold: bool = False


Step = tuple[str, tuple[Simple, ...]]
Test = Callable[[dict, int], bool]


def _has_word(value: str, word: str) -> bool:
    return word in value.translate({9: " ", 10: " ", 12: " ", 13: " "}).split(" ")


_OPERATORS = {
    "=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": _has_word,
    "": lambda value, wanted: False,
}


def _test(simple: Simple) -> Test:
    """Whether an element passes, by its attributes and its number among its parent's children."""
    name = simple.name
    if simple.kind == CLASS:
        return lambda attrs, nth: "class" in attrs and _has_word(attrs["class"], name)
    if simple.kind == ID:
        return lambda attrs, nth: attrs.get("id") == name
    if simple.kind == NTH:
        if name in ("odd", "even"):
            return lambda attrs, nth: nth % 2 == (name == "odd")
        return lambda attrs, nth: nth == int(name)
    if simple.op is None:
        return lambda attrs, nth: name in attrs
    compare, wanted, fold = _OPERATORS[simple.op], simple.wanted, simple.fold

    def attribute(attrs: dict, nth: int) -> bool:
        value = attrs.get(name)
        return value is not None and compare(value.lower() if fold else value, wanted)

    return attribute


class Matcher:
    """Any number of selectors, each given as the steps of its alternatives."""

    def __init__(self, selectors: list[list[list[Step]]]) -> None:
        self._by_tag: dict[str, list] = {}
        self._last: list[tuple[int, int]] = []
        bit = 1
        for number, alternatives in enumerate(selectors):
            for steps in alternatives:
                before = 0
                for combinator, tests in steps:
                    tag = next((t.name for t in tests if t.kind == TAG), "*")
                    rest = [_test(t) for t in tests if t.kind != TAG]
                    self._by_tag.setdefault(tag, []).append((bit, before, combinator == ">", rest))
                    before, bit = bit, bit * 2
                self._last.append((before, number))
        self._finals = sum({b for b, _ in self._last})
        self._base = sum({b for b, number in self._last if number == 0})
        self._any = self._by_tag.pop("*", [])

    def step(self, tag: str, attrs: dict, nth: int, parent: tuple[int, int]) -> tuple[int, int]:
        """``(own, signature)`` of an element from that of its parent; ``(0, 0)`` is that of the page."""
        own = 0
        for bit, before, child, tests in self._by_tag.get(tag, ()):
            if (not before or before & parent[0 if child else 1]) and all(t(attrs, nth) for t in tests):
                own |= bit
        for bit, before, child, tests in self._any:
            if (not before or before & parent[0 if child else 1]) and all(t(attrs, nth) for t in tests):
                own |= bit
        return (own, parent[1] | own) if own else (0, parent[1])

    def hits(self, own: int) -> list[int]:
        """The numbers of the selectors that an element matches."""
        return sorted({number for bit, number in self._last if bit & own}) if own & self._finals else []

    def inside(self, signature: int) -> bool:
        """Whether the first selector matches an element or an ancestor, by the element's signature."""
        return bool(signature & self._base)
