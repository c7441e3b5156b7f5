"""The node job: HTML text to an array of DOM nodes, one array per page.

This is the only Python stage of the engine. It runs as an Arrow UDF, so only ``html`` crosses to
the Python worker, the other columns stay in the JVM, and no row is shuffled: each page keeps its
nodes in its own row and later operators are higher-order functions over that array.

A node is ``struct(id, parent, last, depth, nth, zone, tag, attrs, text, lists, quotes, cells)``:

* ``id`` is the preorder number (with elements included also the 1-based place in the array, so a
  subtree is a slice), ``last`` the largest id in its subtree, so ``d`` lies below ``n``
  when ``n.id < d.id AND d.id <= n.last`` (interval encoding);
* ``nth`` is the 1-based place among the parent's element children;
* ``zone`` has one bit per kind of ancestor, see :mod:`pagetable.functions.markup`;
* ``lists`` and ``quotes`` count an element's ancestors that are lists and block quotes, ``cells`` its children that
  are table cells;
* text nodes have a null ``tag``; element nodes a null ``text``.
"""

from __future__ import annotations

import gc
import re
import sys
from bisect import bisect_right
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from pagetable.functions.markup import (
    ATTRIBUTE,
    BOILER_CLASSES,
    RAW_DECODED,
    TAG_ZONES,
    TOKENS,
    ZONE_BODY,
    ZONE_BOILER,
    ZONE_HIDDEN,
    ZONE_RAW,
)
from pagetable.sources.matching import Matcher, Step

# The job travels to the workers with its code, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_TYPE = (
    "array<struct<id:int,parent:int,last:int,depth:int,nth:int,zone:int,"
    "tag:string,attrs:map<string,string>,text:string,lists:int,quotes:int,cells:int>>"
)
_ARROW_NODE = pa.struct([
    ("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()),
    ("nth", pa.int32()), ("zone", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ("lists", pa.int32()), ("quotes", pa.int32()), ("cells", pa.int32()),
])

# What a schema of selectors needs of a page: matching elements, and the trimmed texts inside those of the first.
FOUND_TYPE = "array<struct<id:int,raw:boolean,last:int,hits:array<int>,text:string>>"
_ARROW_FOUND = pa.struct([
    ("id", pa.int32()), ("raw", pa.bool_()), ("last", pa.int32()), ("hits", pa.list_(pa.int32())), ("text", pa.string()),
])

_NODES_PER_CHUNK = 50_000
_LAST, _CELL_COUNT = _ARROW_NODE.get_field_index("last"), _ARROW_NODE.get_field_index("cells")

_RAW_DECODED = frozenset(RAW_DECODED.split("|"))
_TOKEN = re.compile(TOKENS)
_ATTRIBUTE = re.compile(ATTRIBUTE)
_ATTR_REF = re.compile(
    r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:%s)(?![=A-Za-z0-9]))"
    % "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
)
_TAG_ZONE: dict[str, int] = {}
for _bit, _tags in TAG_ZONES.items():
    for _tag in _tags:
        _TAG_ZONE[_tag] = _TAG_ZONE.get(_tag, 0) | _bit

# Fixed values of HTML's tree rules.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("base link meta noscript script style template title".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul "
    "li dt dd".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WALLS = frozenset("html body table caption td th button object template select".split())
# New tag -> (open tags it ends, tags the search does not look beyond).
_ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "datalist optgroup"),
    "optgroup": ("option optgroup", ""),
    "tr": ("tr td th caption", "thead tbody tfoot"),
    "td": ("td th", "tr"),
    "th": ("td th", "tr"),
    "tbody": ("thead tbody tfoot caption", ""),
    "thead": ("thead tbody tfoot caption", ""),
    "tfoot": ("thead tbody tfoot caption", ""),
    "rt": ("rt rp", "ruby"),
    "rp": ("rt rp", "ruby"),
    "a": ("a", ""),
}
# An end tag does not reach across an open element of a higher rank.
_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
         "table": 190, "head": 200, "body": 200, "html": 220}


def _rule(targets: str, walls: str) -> tuple[frozenset, frozenset]:
    ended = frozenset(targets.split())
    return ended, (_WALLS | frozenset(walls.split())) - ended


_END_RULES = {tag: _rule(*rule) for tag, rule in _ENDS.items()}
_P_RULE = _rule("p", "")
# Rank -> tags of a higher one.
_HIGHER = {r: tuple(t for t in _RANK if _RANK[t] > r) for r in {100, *_RANK.values()}}


def _attr_text(value: str) -> str:
    if "&" not in value:
        return value

    def one(m):
        ref = m.group()
        known = ref[1] == "#" or ref[1:] in html5
        return unescape(ref) if known else ref

    return _ATTR_REF.sub(one, value)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, quoted, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _attr_text(quoted or single or bare))
    return found


class _Nodes:
    """The nodes of one Arrow batch, as rows in the field order of ``_ARROW_NODE``, or of ``_ARROW_FOUND``."""

    def __init__(self, want_elements: bool, want_spaces: bool, matcher: Matcher | None = None) -> None:
        self.want_elements, self.want_spaces, self.matcher = want_elements, want_spaces, matcher
        self.type = _ARROW_FOUND if matcher else _ARROW_NODE
        self.rows: list[list] = []
        self.offsets, self.nulls = [0], []

    def add_page(self, html: str | None) -> None:
        if html is not None:
            self._parse(html)
        self.offsets.append(len(self.rows))
        self.nulls.append(html is None)

    def _parse(self, html: str) -> None:
        # Open elements, innermost last: [id, tag, zone, element children, emitted row, match state].
        stack: list[list] = []
        # Tag -> depths at which it is open; spares walks up the stack, however deep it is.
        opened: dict[str, list[int]] = {}
        rows, want_elements, unwanted = self.rows, self.want_elements, [0] * len(_ARROW_NODE)
        matcher = self.matcher
        pending: list[str] = []
        last_id = 0

        def pop_to(depth: int) -> None:
            if pending:
                flush()
            while len(stack) > depth:
                top = stack.pop()
                opened[top[1]].pop()
                top[4][_LAST] = last_id

        def flush() -> None:
            nonlocal last_id
            text = "".join(pending)
            pending.clear()
            blank = not text.strip()
            if "body" not in opened and stack[-1:] and stack[-1][1] in ("html", "head") or not stack:
                if blank:
                    return
                start_body()
            if blank and not self.want_spaces:
                return
            last_id += 1
            parent = stack[-1]
            if matcher:
                text = text.strip()
                if text and matcher.inside(parent[5][1]):
                    rows.append([last_id, parent[2] & ZONE_RAW != 0, last_id, None, text])
                return
            rows.append(
                [last_id, parent[0], last_id, len(stack), None, parent[2], None, None, text, None, None, None]
            )

        def push(tag: str, attrs: dict[str, str]) -> None:
            nonlocal last_id
            if pending:
                flush()
            last_id += 1
            parent = stack[-1] if stack else [0, "", 0, 0, None, (0, 0)]
            parent[3] += 1
            zone = parent[2] | _TAG_ZONE.get(tag, 0)
            if "hidden" in attrs:
                zone |= ZONE_HIDDEN
            if "class" in attrs and parent[2] & ZONE_BODY:
                if not BOILER_CLASSES.isdisjoint(attrs["class"].split()):
                    zone |= ZONE_BOILER
            row, state = unwanted, None
            if matcher:
                state = matcher.step(tag, attrs, parent[3], parent[5])
                if hits := matcher.hits(state[0]):
                    row = [last_id, _TAG_ZONE.get(tag, 0) & ZONE_RAW != 0, last_id, hits, None]
                    rows.append(row)
            elif want_elements:
                lists = len(opened.get("ul", ())) + len(opened.get("ol", ()))
                row = [last_id, parent[0], last_id, len(stack), parent[3], zone, tag,
                       list(attrs.items()), None, lists, len(opened.get("blockquote", ())), 0]
                if tag in ("td", "th") and parent[4]:
                    parent[4][_CELL_COUNT] += 1
                rows.append(row)
            opened.setdefault(tag, []).append(len(stack))
            stack.append([last_id, tag, zone, 0, row, state])

        def start_body() -> None:
            held, pending[:] = pending[:], []
            if "html" not in opened:
                push("html", {})
            pop_to(1)
            push("body", {})
            pending[:] = held

        def close(rule) -> None:
            targets, walls = rule
            if not any(opened.get(t) for t in targets):
                return
            wall = max((opened[w][-1] for w in walls if opened.get(w)), default=-1)
            cuts = [
                d[bisect_right(d, wall)] for t in targets if (d := opened.get(t)) and d[-1] > wall
            ]
            if cuts:
                pop_to(min(cuts))

        def end_implied(tag: str) -> None:
            if tag in _END_RULES:
                close(_END_RULES[tag])
            if tag in _CLOSES_P:
                close(_P_RULE)
                if tag in _HEADINGS and stack[-1][1] in _HEADINGS:
                    pop_to(len(stack) - 1)

        def start_tag(tag: str, source: str, content: str | None) -> None:
            attrs = _attributes(source) if source else {}
            if tag in ("html", "head", "body"):
                if tag in opened or (tag == "head" and "body" in opened):
                    return
                if tag != "html":
                    if "html" not in opened:
                        push("html", {})
                    pop_to(1)
                push(tag, attrs)
                return
            if pending:
                flush()
            if "body" not in opened:
                if tag not in _HEAD:
                    start_body()
                elif "head" not in opened:
                    if "html" not in opened:
                        push("html", {})
                    push("head", {})
            end_implied(tag)
            push(tag, attrs)
            if content is not None:
                if content:
                    pending.append(content if tag not in _RAW_DECODED
                                   else unescape(content))
                pop_to(len(stack) - 1)
            elif tag in _VOID or source.endswith("/"):
                pop_to(len(stack) - 1)

        def end_tag(tag: str) -> None:
            if tag in ("html", "body"):
                return
            depths = opened.get(tag)
            if depths:
                higher = _HIGHER[_RANK.get(tag, 100)]
                if not any(opened.get(t) and opened[t][-1] > depths[-1] for t in higher):
                    pop_to(depths[-1])
                    return
            if tag in ("p", "br"):
                start_tag(tag, "", None)
                if tag == "p":
                    pop_to(len(stack) - 1)

        for m in _TOKEN.finditer(html):
            raw, raw_attrs, content, slash, tag, attrs = m.groups()
            if tag is not None:
                if slash:
                    end_tag(tag.lower())
                else:
                    start_tag(tag.lower(), attrs, None)
            elif raw is not None:
                start_tag(raw.lower(), raw_attrs, content)
            else:
                text = m.group()
                if text[0] != "<" or text == "<":
                    pending.append(unescape(text) if "&" in text else text)
                elif text.startswith("<!--") and pending:
                    flush()
        if pending:
            flush()
        pop_to(0)

    def to_arrow(self) -> pa.Array:
        columns = list(zip(*self.rows)) or [()] * len(self.type)
        values = pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.type)], fields=list(self.type)
        )
        nulls = pa.array(self.nulls, pa.bool_())
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), values, mask=nulls)


def _node_udf(want_elements: bool, want_spaces: bool, selectors: list[list[list[Step]]] | None = None):
    @F.arrow_udf(FOUND_TYPE if selectors else NODE_TYPE)
    def dom_nodes(pages: pa.Array) -> pa.Array:
        # Python objects are turned into Arrow every so many nodes, so a batch of large pages
        # never holds more than that many of them.
        matcher = Matcher(selectors) if selectors else None
        done, nodes = [], _Nodes(want_elements, want_spaces, matcher)
        # The many small lists of a chunk live until its end, so looking for garbage is in vain.
        gc.disable()
        try:
            for html in pages:
                nodes.add_page(html.as_py())
                if len(nodes.rows) > _NODES_PER_CHUNK:
                    done.append(nodes.to_arrow())
                    nodes = _Nodes(want_elements, want_spaces, matcher)
            done.append(nodes.to_arrow())
        finally:
            gc.enable()
        return pa.concat_arrays(done)

    return dom_nodes


def dom_nodes(html: Column, elements: bool = True, spaces: bool = False) -> Column:
    """Array of the page's nodes in document order; null for null HTML.

    ``elements=False`` leaves element nodes out and ``spaces=False`` leaves blank text nodes out,
    so that a text-only operator does not pay for moving them. Ids are unaffected by the former.
    """
    return _node_udf(elements, spaces)(html)


def found_nodes(html: Column, selectors: list[list[list[Step]]]) -> Column:
    """``array<struct<id, raw, last, hits, text>>``: what the selectors match, and texts inside what the first matches.

    ``hits`` are the numbers of the selectors that an element matches; texts have none, are trimmed and not
    empty. ``raw`` is set for scripts and the like and for texts in them. All selectors are matched in the one walk
    that parses the page, and no other node leaves it. Null for null HTML.
    """
    return _node_udf(False, False, selectors)(html)


def with_nodes(pages: DataFrame, elements: bool = True, spaces: bool = False) -> DataFrame:
    return pages.withColumn("nodes", dom_nodes(F.col("html"), elements, spaces))


def subtree(nodes: Column, node: Column) -> Column:
    """The nodes below ``node``; needs an array that includes elements."""
    return F.slice(nodes, node["id"] + 1, node["last"] - node["id"])


def is_text(node: Column) -> Column:
    return node["tag"].isNull()


def node_table(pages: DataFrame) -> DataFrame:
    """Long form: one row per node, keyed by ``page_id``."""
    exploded = with_nodes(pages.select("page_id", "html")).select(
        "page_id", F.explode_outer("nodes").alias("n")
    ).filter(F.col("n.id").isNotNull())
    kind = F.when(F.col("n.tag").isNull(), "text").otherwise("element").alias("kind")
    return exploded.select(
        "page_id",
        F.col("n.id").alias("node_id"),
        F.col("n.parent").alias("parent_id"),
        F.col("n.last").alias("last_id"),
        "n.depth", kind, "n.tag", "n.attrs", "n.text",
    )
