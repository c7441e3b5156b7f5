"""Benchmark decontamination by templates: copied questions are found with other numbers and names.

Words are put in canonical form: numbers, names and units become typed placeholders, all else its
lower-case form. Whether a capitalised word is a name cannot be seen, so windows are also read with such
words as plain ones, and once as they stand. Windows of the resulting template are hash-joined between documents and benchmark.
Matches on one diagonal (the same distance between both positions) are put together. Those with the
benchmark's own words always count, others if their slots agree within a run: each value of the
benchmark always stands against the same value of the document, and different names against different
names. So a question with its numbers changed throughout is found, and
texts that share nothing but a frame of placeholders are not.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import mix, sole, whole_text, windows
from pagetable.session import Stage

WINDOW = 8  # words of a window; a shorter item is one window
SHORTEST = 4  # items of fewer words are looked for as they stand only
LITERAL_SHARE = 0.5  # of a template's words must be no placeholder; others are looked for as they stand
RUN = 13  # words in a row that make a match
COVERAGE = 0.6  # share of an item's words that makes a match
TOGETHER = 128  # documents whose words, in all readings and with the hashes of all runs, are held at once
FILTER_BITS = 23  # of the bitmap of benchmark windows, 1 MB whatever the benchmark's size

LITERAL, NUMBER, NAME, UNIT, STOP = range(5)
PLACEHOLDER = {NUMBER: "<number>", NAME: "<name>", UNIT: "<unit>"}
_SHOWN = frozenset(PLACEHOLDER.values())
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l cl s sec secs min mins h hr hrs hz khz mhz ghz "
    "kb mb gb tb w kw mw v a k c f pa kpa bar j kj cal kcal mph kmh usd eur gbp percent dollar "
    "dollars euro euros pound pounds cent cents inch inches foot feet yard yards mile miles meter "
    "meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre "
    "litres second seconds minute minutes hour hours day days week weeks month months year years "
    "degree degrees".split()
)
# A token is a number (digits, and . or , between two of them), a run of letters, or one of the stops .!?\n
_DIGITS, _LETTERS, _STOP = 1, 2, 3
_CLASSES = ((_LETTERS, regex.compile(r"[^\W\d_]+")), (_DIGITS, regex.compile(r"\d+")), (_STOP, regex.compile(r"[.!?\n]+")))
_LOW, _CLASS = (1 << 21) - 1, 21  # of what is known of a character: its lower case, and where its class begins
_UPPER, _CASED, _LOWER, _FIGURE, _ODD_CASE = (1 << i for i in range(23, 28))
_WINDOW_TYPE = (
    "id long, node binary, n_words int, pos int, width int, hash long, template string, words array<string>"
)




@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """What is known of every character: its lower case, its class, and bits for what cases it has.

    ``_CASED`` are capitals and title case, ``_FIGURE`` what begins a number, and ``_ODD_CASE`` those
    whose lower case is not one character, or not always the same.
    """
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    known = np.arange(len(every), dtype=np.uint32)
    for kind, pattern in _CLASSES:
        for run in pattern.finditer(every):
            known[run.start() : run.end()] |= np.uint32(kind << _CLASS)
    for i in np.flatnonzero(known >> _CLASS & 3).tolist():
        c = every[i]
        low = c.lower()
        odd = len(low) != 1 or c == "\u03a3"  # a last sigma is written otherwise
        bits = c.isupper() * _UPPER | c.istitle() * _CASED | c.islower() * _LOWER | c.isdigit() * _FIGURE | odd * _ODD_CASE
        if bits or low != c:
            known[i] = known[i] >> _CLASS << _CLASS | bits | (i if odd else ord(low))
    return known


BLOCK = 1 << 16  # characters that are hashed at once
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _weights() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(BLOCK)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, from 0, and of its inverse."""
    return tuple(
        np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
        for x in (_BASE, pow(_BASE, -1, 1 << 64))
    )


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the characters of each word, which is the same wherever the word stands."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        begin, end = int(starts[at]), int(ends[to - 1])
        powers, inverses = _weights() if end - begin <= BLOCK else _powers_of(end - begin)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(low[begin:end] * powers[: end - begin], out=sums[1:])
        first = starts[at:to] - begin
        out[at:to] = (sums[ends[at:to] - begin] - sums[first]) * inverses[first]
        at = to
    return mix(out)


def _hash_of(word: str) -> int:
    low = np.array([*map(ord, word)], np.uint64)
    return int(_word_hashes(low, np.zeros(1, np.int64), np.array([len(low)]))[0])


@lru_cache(maxsize=1)
def _unit_spots() -> np.ndarray:
    """Where the last 16 bits of a unit's hash are."""
    spots = np.zeros(1 << 16, bool)
    spots[[_hash_of(u) & 0xFFFF for u in UNITS]] = True
    return spots


_PAIR = ("doc_id", "node", "item_id", "item_node", "n_words")
_ODD = np.uint64(11 * 2 + 0x9E3779B97F4A7C15)
_PLACEHOLDER_HASH = mix(np.arange(8, dtype=np.uint64) + np.uint64(0x5EED))


def canonical(texts: list[str]) -> tuple[Callable, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts end to end: a function that spells out some in lower case, their kinds, their
    hashes as literals and whether they open a sentence or the text; then each text's offset among them.

    Every capitalised word has the kind of a name; capitals throughout are no name. A unit is one only
    right behind a number. All is found for all characters at once.
    """
    sole("decontamination")
    joined = "\0".join(["", *texts, ""])  # which is in no token
    known = _characters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    classes = (known >> np.uint32(_CLASS) & np.uint32(3)).astype(np.uint8)
    low = known & np.uint32(_LOW)
    marks = np.flatnonzero((low == ord(".")) | (low == ord(",")))
    classes[marks[(classes[marks - 1] == _DIGITS) & (classes[marks + 1] == _DIGITS)]] = _DIGITS
    step = classes[1:] != classes[:-1]
    step |= classes[1:] == _STOP
    starts = np.flatnonzero(step & (classes[1:] != 0)) + 1
    step = classes[1:] != classes[:-1]
    step |= classes[:-1] == _STOP
    ends = np.flatnonzero(step & (classes[:-1] != 0)) + 1
    hashes = _word_hashes(low, starts, ends)
    odd = np.flatnonzero(known & np.uint32(_ODD_CASE))
    for i in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
        hashes[i] = _hash_of(joined[starts[i] : ends[i]].lower())

    first = known[starts]
    kinds = np.full(len(starts), LITERAL, np.int64)
    name = np.flatnonzero((first & np.uint32(_UPPER) != 0) & (ends - starts > 1))
    if len(name):
        rest = np.bitwise_or.reduceat(known, np.stack([starts[name] + 1, ends[name]], axis=1).reshape(-1))[::2]
        kinds[name[rest & np.uint32(_CASED | _LOWER) == _LOWER]] = NAME
    kinds[first & np.uint32(_FIGURE) != 0] = NUMBER
    kinds[classes[starts] == _STOP] = STOP
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]) + 1)
    before = np.concatenate([[STOP], kinds[:-1]])[: len(kinds)]
    before[bounds[:-1][np.diff(bounds) > 0]] = STOP
    maybe = _unit_spots()[hashes & np.uint64(0xFFFF)] & ((kinds == NAME) | (kinds == LITERAL) & (before == NUMBER))
    for i in np.flatnonzero(maybe).tolist():
        if joined[starts[i] : ends[i]].lower() in UNITS:
            kinds[i] = UNIT if before[i] == NUMBER else LITERAL

    is_word = kinds != STOP
    words_before = np.concatenate([[0], np.cumsum(is_word)])
    at = np.flatnonzero(is_word)
    starts, ends = starts[at], ends[at]

    def spelled(start: int, width: int) -> list[str]:
        edges = zip(starts[start : start + width].tolist(), ends[start : start + width].tolist())
        return [joined[a:b].lower() for a, b in edges]

    return spelled, kinds[at], hashes[at], before[at] == STOP, words_before[bounds]


def _powers(values: np.ndarray) -> list[np.ndarray]:
    """Hashes of runs of 1, 2, 4 and 8 words from every place."""
    powers, size = [mix(values + np.uint64(11))], 1
    while size * 2 <= WINDOW:
        last = powers[-1]
        powers.append(mix(last[: max(len(last) - size, 0)] * _ODD + last[size:]))
        size *= 2
    return powers


def _hashes(powers: list[np.ndarray], starts: np.ndarray, width: int) -> np.ndarray:
    """An order-sensitive 64-bit hash of each window."""
    whole, have = np.zeros(len(starts), np.uint64), 0
    for i, power in enumerate(powers):
        if width >> i & 1:
            whole = mix(whole * _ODD + power[starts + have])
            have += 1 << i
    return whole


def _batch(batch, sizes, offsets, starts, row, width, values, words, shown) -> pa.RecordBatch:
    """Windows as rows; ``shown`` holds the kind that each word of a window is read as."""
    return pa.RecordBatch.from_arrays(
        [
            batch["id"].take(pa.array(row)),
            batch["node"].take(pa.array(row)),
            pa.array(sizes[row].astype(np.int32)),
            pa.array((starts - offsets[row]).astype(np.int32)),
            pa.array(np.full(len(starts), width, np.int32)),
            pa.array(values.view(np.int64)),
            pa.array([" ".join(PLACEHOLDER.get(k) or w for w, k in zip(*x)) for x in zip(words, shown)], pa.string()),
            pa.array(words, pa.list_(pa.string())),
        ],
        ["id", "node", "n_words", "pos", "width", "hash", "template", "words"],
    )


def _rows(df: DataFrame, id_column: str) -> DataFrame:
    text = whole_text()
    return df.select(F.col(id_column).cast("long").alias("id"), _node(text).alias("node"), text.alias("text"))


def _node(text: Column) -> Column:
    """One for equal texts; with the id it names a row, as ids may be missing or repeated."""
    return F.unhex(F.md5(text))


def _readings(kinds: list[int]) -> list[list[int]]:
    """What the words of a benchmark window are read as: all as they stand, and as templates in which
    each capitalised word is a name or is none."""
    names = [i for i, k in enumerate(kinds) if k == NAME]
    fixed = [LITERAL if k == NAME else k for k in kinds]
    most = int(len(kinds) * (1 - LITERAL_SHARE)) - sum(k != LITERAL for k in fixed)
    out = [[LITERAL] * len(kinds)]
    if len(kinds) < SHORTEST:
        return out
    for n in range(min(most, len(names)) + 1):
        for chosen in combinations(names, n):
            read = [NAME if i in chosen else k for i, k in enumerate(fixed)]
            if any(read):
                out.append(read)
    return out


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of every item in all readings: position, hash, template and words.

    An item gives windows of ``WINDOW`` words, or one of all its words if it has fewer.
    """

    def cut(batches):
        for batch in batches:
            spelled, kinds, literal, _, offsets = canonical(batch["text"].to_pylist())
            sizes = np.diff(offsets)
            for width in range(1, WINDOW + 1):
                starts, row = windows(literal, offsets, width)
                own = np.minimum(sizes, WINDOW)[row] == width
                found = [(s, r, x) for s, r in zip(starts[own], row[own]) for x in _readings(kinds[s : s + width].tolist())]
                if not found:
                    continue
                starts, row = np.array([f[0] for f in found]), np.array([f[1] for f in found])
                shown = np.array([f[2] for f in found])
                read = np.where(shown == LITERAL, literal[starts[:, None] + np.arange(width)], _PLACEHOLDER_HASH[shown])
                values = _hashes(_powers(read.reshape(-1)), np.arange(len(starts)) * width, width)
                words = [spelled(s, width) for s in starts]
                yield _batch(batch, sizes, offsets, starts, row, width, values, words, shown.tolist())

    return _rows(benchmark, "item_id").mapInArrow(cut, _WINDOW_TYPE)


def document_windows(docs: DataFrame, widths: list[int], seen) -> DataFrame:
    """Windows of every document that are in ``seen``, a bitmap of hashes, for the given widths.

    A window is read as it stands and as a template whose names are none, the capitalised words
    that open no sentence, and all capitalised words. As the benchmark has every reading, words of one
    place meet if they are equal but for case, and if both are capitalised.
    """

    def cut(batches):
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            spelled, kinds, literal, opens, offsets = canonical(batch["text"].to_pylist())
            sizes = np.diff(offsets)
            plain = np.where(kinds == NAME, LITERAL, kinds)
            read = [np.zeros_like(kinds), plain, np.where(opens, plain, kinds), kinds]
            powers = [_powers(np.where(k == LITERAL, literal, _PLACEHOLDER_HASH[k])) for k in read]
            sums = [np.concatenate([[0], np.cumsum(k != LITERAL)]) for k in read]
            for width in widths:
                starts, row = windows(literal, offsets, width)
                slots = [x[starts + width] - x[starts] for x in sums]
                for i in range(len(read) if width >= SHORTEST else 1):
                    here = np.arange(len(starts))
                    if i:
                        here = np.flatnonzero((slots[i] <= width * (1 - LITERAL_SHARE)) & (slots[i] > slots[i - 1]))
                    values = _hashes(powers[i], starts[here], width)
                    spot = values & np.uint64((1 << FILTER_BITS) - 1)
                    known = (seen[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    here, values = here[known], values[known]
                    if i == 0 and width < WINDOW:  # all of an item, so one place of a document will do
                        once = np.unique(np.stack([row[here].astype(np.uint64), values]), axis=1, return_index=True)[1]
                        here, values = here[once], values[once]
                    if not len(here):
                        continue
                    words = [spelled(s, width) for s in starts[here]]
                    shown = [read[i][s : s + width].tolist() for s in starts[here]]
                    yield _batch(batch, sizes, offsets, starts[here], row[here], width, values, words, shown)

    return _rows(docs, "doc_id").mapInArrow(cut, _WINDOW_TYPE)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, longest, coverage, reparameterised`` of every contaminated pair.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``. Of windows whose slots agree,
    either ``RUN`` template words in a row or a share of ``COVERAGE`` of the item's words must stand in the document.
    ``longest`` is the largest number of words on one diagonal. Null texts have no words. Items
    of fewer than ``SHORTEST`` words, and windows that are mostly placeholders, count as they stand only, but for
    case: a one-word item is found in every document with that word. Each text is
    judged on its own, so rows that share a doc_id, null included, or an item_id may give a pair several times;
    rows alike in id and text give it once.

    A bitmap of the benchmark's windows, of fixed size, keeps other windows of documents from being written; it
    drops none that the join would find. The join itself is left to Spark.
    """
    return _pairs(docs, benchmark).drop("node", "item_node")


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs with ``node`` and ``item_node``, which tell texts under one id apart."""
    items = item_windows(benchmark)
    spot = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    spots = items.select("width", spot.alias("spot")).groupBy(F.expr("spot div 64").alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.collect_set("width").alias("widths")
    ).collect()
    widths = sorted({w for r in spots for w in r["widths"]})
    seen = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for word, bits, _ in spots:
        seen[word] = bits
    seen = seen.view(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(seen) if widths else None
    if not widths:
        return items.select(
            F.col("id").alias("doc_id"), "node", F.col("id").alias("item_id"), F.col("node").alias("item_node"), "n_words",
            F.col("n_words").alias("longest"), F.lit(0.0).alias("coverage"),
            F.lit(False).alias("reparameterised"),
        ).limit(0)
    found = document_windows(docs, widths, _Shared(shared))
    return _joined(found, items)


class _Shared:
    """A broadcast bitmap that reads like the array it holds."""

    def __init__(self, held) -> None:
        self._held = held

    def __getitem__(self, at):
        return self._held.value[at]


def _runs(windows: list[tuple]) -> list[list[tuple]]:
    """Windows, in order of position, cut where no window covers the step from one word to the next."""
    out, end = [], -1
    for w in sorted(windows):
        if w[0] > end:
            out.append([])
        out[-1].append(w)
        end = max(end, w[0] + len(w[1]))
    return out


def _counted(run: list[tuple]) -> list[tuple]:
    """The windows of a run that count as a copy of the benchmark's words.

    Windows with the benchmark's own words always do. Of the others, those do that agree on what
    stands for each of the benchmark's values. Where a value has several counterparts, those are taken by
    which most words are covered. Two numbers or units may become one, as they do by chance, but names
    may not: if they fall together, the run counts only where it is unchanged.
    """
    same = [w for w in run if w[1] == w[2]]
    slots = [{(k, b, d) for k, b, d in zip(w[3].split(" "), w[1], w[2]) if k in _SHOWN} for w in run]
    options = {}
    for w in slots:
        for k, b, d in w:
            options.setdefault((k, b), Counter())[d] += 1
    open_ = [b for b, ds in options.items() if len(ds) > 1]
    chosen = {b: ds.most_common(1)[0][0] for b, ds in options.items()}

    def taken():
        kept = [w for w, x in zip(run, slots) if all(chosen[k, b] == d for k, b, d in x)]
        names = {(b, d) for w in kept for k, b, d in zip(w[3].split(" "), w[1], w[2]) if k == PLACEHOLDER[NAME]}
        return [*kept, *same] if len({d for _, d in names}) == len(names) else same

    best = taken()
    most = len(_covered(best))
    better = bool(open_)
    while better:  # each turn covers more words
        better = False
        for b in open_:
            for d in list(options[b]):
                before, chosen[b] = chosen[b], d
                now = taken()
                if len(_covered(now)) > most:
                    best, most, better = now, len(_covered(now)), True
                else:
                    chosen[b] = before
    return best


def _covered(windows: list[tuple]) -> set[int]:
    return {p for w in windows for p in range(w[0], w[0] + len(w[1]))}


def _judged(batches):
    """What counts of each diagonal: the item's words that are covered, and whether any is changed."""
    for batch in batches:
        covered, changed = [], []
        for found in batch["found"].to_pylist():
            windows = [(w["pos"], w["b"], w["d"], w["template"]) for w in found]
            counted = [w for run in _runs(windows) for w in _counted(run)]
            covered.append(sorted(_covered(counted)))
            changed.append(any(b != d for _, b, d, _ in counted))
        kept = batch.drop_columns(["found"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(covered, pa.list_(pa.int32())), pa.array(changed, pa.bool_())],
            [*kept.schema.names, "covered", "changed"],
        )


def _joined(found: DataFrame, items: DataFrame) -> DataFrame:
    d = found.select(F.col("id").alias("doc_id"), "node", F.col("pos").alias("doc_pos"), "width", "hash", "template", F.col("words").alias("d"))
    b = items.select(F.col("id").alias("item_id"), F.col("node").alias("item_node"), "n_words", "pos", "width", "hash", "template", F.col("words").alias("b"))
    both = d.join(b, ["width", "hash", "template"])
    # A diagonal holds each window of an item once at most in each reading, so what is gathered is bounded by it.
    diagonal = both.groupBy(*_PAIR, (F.col("doc_pos") - F.col("pos")).alias("shift")).agg(
        F.collect_set(F.struct("pos", "b", "d", "template")).alias("found")
    )
    judged = diagonal.drop("shift").mapInArrow(
        _judged, "doc_id long, node binary, item_id long, item_node binary, n_words int, covered array<int>, changed boolean"
    )
    # Copies in one document cover the same words mostly, and an item has few positions.
    pair = judged.filter(F.size("covered") > 0).groupBy(*_PAIR).agg(
        F.max(F.size("covered")).alias("longest"),
        F.count_if(~F.col("changed")).alias("_same"),
        F.collect_set("covered").alias("_covered"),
    )
    coverage = F.size(F.array_distinct(F.flatten("_covered"))) / F.col("n_words")
    return pair.select(
        *_PAIR, "longest", coverage.alias("coverage"),
        (F.col("_same") == 0).alias("reparameterised"),
    ).filter((F.col("longest") >= RUN) | (F.col("coverage") >= COVERAGE))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay.

    Rows that share a doc_id are one document and go together. A null doc_id names none: of such rows
    those go whose own text is contaminated.
    """
    found = _pairs(docs.select("doc_id", "text"), benchmark)
    named = F.col("doc_id").isNotNull()
    hit = found.select(F.col("doc_id").alias("_hit"), F.when(~named, F.col("node")).alias("_node")).distinct()
    # Rows travel whole, so that no column of theirs meets one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    doc_id = F.col("_row.doc_id")
    text = F.when(doc_id.isNull(), _node(whole_text("_row.text")))
    # Written, so that its size tells Spark how to meet it: what is clean is mostly not moved.
    hit = Stage(docs.sparkSession, "decontamination").save(hit, "hits")
    same = doc_id.cast("long").eqNullSafe(F.col("_hit")) & text.eqNullSafe(F.col("_node"))
    return rows.join(hit, same, "left_anti").select("_row.*")
