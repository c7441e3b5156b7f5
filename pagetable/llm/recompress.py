"""Removal of repeated passages by recompression.

Words are symbols. In each round a symbol joins its neighbour where both are equal (runs) or where
the left one is named to a left and the right one to a right side (pairs), and what joins gets a
name. Names come from the words alone, the same everywhere, so rounds need no exchange; and whether
two symbols join depends on these two alone, so equal passages get the same symbols but near their ends. How
near is kept for every symbol: the words that settle it. Any window of ``WIDTH`` words contains settled symbols;
the one of least hash at the highest level is its anchor, and equal windows have equal anchors.

Neighbouring windows with one anchor are a group. Spark meets groups by anchor: one that stands
alone has no repeat. Groups equal throughout repeat window by window. Where an anchor has different groups,
as at the ends of a repeat, the windows of each group's first place are compared one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import (
    flat_lists, mix, runs_of, spot_map, whole_text, window_hashes, windows, with_spotted, word_hashes,
)
from pagetable.session import Stage

WIDTH = 20
ROUNDS = 2
GAP = r"[\x20\x09-\x0D]+"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_ID = -(2**63)  # stands for a null doc_id, which comes before all others; no doc_id may be it


class _Spans:
    """Hashes of any span of words, from running sums of a polynomial over 64-bit numbers."""

    def __init__(self, words: np.ndarray) -> None:
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xF1DE83E19937733D)
        n = len(words)
        powers = np.multiply.accumulate(np.full(n, base, np.uint64)) if n else words
        self._back = np.append(np.uint64(1), np.multiply.accumulate(np.full(n, inverse, np.uint64)))
        self._sums = np.append(np.uint64(0), np.cumsum(mix(words) * powers, dtype=np.uint64))

    def hash(self, start: np.ndarray, end: np.ndarray, extra: np.ndarray | int = 0) -> np.ndarray:
        whole = (self._sums[end] - self._sums[start]) * self._back[start]
        length = (end - start).astype(np.uint64)
        return mix(mix(whole + length) + np.asarray(extra, np.uint64))


def _levels(words: np.ndarray, row: np.ndarray, spans: _Spans, rounds: int):
    """Per level, the symbols that a context inside their text settles: that context and the name."""
    start = np.arange(len(words))
    end = start + 1
    low, high = start.copy(), end.copy()  # the words that settle a symbol
    name = mix(words)
    out = [(low, high, name)]
    for turn in range(rounds):
        if not len(start):
            break
        same_text = row[start[1:]] == row[start[:-1]]
        side = (mix(name + np.uint64(turn + 1)) >> np.uint64(17)) & np.uint64(1)
        joins = same_text & ((name[1:] == name[:-1]) | ((side[:-1] == 0) & (side[1:] == 1)))
        first = np.flatnonzero(np.append(True, ~joins))
        last = np.append(first[1:], len(start)) - 1
        # A symbol is settled by its neighbours too; at the edge of a text it never is.
        inner = np.append(False, same_text)[first] & np.append(same_text, False)[last]
        before, behind = np.maximum(first - 1, 0), np.minimum(last + 1, len(start) - 1)
        low = np.where(inner, low[before], -1)
        high = np.where(inner, high[behind], -1)
        # Contexts of neighbours at an edge are open as well.
        open_ = (low < 0) | (high < 0)
        start, end = start[first], end[last]
        name = spans.hash(start, end, turn + 1)
        low, high = np.where(open_, -1, low), np.where(open_, -1, high)
        out.append((low, high, name))
    return out


def _least(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of the least key in each range, the leftmost of equal ones."""
    tables, size = [np.arange(len(keys))], 1
    widest = int((right - left).max()) + 1 if len(left) else 1
    while size * 2 <= widest:
        a, b = tables[-1][:-size], tables[-1][size:]
        tables.append(np.where(keys[a] <= keys[b], a, b))
        size *= 2
    out = np.zeros(len(left), np.int64)
    step = np.floor(np.log2(right - left + 1)).astype(np.int64)
    for k, table in enumerate(tables):
        at = np.flatnonzero(step == k)
        a, b = table[left[at]], table[right[at] - (1 << k) + 1]
        out[at] = np.where(keys[a] <= keys[b], a, b)
    return out


def groups(words: np.ndarray, offsets: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS):
    """Groups of windows with one anchor: ``anchor, content, row, start, count``, in order."""
    words = words.view(np.uint64)
    starts, row_of = windows(words, offsets, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    spans = _Spans(words)
    anchor_low = np.full(len(starts), -1, np.int64)
    anchor_high = np.zeros(len(starts), np.int64)
    level_of = np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    n = len(words)
    for level, (low, high, name) in reversed(list(enumerate(_levels(words, row, spans, rounds)))):
        fits = (low >= 0) & (high - low <= width)
        low, high, keys = low[fits], high[fits], mix(name[fits] + np.uint64(77))
        # Contexts begin and end in order, so the settled symbols of a window are a range.
        begun = np.append(0, np.cumsum(np.bincount(low, minlength=n + 1)))
        ended = np.cumsum(np.bincount(high, minlength=n + 1))
        at = starts[open_]
        left, right = begun[at], ended[at + width] - 1
        has = right >= left
        got, left, right = open_[has], left[has], right[has]
        if len(got):
            best = _least(keys, left, right)
            anchor_low[got], anchor_high[got], level_of[got] = low[best], high[best], level
        open_ = open_[~has]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    # The context's start tells neighbouring anchors of one level apart.
    change = np.append(True, (anchor_low[1:] != anchor_low[:-1]) | (anchor_high[1:] != anchor_high[:-1])
                       | (level_of[1:] != level_of[:-1]) | (row_of[1:] != row_of[:-1]))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + width
    anchor = spans.hash(anchor_low[first], anchor_high[first], level_of[first] + 1000)
    content = spans.hash(begin, end, (anchor_low[first] - begin).astype(np.uint64) + np.uint64(2000))
    text = row_of[first]
    return anchor.view(np.int64), content.view(np.int64), text, begin - offsets[text], last - first + 1


def _keyed(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``id, p1, p2, text``: a row's place in the order, and what tells rows of one doc_id apart.

    That is 128 bits of the text's hash where the id is in ``shared``, the map of repeated ids, else zero, which costs
    nothing to move. Rows of one id and one text are the same in every way and need not be told apart.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), whole_text().alias("text")
    )
    rows = with_spotted(rows, F.col("id"), shared)
    digest = F.when(F.col("_spotted"), F.md5("text"))
    half = lambda at: F.coalesce(F.conv(F.substring(digest, at, 16), 16, -10).cast("long"), F.lit(0).cast("long"))
    return rows.select("id", half(1).alias("p1"), half(17).alias("p2"), "text")


def _shared_ids(docs: DataFrame, stage: Stage) -> DataFrame:
    """The map of doc_ids that several rows have."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("mark"))
    return stage.save(spot_map(ids.groupBy("mark").count().filter("count > 1").select("mark")), "shared")


_ROW = ["id", "p1", "p2"]


def _words(text: Column) -> Column:
    return word_hashes(runs_of(text, GAP))


def group_rows(keyed: DataFrame) -> DataFrame:
    """One row per group, or the first of equal groups of a batch; ``anchor`` is null for the rest.

    So a passage in very many documents is one row per batch for whatever comes after. The rest
    have an equal group at an earlier place: all their windows are repeats.
    """

    def cut(batches):
        for batch in batches:
            words, offsets = flat_lists(batch["words"])
            anchor, content, row, start, count = groups(words, offsets)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            tells = [batch[c].to_numpy(zero_copy_only=False) for c in ("p1", "p2")]
            order = np.lexsort((start, ids[row], content, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            # Rows stay in the order of their texts: places next to each other compress well.
            later = np.zeros(len(order), bool)
            later[order] = (ids[row[order]] != ids[row[head]]) | (start[order] != start[head])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor, mask=later), pa.array(content, mask=later), pa.array(ids[row]),
                    *[pa.array(t[row]) for t in tells], pa.array(start.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["anchor", "content", *_ROW, "start", "count"],
            )

    rows = keyed.select(*_ROW, _words(F.col("text")).alias("words"))
    return rows.mapInArrow(cut, "anchor long, content long, id long, p1 long, p2 long, start int, count int")


def _met(rows: DataFrame) -> DataFrame:
    """Groups whose anchor stands at several places: ``repeated``, and whether to ``compare`` windows.

    All steps use one exchange by anchor.
    """
    dealt = rows.filter(F.col("anchor").isNotNull()).repartition("anchor")
    shared = dealt.groupBy("anchor").agg(
        F.count("*").alias("_n"), (F.min("content") != F.max("content")).alias("_several")
    ).filter("_n > 1")
    both = dealt.join(shared.drop("_n").hint("shuffle_hash"), "anchor")
    place = F.struct("id", "start")
    first = both.groupBy("anchor", "content").agg(F.min(place).alias("_first"))
    told = both.join(first, ["anchor", "content"])
    return told.select(
        *_ROW, "start", "count",
        (place > F.col("_first")).alias("repeated"),
        (F.col("_several") & (place <= F.col("_first"))).alias("compare"),
    ).filter("repeated OR compare")


def _repeated_windows(keyed: DataFrame, compare: DataFrame) -> DataFrame:
    """Single windows of the groups to compare that also start earlier."""
    asked = compare.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "count")).alias("_ranges"))
    rows = keyed.join(asked, _ROW).select(
        *_ROW, _words(F.col("text")).alias("words"),
        F.col("_ranges.start").alias("starts"), F.col("_ranges.count").alias("counts"),
    )

    def cut(batches):
        for batch in batches:
            words, offsets = flat_lists(batch["words"])
            starts, bounds = flat_lists(batch["starts"])
            counts, _ = flat_lists(batch["counts"])
            row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(bounds)), counts)
            begun = np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(starts, counts) + np.arange(len(row)) - begun
            at = start + offsets[row]
            ids = batch["id"].to_numpy(zero_copy_only=False)
            tells = [batch[c].to_numpy(zero_copy_only=False)[row] for c in ("p1", "p2")]
            hashes = [window_hashes(words.view(np.uint64), at, WIDTH, seed).view(np.int64) for seed in (3, 4)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, hashes), pa.array(ids[row]), *map(pa.array, tells), pa.array(start.astype(np.int32))],
                ["h1", "h2", *_ROW, "start"],
            )

    cuts = rows.mapInArrow(cut, "h1 long, h2 long, id long, p1 long, p2 long, start int").repartition("h1")
    place = F.struct("id", "start")
    first = cuts.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    several = first.filter("_first != _last").drop("_last")
    met = cuts.join(several, ["h1", "h2"]).filter(place > F.col("_first"))
    return met.select(*_ROW, "start", F.lit(1).alias("count"))


def repeats(keyed: DataFrame, stage: Stage) -> DataFrame:
    """``id, p1, p2, marks``: starts and counts of the repeated windows of each document that has any."""
    rows = stage.save(group_rows(keyed), "groups")
    met = stage.save(_met(rows), "met")
    single = _repeated_windows(keyed, met.filter("compare"))
    place = [*_ROW, "start", "count"]
    marks = rows.filter(F.col("anchor").isNull()).select(*place)
    marks = marks.union(met.filter("repeated").select(*place)).union(single.select(*place))
    return marks.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "count")).alias("marks"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs`` (``doc_id, text``).

    A word goes if a window of ``WIDTH`` words that covers it also starts earlier: in a smaller doc_id,
    or before in the same document. ``kept`` has the other words, one space between them. A null text has no
    words. Rows of one doc_id are one document in several versions: windows at the same start are
    no earlier than each other. A null doc_id comes before all others. Windows are compared by 128 bits of hash.
    """
    stage = Stage(docs.sparkSession, "recompression")
    docs = docs.select("doc_id", "text")
    keyed = _keyed(docs, _shared_ids(docs, stage))
    marks = repeats(keyed, stage)
    # The same columns as where windows are compared, so that one exchange of texts serves both.
    rows = keyed.join(marks, _ROW, "left")
    rows = rows.withColumn("doc_id", F.nullif("id", F.lit(_NO_ID)))

    @F.pandas_udf("string")
    def cleared(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for text, start, count in zip(texts, starts, counts):
            if text is None or start is None:
                out.append(None)
                continue
            words = _WORD.findall(text)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + (WIDTH - 1), -1)
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            out.append(" ".join([words[i] for i in keep]))
        return pd.Series(out, dtype=object)

    # A text without repeats is not sent to Python; only its words are put together.
    marked = F.when(F.col("marks").isNotNull(), F.col("text"))
    rows = rows.select(
        "doc_id", "text", "marks", cleared(marked, F.col("marks.start"), F.col("marks.count")).alias("_cleared")
    )
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.when(F.col("marks").isNull(), F.array_join(runs_of(F.col("text"), GAP), " "))
        .otherwise(F.col("_cleared")).alias("kept"),
    ).select(
        "doc_id", "n_words",
        (F.col("n_words") - F.when(F.col("kept") == "", 0).otherwise(F.regexp_count("kept", F.lit(" ")) + 1))
        .cast("long").alias("n_removed"),
        "kept",
    )


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
