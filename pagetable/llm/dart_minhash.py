"""Near-duplicate documents by DartMinHash (Christiani, 2020) and banded joining.

A document is the weighted set of its five-word shingles. Every shingle owns a region of the plane,
its weight by the axis of ranks, into which hashed darts fall at unit density; a dart is the same
for all documents that reach it. Each dart names a coordinate, and a coordinate keeps its dart of
least rank. Two sketches agree at a coordinate with the chance that is their weighted Jaccard
similarity. Documents that agree in all coordinates of a band meet in a bucket, and what meets is
verified on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import flat_lists, mix, runs_of, sole, whole_text, window_hashes, windows, word_hashes
from pagetable.llm.components import components
from pagetable.session import Stage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4  # a pair at 0.8 is missed with a chance of 3 in 100,000
FIRST_BANDS = 2  # bands in which all members are compared with their bucket's hub
PAIRED = 16  # members of a bucket up to which those not linked yet are compared as pairs
BLOCK = 1024  # members of a larger bucket that meet another block at once
GAP = r"[^\p{L}\p{N}]+"


def weighted_shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row with their counts: ``shingle, count, row``, ordered by row.

    A row of fewer than ``WORDS`` words is one shingle, one without words has none.
    """
    hashes = hashes.view(np.uint64)
    starts, row = windows(hashes, offsets, WORDS)
    values = window_hashes(hashes, starts, WORDS, 5)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WORDS))
    for i in short:
        words = hashes[offsets[i] : offsets[i + 1]]
        values = np.append(values, window_hashes(words, np.zeros(1, np.int64), len(words), 50 + len(words)))
    row = np.append(row, short)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if not len(values):
        return values, np.zeros(0, np.int64), row
    first = np.append(True, (values[1:] != values[:-1]) | (row[1:] != row[:-1]))
    at = np.flatnonzero(first)
    return values[at], np.diff(np.append(at, len(values))), row[at]


def sketches(shingles: np.ndarray, counts: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """DartMinHash sketches, ``n_rows`` by ``k``; rows without shingles stay 0.

    Darts of a region are drawn in order of rank by exponential gaps, so they do not depend on how
    far a document has to look. A row looks up to the rank at which about ``k (log k + 4)`` darts
    have hit it, and twice as far if a coordinate is still empty then.
    """
    out = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, counts, n_rows)
    with np.errstate(divide="ignore"):
        reach = np.where(total > 0, k * (math.log(k) + 4) / total, 0)
    todo = total > 0
    while todo.any():
        use = todo[row]
        best, value = _throw(shingles[use], counts[use].astype(np.float64), row[use], reach, n_rows, k)
        full = todo & np.isfinite(best).all(1)
        out[full] = value[full]
        todo &= ~full
        reach = reach * 2
    return out


def _throw(shingles, weights, row, reach, n_rows, k):
    best, value = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, np.uint64)
    # Weights are cut at powers of two: a region from 0 to 1, one from 1 to 2, from 2 to 4 and so on.
    level = 0
    while len(shingles):
        low, size = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        has = weights > low
        shingles, weights, row = shingles[has], weights[has], row[has]
        base, w, r = mix(shingles + np.uint64(level * 0x9E37)), weights, row
        rank, dart = np.zeros(len(base)), 0
        while len(base):
            h = mix(base + np.uint64(dart * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / size
            near = rank < reach[r]
            base, w, r, rank, h = base[near], w[near], r[near], rank[near], h[near]
            place = mix(h)
            hit = low + size * ((place >> np.uint64(11)).astype(np.float64) * 2.0**-53) < w
            at = r[hit] * k + (mix(place[hit]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, rank[hit])
            won = best[at] == rank[hit]
            value[at[won]] = h[hit][won]
            dart += 1
        level += 1
    return best.reshape(n_rows, k), value.reshape(n_rows, k)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :]
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _hashed(text: Column) -> Column:
    return word_hashes(runs_of(F.lower(text), GAP))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, node, size, bands`` per row; ``node`` is one for equal texts. Map-only.

    ``size`` is the number of shingles, ``bands`` the band keys in order.
    """

    def sketched(batches):
        sole("near duplicates")
        for batch in batches:
            hashes, offsets = flat_lists(batch["words"])
            n = batch.num_rows
            sketch = sketches(*weighted_shingles(hashes, offsets), n, BANDS * ROWS)
            keys = band_keys(sketch)
            some = np.diff(offsets) > 0
            ends = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
            size = np.where(some, np.maximum(np.diff(offsets) - WORDS + 1, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["node"], pa.array(size.astype(np.int32)), bands],
                ["doc_id", "node", "size", "bands"],
            )

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node(text).alias("node"), _hashed(text).alias("words"))
    return rows.mapInArrow(sketched, "doc_id long, node binary, size int, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, items``: a text's shingles, each with the number of its copy, as 32-bit hashes.

    With a copy's number in the hash the weighted similarity is that of plain sets. Two sets of a
    thousand items are off by one with a chance of one in 4,000.
    """

    def listed(batches):
        sole("near duplicates")
        for batch in batches:
            hashes, offsets = flat_lists(batch["words"])
            shingles, counts, row = weighted_shingles(hashes, offsets)
            copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            items = (mix(np.repeat(shingles, counts) + copy.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
            ends = np.append(0, np.cumsum(np.bincount(np.repeat(row, counts), minlength=batch.num_rows))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(items.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["node"], lists], ["node", "items"])

    rows = texts.select("node", _hashed(F.col("text")).alias("words"))
    return rows.mapInArrow(listed, "node binary, items array<int>")


class _Links:
    """Verified links between different texts, found from buckets step by step."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, stage: Stage) -> None:
        self._docs, self._nodes, self._stage = docs, nodes, stage
        self.found: DataFrame | None = None
        self._turn = 0

    def _name(self, what: str) -> str:
        self._turn += 1
        return f"{what}-{self._turn}"

    def load_sets(self, members: DataFrame) -> None:
        """Sets of the texts that share a bucket, each from one of its documents."""
        wanted = members.select("node").distinct().join(self._nodes.select("node", "doc_id"), "node")
        text = self._docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), _node(whole_text()).alias("node"),
            whole_text().alias("text"),
        )
        one = wanted.select("node", F.col("doc_id").alias("_id"))
        texts = text.join(one, (text["node"] == one["node"]) & text["doc_id"].eqNullSafe(one["_id"]), "left_semi")
        # Rows alike in doc_id and text would give a set twice.
        self.sets = self._stage.save(shingle_sets(texts).dropDuplicates(["node"]), "sets")

    def add(self, pairs: DataFrame) -> None:
        """Verifies candidate pairs ``a, b`` and keeps those similar enough."""
        left = self.sets.select(F.col("node").alias("a"), F.col("items").alias("_x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))
        both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("_x", "_y"))
        n = F.size(F.array_distinct("_x")) + F.size(F.array_distinct("_y"))
        self.add_verified(both.filter(shared >= SIMILARITY * (n - shared)).select("a", "b"))

    def add_verified(self, links: DataFrame) -> None:
        good = self._stage.save(links, self._name("links"))
        self.found = good if self.found is None else self.found.union(good)

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, with ``label`` and the bucket's ``met``."""
        labels = components(self.found.distinct(), self._stage, self._name("labels"))
        known = members.join(labels.select("node", F.col("label").alias("_label")), "node", "left")
        known = known.withColumn("label", F.coalesce("_label", "node")).drop("_label")
        mixed = known.groupBy("key").agg(
            F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("met")
        ).filter("_a != _b").select("key", "met")
        return self._stage.save(known.join(mixed, "key"), self._name("mixed"))


def _stars(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub, if they are not in one component yet.

    The hub is the member that meets most others in all its buckets: the text that copies are nearest to.
    """
    hub = members.groupBy("key").agg(F.min(F.struct(-F.col("fame"), F.col("node"), F.col("label"))).alias("_h"))
    hub = hub.select(F.col("key").alias("_key"), F.col("_h.node").alias("b"), F.col("_h.label").alias("_other"))
    met = members.join(hub, (F.col("key") == F.col("_key")) & (F.col("label") != F.col("_other")))
    return met.select(F.col("node").alias("a"), "b")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs of members of one bucket in different components whose sizes allow the similarity."""
    other = members.select("key", F.col("node").alias("b"), F.col("label").alias("_other"), F.col("size").alias("_size"))
    met = members.join(other, "key").filter(
        "node < b AND label != _other"
        f" AND least(size, _size) >= {SIMILARITY} * greatest(size, _size)"
    )
    return met.select(F.col("node").alias("a"), "b")


def _by_size(members: DataFrame) -> DataFrame:
    """Buckets cut by size. A member stands in its own class and the next, each a factor of ``1 / SIMILARITY`` wide,
    so two that may be similar meet."""
    own = F.floor(F.log("size") / math.log(1 / SIMILARITY) + 1e-9)
    classed = members.withColumn("_class", F.explode(F.array(own, own + 1)))
    return classed.withColumn("key", F.xxhash64("key", "_class")).drop("_class")


def links_within(labels: list, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Similar pairs that connect the labels of a bucket: no more than there are labels.

    Shared items of all pairs come from products of the members' incidence matrix, some columns at a
    time; items that one member alone has add nothing and are left out.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float32)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    common = times[column] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        there = np.zeros((n, width), np.float32)
        there[row[part], column[part] - low] = 1
        shared += there @ there.T
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-4
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components in large buckets: every two members are compared, no pairs are written.

    A bucket of more than ``BLOCK`` members is cut into blocks by hash, and every two blocks meet in a
    task, so a task holds at most about two blocks of sets.
    """
    n = F.ceil(F.col("met") / BLOCK).cast("int")
    mine = members.withColumn("_n", n).withColumn("_block", F.pmod(F.xxhash64("node", "key"), F.col("_n")).cast("int"))
    faced = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = faced.select(
        "key", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "node", "label"
    ).join(sets, "node")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = [bytes(x) for x in pdf["node"]]
        found = links_within([bytes(x) for x in pdf["label"]], [np.unique(x) for x in pdf["items"]])
        return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, columns=["a", "b"])

    return dealt.groupBy("key", "_i", "_j").applyInPandas(link, "a binary, b binary")


def link_texts(docs: DataFrame, signed: DataFrame, stage: Stage) -> DataFrame:
    """Links ``a, b`` between different texts, enough that every similar pair is connected.

    The members of a bucket are first compared with its hub, in two bands and then, where a bucket still
    holds several components, in all. Near copies are thereby in one component after few comparisons
    each, whatever their number. In buckets that are mixed even then, members of different components
    whose sizes allow it are compared with each other: as pairs where at most ``PAIRED`` meet, so no
    member has more partners than that, and block by block, without writing pairs, in larger ones.
    """
    nodes = stage.save(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("bands").alias("bands")
        ),
        "nodes",
    )
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    met = members.groupBy("key").agg(F.count("*").alias("_met")).filter("_met > 1")
    members = stage.save(members.join(met, "key"), "met")
    fame = members.groupBy("node").agg(F.sum("_met").alias("fame"))
    members = stage.save(members.drop("_met").join(fame, "node"), "members")
    links = _Links(docs, nodes, stage)
    links.load_sets(members)
    links.add(_stars(members.filter(F.col("band") < FIRST_BANDS).withColumn("label", F.col("node"))))
    members = members.drop("band")
    links.add(_stars(links.labelled(members)))
    mixed = links.labelled(_by_size(members))
    links.add(_pairs(mixed.filter(F.col("met") <= PAIRED)))
    links.add_verified(_in_blocks(mixed.filter(F.col("met") > PAIRED), links.sets))
    return links.found.distinct()


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` per row, and ``node, label, class_id`` per different text."""
    stage = Stage(docs.sparkSession, "near-duplicates")
    docs = docs.select("doc_id", "text")
    signed = stage.save(signatures(docs), "signed")
    found = stage.save(link_texts(docs, signed, stage), "all-links")
    labels = components(found, stage, "final")
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("_first"))
    grouped = texts.join(labels, "node", "left")
    grouped = stage.save(grouped.withColumn("label", F.coalesce("label", "node")), "grouped")
    classes = grouped.groupBy("label").agg(F.min("_first").alias("class_id"))
    known = grouped.join(classes, "label").select("node", "label", "class_id")
    return signed.select("doc_id", "node"), known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, keep`` for every row of ``docs`` (``doc_id, text``).

    ``class_id`` is the least doc_id of the documents that are connected by a similarity of at least 0.8
    in weighted five-word shingles; equal texts, empty and null ones among them, are always in one
    class. ``keep`` marks the document that stands for its class. Links are compared only as far as classes
    need, so how many similar texts a document has is not known and not returned. Words are runs of letters and digits in lower case. A row with
    a null doc_id gets its class and is kept only if no row of the class has a doc_id.
    """
    rows, known = _classified(docs)
    return rows.join(known, "node").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, with all its columns.

    It is a row of the class's least doc_id (of any, where none has one) and then of the text of least digest;
    of several rows alike in both, one stays.
    """
    rows, known = _classified(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    counted = rows.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    chosen = counted.join(known.select("node", "label"), "node").groupBy("label").agg(
        F.min_by(F.struct("doc_id", "node", "n"), order).alias("_c")
    )
    chosen = chosen.select(F.col("_c.doc_id").alias("_id"), F.col("_c.node").alias("_node"), F.col("_c.n").alias("_n"))
    text = F.struct("*").alias("_row")
    keyed = docs.select(text, F.col("doc_id").cast("long").alias("_doc"), _node(whole_text()).alias("_text"))
    same = (F.col("_text") == F.col("_node")) & F.col("_doc").eqNullSafe(F.col("_id"))
    kept = keyed.join(chosen, same, "left_semi")
    if chosen.filter("_n > 1").isEmpty():
        return kept.select("_row.*")
    return kept.dropDuplicates(["_doc", "_text"]).select("_row.*")
