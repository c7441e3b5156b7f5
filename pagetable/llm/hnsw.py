"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Different vectors are dealt to shards of bounded size by hash. Each shard's graph is built by one task and
kept as a row of flat arrays: vectors, neighbours of the lowest layer (``WIDE`` per vector, -1 where
there are fewer), and neighbours of the upper layers. Queries go to all shards in blocks; what the
shards find is merged by distance in double precision.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagetable.llm.common import mix
from pagetable.session import Stage

SHARD = 4096  # vectors of a shard, about
BLOCK = 1024  # queries that meet a shard at once, about
NARROW, WIDE = 16, 32  # neighbours in upper layers and in the lowest
BUILD, SEARCH = 64, 96  # candidates kept while building and searching
K = 10

_INDEX = "shard long, dim int, n int, entry int, top int, vectors binary, near binary, upper binary, upper_at binary, ids array<array<long>>"


class Graph:
    """A shard's graph over flat arrays."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, entry: int, top: int) -> None:
        self.vectors, self.near, self.upper, self.upper_at = vectors, near, upper, upper_at
        self.entry, self.top = entry, top

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Inserts vectors in order. A vector's highest layer comes from a hash of its content."""
        n = len(vectors)
        words = np.ascontiguousarray(vectors, np.float64).view(np.uint64)
        seed = np.zeros(n, np.uint64)
        for column in words.T:
            seed = mix(seed * np.uint64(31) + column + np.uint64(1))
        unit = ((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        layers = np.floor(-np.log(unit) / math.log(NARROW)).astype(np.int64)
        upper_at = np.append(0, np.cumsum(layers))
        graph = cls(vectors, np.full((n, WIDE), -1, np.int32), np.full((upper_at[-1], NARROW), -1, np.int32), upper_at, 0, int(layers[0]) if n else 0)
        graph._sizes = np.zeros(n, np.int32)
        graph._upper_sizes = np.zeros(upper_at[-1], np.int32)
        for i in range(1, n):
            graph._insert(i, int(layers[i]))
        return graph

    def _row(self, i: int, layer: int) -> np.ndarray:
        return self.near[i] if layer == 0 else self.upper[self.upper_at[i] + layer - 1]

    def _distances(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = self.vectors[at] - q
        return np.einsum("ij,ij->i", gap, gap)

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, keep: int) -> list[tuple[float, int]]:
        """The ``keep`` nearest found from the starting points, as (distance, vector), unordered."""
        seen = bytearray(len(self.vectors))
        for _, i in start:
            seen[i] = 1
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= keep and d > -best[0][0]:
                break
            fresh = [j for j in self._row(i, layer).tolist() if j >= 0 and not seen[j]]
            if not fresh:
                continue
            for j in fresh:
                seen[j] = 1
            for d, j in zip(self._distances(np.array(fresh), q).tolist(), fresh):
                if len(best) < keep:
                    heapq.heappush(best, (-d, j))
                    heapq.heappush(ahead, (d, j))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, j))
                    heapq.heappush(ahead, (d, j))
        return [(-d, i) for d, i in best]

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` neighbours, near ones first, none nearer to one taken than to the centre;
        free places go to the nearest of the rest."""
        found = sorted(found)
        if len(found) <= most:
            return [i for _, i in found]
        at = np.array([i for _, i in found])
        # Products lose what is small beside a common offset; near vectors have none around the nearest.
        v = self.vectors[at] - self.vectors[at[0]]
        square = np.einsum("ij,ij->i", v, v)
        between = square[:, None] + square[None, :] - 2 * (v @ v.T)
        taken, left = [], []
        nearest = np.full(len(at), np.inf)
        for k, (d, _) in enumerate(found):
            if len(taken) == most:
                break
            if d < nearest[k]:
                taken.append(k)
                nearest = np.minimum(nearest, between[k])
            else:
                left.append(k)
        return [int(at[k]) for k in (taken + left)[:most]]

    def _link(self, i: int, j: int, layer: int) -> None:
        row = self._row(i, layer)
        sizes, place = (self._sizes, i) if layer == 0 else (self._upper_sizes, self.upper_at[i] + layer - 1)
        n = sizes[place]
        if n < len(row):
            row[n] = j
            sizes[place] = n + 1
            return
        at = np.append(row, np.int32(j))
        kept = self._spread(list(zip(self._distances(at, self.vectors[i]).tolist(), at.tolist())), len(row))
        row[:] = kept

    def _insert(self, i: int, layer: int) -> None:
        q = self.vectors[i]
        found = [(float(self._distances(np.array([self.entry]), q)[0]), self.entry)]
        for above in range(self.top, layer, -1):
            found = self._walk(q, found, above, 1)
        for at in range(min(layer, self.top), -1, -1):
            found = self._walk(q, found, at, BUILD)
            for j in self._spread(found, NARROW):
                self._link(i, j, at)
                self._link(j, i, at)
        if layer > self.top:
            self.top, self.entry = layer, i

    def search(self, q: np.ndarray, k: int) -> list[int]:
        """All that the search keeps, at least ``k`` where there are as many."""
        if not len(self.vectors):
            return []
        found = [(float(self._distances(np.array([self.entry]), q)[0]), self.entry)]
        for above in range(self.top, 0, -1):
            found = self._walk(q, found, above, 1)
        return [i for _, i in self._walk(q, found, 0, max(SEARCH, k))]


def _scaled(vectors: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Vectors in double precision, smaller by a power of two where squares of the shard's would overflow."""
    largest = float(np.abs(shard).max()) if shard.size else 0.0
    return vectors if largest < 1e150 else vectors * 2.0**-560


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of rows that take part: a vec_id and a vector without null, non-finite or
    all-zero components; equal rows once."""
    limit = F.lit(float("inf"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(whole & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def build(rows: DataFrame, stage: Stage, k: int = K) -> tuple[DataFrame, int]:
    """One row per shard, from ``vec_id, embedding``, and the number of shards per vector length.

    A vector that many rows share is indexed once, with its ``k + 1`` smallest ids: more of them cannot be
    among a query's ``k`` nearest. Tasks cut the rest of a shared vector's ids before the shuffle.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1)
    points = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stage.save(points, "points")
    n_shards = max(1, -(-points.count() // SHARD))
    # Vectors of different lengths have no distance, so they share no shard.
    dealt = points.withColumn("dim", F.size("embedding")).withColumn(
        "shard", F.pmod(F.xxhash64("embedding"), F.lit(n_shards)) + F.col("dim").cast("long") * n_shards
    )

    def graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), kind="stable")
        exact = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        made = Graph.build(_scaled(exact, exact))
        return pd.DataFrame({
            "shard": [key[0]], "dim": [exact.shape[1]], "n": [len(exact)], "entry": [made.entry],
            "top": [made.top], "vectors": [exact.tobytes()], "near": [made.near.tobytes()],
            "upper": [made.upper.tobytes()], "upper_at": [made.upper_at.tobytes()],
            "ids": [[list(map(int, x)) for x in pdf["ids"]]],
        })

    return stage.save(dealt.groupBy("shard").applyInPandas(graph, _INDEX), "index"), n_shards


def search(
    index: DataFrame, n_shards: int, queries: DataFrame, n_queries: int, k: int = K
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first.

    A query's own id is no candidate. Ties go to the smaller vec_id. A block of queries meets a shard in one
    task, and a vector that several queries of a block share is searched once.
    """
    n_blocks = max(1, -(-n_queries // BLOCK))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    first = F.size("embedding").cast("long") * n_shards
    asked = queries.select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("to_block"),
        F.explode(F.sequence(first, first + (n_shards - 1))).alias("to_shard"),
    )
    shards = index.select("*", blocks)

    def find(key: tuple, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(shard) and len(block):
            s = shard.iloc[0]
            exact = np.frombuffer(s["vectors"], np.float64).reshape(s["n"], s["dim"])
            graph = Graph(
                _scaled(exact, exact), np.frombuffer(s["near"], np.int32).reshape(-1, WIDE),
                np.frombuffer(s["upper"], np.int32).reshape(-1, NARROW),
                np.frombuffer(s["upper_at"], np.int64), s["entry"], s["top"],
            )
            found: dict[bytes, list[tuple[float, int]]] = {}
            for query, vector in zip(block["query_id"], block["embedding"]):
                q = np.asarray(vector, np.float64)
                hits = found.get(q.tobytes())
                if hits is None:
                    near = graph.search(_scaled(q, exact), k + 1)
                    far = np.sqrt(np.square(exact[near] - q).sum(1))
                    hits = sorted((float(d), int(v)) for d, i in zip(far, near) for v in s["ids"][i])
                    found[q.tobytes()] = hits
                out += [(query, v, d) for d, v in hits[: k + 1] if v != query][:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    met = shards.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block")).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The ``k`` nearest of every query among all other rows of ``vec_id, embedding``.

    Rows without a usable vector neither ask nor answer, equal rows count once, and an empty table gives no rows. Several
    different vectors of one vec_id are each a candidate, but not for a query of that vec_id; a query with several is
    asked with each and keeps the nearest. Distances are of doubles throughout.
    """
    stage = Stage(vectors.sparkSession, "hnsw")
    rows = stage.save(usable(vectors), "rows")
    queries = rows.filter(is_query).distinct()
    return search(*build(rows, stage, k), queries, queries.count(), k)
