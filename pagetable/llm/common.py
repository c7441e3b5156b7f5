"""What several of the operators need: whole texts, word arrays and flat word hashes."""

from __future__ import annotations

import ctypes
import gc
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagetable.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def runs_of(text: Column, gap: str) -> Column:
    """The runs of ``text`` between matches of the pattern ``gap``, without empty ones."""
    return F.filter(F.split(text, gap), lambda w: w != "")


SPOT_WORDS = 1 << 18  # 64-bit words of a map of marks: 2 MB, whatever the number of marks


def spot(mark: Column) -> Column:
    return F.pmod(F.xxhash64(mark), F.lit(SPOT_WORDS * 64))


def spot_map(marks: DataFrame) -> DataFrame:
    """``_word, _bits`` of the spots of ``mark``: a table of bounded size that may be broadcast."""
    spots = marks.select(spot(F.col("mark")).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    return spots.groupBy(F.expr("spot div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def with_spotted(rows: DataFrame, mark: Column, spots: DataFrame) -> DataFrame:
    """Adds ``_spotted``: whether the mark is in the map. True for all marks of the map and few others."""
    found = rows.withColumn("_spot", spot(mark)).withColumn("_word", F.expr("_spot div 64"))
    found = found.join(F.broadcast(spots), "_word", "left")
    hit = F.expr("shiftright(_bits, cast(_spot % 64 as int)) & 1") == 1
    return found.withColumn("_spotted", F.coalesce(hit, F.lit(False))).drop("_spot", "_word", "_bits")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and where each row's values start (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


MEMORY_BYTES = 48 << 20  # what one kind of memory of a worker may hold


class Memory(dict):
    """What a worker remembers from one text to the next, bounded by bytes.

    Workers outlive tasks and serve one operator after another, so operators hold few of these and
    :func:`sole` empties those of the operator before.
    """

    # One is itself alone, so that a set of them compares no entries.
    __hash__, __eq__, __ne__ = object.__hash__, object.__eq__, object.__ne__
    _PER_ENTRY = 170  # of the table, the two objects' heads and what the allocator adds

    def __init__(self, most: int = MEMORY_BYTES, longest: int = 64) -> None:
        super().__init__()
        self._most, self._longest, self._held = most, longest, 0

    def keep(self, key, value, size: int) -> None:
        """Remembers ``value``; ``size`` is about what key and value take. A large key is not worth it."""
        if size > 8 * self._longest:
            return
        self._held += size + self._PER_ENTRY
        if self._held > self._most:
            self.clear()
            self._held = size + self._PER_ENTRY
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self._held = 0


_memories: weakref.WeakSet = weakref.WeakSet()
_owner = ""


def sole(owner: str, *memories: Memory) -> None:
    """To be called by a task before it uses ``memories``: those of another ``owner`` in this worker are emptied.

    What is free is then given back to the machine, as the next operator is to have it all.
    """
    global _owner, _memories
    if _owner != owner:
        for memory in list(_memories):
            memory.forget()
        _owner, _memories = owner, weakref.WeakSet()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)
    for memory in memories:
        _memories.add(memory)


_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of every number (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``width`` values that lies within one row, and its row."""
    starts = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(starts)), starts)
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(starts, out=first[1:])
    return np.arange(first[-1]) - first[row] + offsets[row], row


def window_hashes(values: np.ndarray, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """An order-sensitive 64-bit hash of each window, by doubling: about log2(width) passes."""
    odd = np.uint64(seed * 2 + 0x9E3779B97F4A7C15)
    whole, have = np.zeros(len(starts), np.uint64), 0
    power, size = mix(values.astype(np.uint64) + np.uint64(seed)), 1
    while True:
        if width & size:
            whole = mix(whole * odd + power[starts + have])
            have += size
        size *= 2
        if size > width:
            return whole
        # power[i] covers values i .. i + size - 1; windows near the end are never looked up.
        power = mix(power[: len(power) - size // 2] * odd + power[size // 2 :])
