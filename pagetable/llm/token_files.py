"""Token ids in Arrow stream files of fixed-size-list batches.

The ids of all documents, in ascending doc_id order and each with an end id behind it, form one
stream, cut into sequences of equal length. Every file holds a range of documents: record batches
of ``BATCH_ROWS`` sequences, as fixed-size lists of ids and of a mask that is false in the padding
of the file's last sequence. All batches but the last are of one size, so sequence ``i`` is in batch
``i // BATCH_ROWS``, and a memory-mapped file gives its ids as one array per batch without a copy.
Beside it stands an Arrow stream with ``doc_id, start, n_tokens`` per document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window, functions as F

from pagetable.llm.common import MEMORY_BYTES, Memory, sole
from pagetable.session import Stage

SEQUENCE = 2048
BATCH_ROWS = 256
END_ID = 0
TOGETHER = 1 << 18  # parts whose ids are put in place at once
RANGE_LETTERS = 64  # of a text, by which rows of one doc_id are dealt; their order is by whole texts
INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(id_type: pa.DataType, sequence: int = SEQUENCE) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.field("item", id_type, nullable=False), sequence)),
        ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), sequence)),
    ])


def id_type_for(vocabulary_size: int) -> pa.DataType:
    return pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()


# What is known of a byte of UTF-8. White space beyond ASCII is behind 0xC2 or a byte of 0xE1 to 0xE3.
_WHITE, _SPACE, _WORD, _MARK, _ABOVE, _MAYBE_1, _MAYBE_2, _ACCENT = (1 << i for i in range(8))


def _bytes_known() -> np.ndarray:
    known = np.zeros(256, np.uint8)
    known[[*b"\t\n\v\f\r "]] |= _WHITE
    known[ord(" ")] |= _SPACE
    for c in range(0x21, 0x7F):
        known[c] |= _WORD if chr(c).isalnum() else _MARK
    known[0x21:] |= _ABOVE
    known[0xC2] |= _MAYBE_1
    known[0xE1:0xE4] |= _MAYBE_2
    known[0xC3] |= _ACCENT  # with what follows a letter, but for two signs
    return known


_BYTES = _bytes_known()
_SIGNS = (0x97, 0xB7)  # behind 0xC3


def cuts(data: np.ndarray) -> np.ndarray:
    """Where in texts in UTF-8, end to end, a byte-level split surely starts a piece; what stands on either side
    is split as it would be alone.

    These are white space behind other characters, marks behind a letter or digit, and what follows
    a single line end or tab. Where the bytes do not tell that for sure, there is no cut.
    """
    known = _BYTES[data]
    starts = np.zeros(len(data), bool)
    solid = (known & _ABOVE) != 0  # ends a character that is surely no white space
    solid[1:] &= (known[:-1] & _MAYBE_1) == 0
    solid[2:] &= (known[:-2] & _MAYBE_2) == 0
    starts[1:] = ((known[1:] & _WHITE) != 0) & solid[:-1]
    lines = starts[1:-1] & ((known[1:-1] & _SPACE) == 0)
    begins = (known[2:] & (_ABOVE | _MAYBE_1 | _MAYBE_2)) == _ABOVE
    word = (known & _WORD) != 0
    accent = np.flatnonzero(known[:-1] & _ACCENT) + 1
    word[accent[~np.isin(data[accent], _SIGNS)]] = True
    starts[1:] |= word[:-1] & ((known[1:] & _MARK) != 0)
    starts[2:] |= lines & begins
    return starts


def _one(word: str) -> bool:
    """Whether it has no white space, and is not empty."""
    return word.isalnum() or word.split() == [word]


class _Encoder:
    """The tokenizers library with its answers for pieces remembered.

    All texts of a batch are cut where a piece surely starts, and equal parts put together by Arrow, so that
    each is looked up once. Parts not known go to the library, many in one text, where the token of the space
    or line end before a part begins it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(path)
        self._tool.no_truncation()
        self._tool.no_padding()
        size = self._tool.get_vocab_size()
        self.dtype = np.dtype(id_type_for(size).to_pandas_dtype())
        self._added = [t.content for t in self._tool.get_added_tokens_decoder().values()]
        self._parts = Memory(2 * MEMORY_BYTES)
        self._begins = {gap: np.zeros(size, bool) for gap in " \n"}
        for token, i in self._tool.get_vocab().items():
            if i < size:
                # What the vocabulary writes for a space and for a line end.
                self._begins[" "][i] = token.startswith("\u0120")
                self._begins["\n"][i] = token == "\u010a"

    def awake(self) -> _Encoder:
        """To be called by a task: what other operators remembered in this worker goes."""
        sole("token files", self._parts)
        return self

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self._tool.encode_batch_fast(texts, add_special_tokens=False)
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in got]

    def _behind(self, gap: str, words: list[str]) -> list[bytes]:
        """Packed ids of words, each with ``gap`` before it; a line end's own id is left out."""
        out, width = [], self.dtype.itemsize
        skip = width if gap == "\n" else 0
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            (packed,) = self._encode([gap + gap.join(some)])
            begins = np.flatnonzero(self._begins[gap][np.frombuffer(packed, self.dtype)]) * width
            if len(begins) != len(some) or begins[0]:
                out += [ids[skip:] for ids in self._encode([gap + w for w in some])]
                continue
            edges = begins.tolist()
            out += [packed[a + skip : b] for a, b in zip(edges, [*edges[1:], len(packed)])]
        return out

    def _new_parts(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts that are not known, and remembers them."""
        spaced = [p for p in parts if p[0] == " " and _one(p[1:])]
        plain = [p for p in parts if p[0] != " " and _one(p)]
        found = dict(zip(spaced, self._behind(" ", [p[1:] for p in spaced])))
        found.update(zip(plain, self._behind("\n", plain)))
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, self._encode(rest)))
        keep = self._parts.keep
        for part, packed in found.items():
            keep(part, packed, 2 * len(part) + len(packed))
        return [found[p] for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, and how many each has."""
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for token in self._added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_parts(texts)
        ids, sizes = self._encode_parts(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts))
        each = np.split(ids, np.cumsum(sizes)[:-1])
        at = np.flatnonzero(whole)
        for i, packed in zip(at.tolist(), self._encode(texts.take(pa.array(at)).to_pylist())):
            each[i] = np.frombuffer(packed, self.dtype)
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _encode_parts(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        _, edges, data = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n = int(edges[-1] - edges[0])
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        data, edges = data.slice(int(edges[0]), n), edges - edges[0]
        starts = cuts(np.frombuffer(data, np.uint8))
        starts[edges[:-1][edges[:-1] < n]] = True
        starts = np.append(np.flatnonzero(starts), n)
        parts = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data).dictionary_encode()
        words, parts = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        known = list(map(self._parts.get, words))
        missing = [i for i, packed in enumerate(known) if packed is None]
        for i, packed in zip(missing, self._new_parts([words[i] for i in missing])):
            known[i] = packed
        flat = np.frombuffer(b"".join(known), self.dtype)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        first = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[parts])])
        ids = np.empty(ends[-1], self.dtype)
        for at in range(0, len(parts), TOGETHER):
            some, to = parts[at : at + TOGETHER], ends[at : at + TOGETHER + 1]
            take = np.repeat(first[some] - to[:-1], lengths[some])
            take += np.arange(to[0], to[-1])
            ids[to[0] : to[-1]] = flat[take]
        return ids, np.diff(ends[np.searchsorted(starts, edges)])


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


class _Writer:
    """One file of sequences and its index, both visible under their names only when complete."""

    def __init__(self, folder: str, dtype: np.dtype, sequence: int) -> None:
        self._fs, root = _open(folder)
        self._fs.create_dir(root, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}"
        self._path = f"{root}/{self.name.rpartition('/')[2]}"
        self._schema = file_schema(pa.from_numpy_dtype(dtype), sequence)
        self._out = self._fs.open_output_stream(f"{self._path}.tmp")
        self._stream = pa.ipc.new_stream(self._out, self._schema)
        self._docs_out = self._fs.open_output_stream(f"{self._path}.docs.tmp")
        self._docs = pa.ipc.new_stream(self._docs_out, INDEX_SCHEMA)
        self._dtype, self._length = dtype, sequence
        self._rest: list[np.ndarray] = []
        self._waiting = 0
        self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray, end_id: int) -> None:
        """Documents with their ids end to end; ``sizes`` counts those of each."""
        sizes = sizes + 1
        ends = np.cumsum(sizes)
        stream, own = np.full(ends[-1], end_id, self._dtype), np.ones(ends[-1], bool)
        own[ends - 1] = False
        stream[own] = ids
        self._docs.write_batch(pa.record_batch([doc_ids, self.tokens + ends - sizes, sizes], schema=INDEX_SCHEMA))
        self.tokens += len(stream)
        self._rest.append(stream)
        self._waiting += len(stream)
        full = self._length * BATCH_ROWS
        if self._waiting >= full:
            flat = np.concatenate(self._rest)
            for at in range(0, len(flat) - full + 1, full):
                self._write(flat[at : at + full], full)
            self._rest = [flat[len(flat) - len(flat) % full :]]
            self._waiting = len(self._rest[0])

    def _write(self, ids: np.ndarray, n: int) -> None:
        lists = [
            pa.FixedSizeListArray.from_arrays(values, type=self._schema.field(name).type)
            for name, values in (("ids", pa.array(ids)), ("mask", pa.array(np.arange(len(ids)) < n)))
        ]
        self._stream.write_batch(pa.record_batch(lists, schema=self._schema))

    def close(self) -> None:
        flat = np.concatenate(self._rest) if self._rest else np.zeros(0, self._dtype)
        if len(flat):
            padded = np.zeros(-(-len(flat) // self._length) * self._length, self._dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for stream, out in ((self._stream, self._out), (self._docs, self._docs_out)):
            stream.close()
            out.close()
        self._fs.move(f"{self._path}.docs.tmp", f"{self._path}.docs")
        self._fs.move(f"{self._path}.tmp", self._path)


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Writes ``doc_id, text`` as token files and returns one row ``part, file, n_tokens, start`` per file.

    Documents are dealt by ranges of doc_id (a null one comes first; rows that share one are
    ordered by text, and dealt by how it begins, so that they need not be one file) and each task streams its range into a file of its own under ``folder``, which all executors must
    reach. A file of a task that was repeated is left aside: the returned rows, kept in a table of
    the same folder, name the files that count. ``start`` is the number of ids in files before.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.left("text", F.lit(RANGE_LETTERS)))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )

    def store(batches):
        writer, part = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = _encoder(path).awake()
            if writer is None:
                writer, part = _Writer(folder, encoder.dtype, sequence), batch["part"][0].as_py()
            writer.add(batch["doc_id"], *encoder.encode(batch["text"]), end_id)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [writer.name], "n_tokens": [writer.tokens]})

    written = ordered.mapInArrow(store, "part long, file string, n_tokens long")
    written.write.parquet(f"{folder}/files")
    files = spark.read.schema(written.schema).parquet(f"{folder}/files")
    # One row per file: the only window without a key, over file names and sizes.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class TokenFile:
    """A token file opened for random access."""

    def __init__(self, name: str) -> None:
        fs, path = _open(name)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self._source = pa.memory_map(path) if local else fs.open_input_file(path)
        self._batches = list(pa.ipc.open_stream(self._source))
        with fs.open_input_file(f"{path}.docs") as f:
            self.docs = pa.ipc.open_stream(f).read_all()
        kind = self._batches[0].schema.field("ids").type if self._batches else None
        self.sequence = kind.list_size if kind else 0

    def ids(self, i: int) -> np.ndarray:
        """Ids of sequence ``i``: a view into the file."""
        flat = self._batches[i // BATCH_ROWS]["ids"].flatten().to_numpy(zero_copy_only=True)
        at = i % BATCH_ROWS * self.sequence
        return flat[at : at + self.sequence]

    def mask(self, i: int) -> np.ndarray:
        at = i % BATCH_ROWS * self.sequence
        return self._batches[i // BATCH_ROWS]["mask"].flatten()[at : at + self.sequence].to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file's stream; a view where one batch holds them."""
        size = BATCH_ROWS * self.sequence
        parts = []
        while n > 0:
            at = start % size
            flat = self._batches[start // size]["ids"].flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files alone.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian
    unsigned 32-bit numbers.
    """

    def load(batches):
        for batch in batches:
            for name, before in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                file = TokenFile(name)
                for docs in file.docs.to_batches(max_chunksize=4096):
                    starts, sizes = docs["start"].to_pylist(), docs["n_tokens"].to_pylist()
                    sums = [zlib.crc32(file.tokens(s, n).astype("<u4")) for s, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [docs["doc_id"], pa.array([before + s for s in starts], pa.int64()),
                         docs["n_tokens"], pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A number of partitions that is given is kept, where one that is not would be merged to a single task.
    dealt = files.repartition(max(1, files.count()), "file")
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row of ``docs`` (``doc_id, text``), written and read back.

    A null text has its end id only; rows of one doc_id, null included, are rows of their own in the order of their
    texts. An empty table gives no files and no rows.
    """
    folder = Stage(docs.sparkSession, "token-files").path("tokens")
    return read(write(docs, path, folder))
