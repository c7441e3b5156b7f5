"""Inverted indexes: ranked search over words and search for substrings, without reading the corpus.

An index is a folder. ``rows`` holds the indexed rows in the order of a number given to each, ``doc``. ``postings`` holds
for each term the rows that have it, in blocks of at most ``BLOCK``: the first row's number, what the others are beyond
it, and with words also counts and text lengths and the largest share of a score that the block can give.
Blocks are sorted by term, so Parquet's statistics leave a query with those of its own terms.

A task that reads rows puts the postings of each term side by side, in pieces of at most ``PIECE``. Only pieces move, by
ranges of ``(term, first row)``, and what meets is cut into blocks anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagetable.operators.search import B, K1, hit_columns, n_words, posts, query_terms
from pagetable.session import Stage

BLOCK = 128
PIECE = 1024  # postings of one term that move as one row, at most
GATHERED = 1 << 21  # postings that a task holds before it passes pieces on, about
CUT = 1 << 18  # postings that are cut into blocks at a time, about
SLICE = 1 << 20  # words or characters that a task looks at at a time, unless one row has more
_WORD = r"[\p{L}\p{N}]+"
_BLOCKS = (
    "term string, first long, last long, n int, best double, beyond array<long>, counts array<int>, lengths array<int>"
)


# What a row is beyond the first, its count and its length, three numbers for each posting: most pieces are short, and one
# list is half the size of three.
_PIECES = "term string, first long, entries array<long>"


def _postings(terms: pa.Array, code, doc, count, length) -> pa.Table:
    """One row for each posting; ``terms`` are different ones, ``code`` are places among them."""
    term = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), terms)
    return pa.table({"term": term, "doc": doc, "count": count.astype(np.int32), "length": length.astype(np.int32)})


def _joined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).unify_dictionaries().combine_chunks()


def _codes(table: pa.Table) -> np.ndarray:
    return table["term"].chunk(0).indices.to_numpy()


def _words_in(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each word the row and the word."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().dictionary_encode()


def _trigrams_in(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each character the row and the three characters that it begins; the last two places of a row are filled up."""
    texts = [text or "" for text in column.to_pylist()]
    sizes = np.array([len(text) for text in texts], np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    filled = "".join([text + "\x00\x00" for text in texts])
    c = np.frombuffer(filled.encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.arange(len(rows)) + 2 * rows
    found = pa.array(c[at] << 42 | c[at + 1] << 21 | c[at + 2]).dictionary_encode()
    keys = found.dictionary.to_numpy()
    spelled = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    terms = pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string())
    return rows, pa.DictionaryArray.from_arrays(found.indices, terms)


def _slices(batch: pa.RecordBatch, follows: int):
    """Rows of one file that follow each other, of bounded size; ``follows`` is the number after the last row before.

    With each: whether it does not follow what came before.
    """
    doc, terms = batch["doc"].to_numpy(), batch["terms"]
    size = pc.list_value_length(terms) if pa.types.is_list(terms.type) else pc.utf8_length(terms)
    size = size.fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(len(doc)):
        new = doc[i] != (doc[i - 1] + 1 if i else follows)
        if i > start and (new or held + size[i] > SLICE):
            yield bool(doc[start] != (doc[start - 1] + 1 if start else follows)), batch.slice(start, i - start)
            start, held = i, 0
        held += size[i]
    if len(doc):
        yield bool(doc[start] != (doc[start - 1] + 1 if start else follows)), batch.slice(start)


def _gather(terms_in: Callable[[pa.Array], tuple[np.ndarray, pa.DictionaryArray]], repeated: bool):
    """Pieces of the rows that a task reads. With ``repeated``, counts are those of the term in the row, else 1."""

    def pieces(batches):
        held, n, follows = [], 0, -1
        for batch in batches:
            for new, rows in _slices(batch, follows):
                # A piece holds rows that follow each other, so that pieces of one term never overlap.
                if held and (new or n >= GATHERED):
                    yield _in_pieces(held)
                    n = 0
                doc, length = rows["doc"].to_numpy(), rows["length"].to_numpy()
                follows = int(doc[-1]) + 1
                row, term = terms_in(rows["terms"])
                if not len(row):
                    continue
                pair, count = np.unique(term.indices.to_numpy().astype(np.int64) * len(doc) + row, return_counts=True)
                code, row = np.divmod(pair, len(doc))
                count = count if repeated else np.ones_like(count)
                held.append(_postings(term.dictionary, code, doc[row], count, length[row]))
                n += len(pair)
        if held:
            yield _in_pieces(held)

    return pieces


def _in_pieces(held: list[pa.Table]) -> pa.RecordBatch:
    """Empties ``held``, as every copy of so many postings counts."""
    table = _joined(held)
    held.clear()
    # Slices come in the order of their rows.
    table = table.take(pa.array(np.argsort(_codes(table), kind="stable"))).combine_chunks()
    starts = _starts(table, PIECE)
    doc, beyond, count, length = _columns(table, starts)
    offsets = pa.array(3 * np.append(starts, table.num_rows).astype(np.int32))
    entries = pa.ListArray.from_arrays(offsets, pa.array(np.stack([beyond, count, length], 1).ravel()))
    return pa.RecordBatch.from_arrays([_terms_at(table, starts), pa.array(doc[starts]), entries], ["term", "first", "entries"])


def _together(batches):
    """Batches of pieces put together to ``CUT`` postings or more, as tables' columns are cheap only when long."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch["entries"].flatten()) // 3
        if n >= CUT:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _cut(mean: float):
    """Blocks of one partition's pieces, which are in the order of ``(term, first)``."""

    def blocks(batches):
        kept = None
        for batch in _together(batches):
            sizes = batch["entries"].value_lengths().to_numpy() // 3
            term = batch["term"].dictionary_encode()
            beyond, count, length = batch["entries"].flatten().to_numpy().reshape(-1, 3).T
            doc = np.repeat(batch["first"].to_numpy(), sizes) + beyond
            table = _postings(term.dictionary, np.repeat(term.indices.to_numpy(), sizes), doc, count, length)
            if kept is not None:
                table = _joined([kept, table])
            # The last term may go on in the next batch; its whole blocks need not wait.
            starts = _starts(table, BLOCK)
            if not len(starts):
                continue
            rest = int(starts[-1]) if table.num_rows - starts[-1] < BLOCK else table.num_rows
            kept = None
            if rest < table.num_rows:
                left = table.slice(rest).combine_chunks()
                kept = left.set_column(0, "term", left["term"].chunk(0).dictionary_decode().dictionary_encode())
            if rest:
                yield _packed(table.slice(0, rest).combine_chunks(), mean)
        if kept is not None:
            yield _packed(kept, mean)

    return blocks


def _starts(table: pa.Table, most: int) -> np.ndarray:
    """Where a block begins: at a new term, and ``most`` rows after."""
    if not table.num_rows:
        return np.empty(0, np.int64)
    codes = _codes(table)
    new = np.append(True, codes[1:] != codes[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    return np.flatnonzero((np.arange(len(codes)) - first) % most == 0)


def _terms_at(table: pa.Table, starts: np.ndarray) -> pa.Array:
    return table["term"].chunk(0).take(pa.array(starts)).dictionary_decode()


def _columns(table: pa.Table, starts: np.ndarray) -> list[np.ndarray]:
    """Rows, what they are beyond the row of their start, counts and lengths."""
    doc, count, length = (table[c].to_numpy() for c in ("doc", "count", "length"))
    return [doc, doc - np.repeat(doc[starts], np.diff(np.append(starts, table.num_rows))), count, length]


def _packed(table: pa.Table, mean: float) -> pa.RecordBatch:
    starts = _starts(table, BLOCK)
    sizes = np.diff(np.append(starts, table.num_rows))
    doc, beyond, count, length = _columns(table, starts)
    share = count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
    best = np.maximum.reduceat(share, starts)
    offsets = pa.array(np.append(starts, table.num_rows).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(values))
        for values in (beyond, count, length)
    ]
    columns = [_terms_at(table, starts), pa.array(doc[starts]), pa.array(doc[starts + sizes - 1]),
               pa.array(sizes.astype(np.int32)), pa.array(best), *lists]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])


class Index:
    """An index that was built; ``mean`` is the mean number of words of a text, ``size`` that of rows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        figures = spark.read.schema("n long, mean double, schema string").parquet(f"{folder}/figures").first()
        self.spark, self.folder = spark, folder
        self.size, self.mean = figures["n"], figures["mean"]
        self.rows = spark.read.schema(_schema(figures["schema"])).parquet(f"{folder}/rows")
        self.postings = spark.read.schema(_BLOCKS).parquet(f"{folder}/postings")


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def _build(docs: DataFrame, terms: Column, gather: Callable, length: Column, folder: str | None, name: str) -> Index:
    """``gather`` makes pieces of ``terms``, words or a text; ``length`` is a row's number of words."""
    spark = docs.sparkSession
    folder = folder or Stage(spark, name).path("index")
    numbered = docs.withColumn("doc", F.monotonically_increasing_id())
    # Lengths are counted once and lie beside the rows; who reads an index does not see them.
    measured = numbered.withColumn("_length", length)
    measured.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(measured.schema).parquet(f"{folder}/rows")
    figures = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("_length"), F.lit(0.0)).alias("mean"))
    figures = figures.withColumn("schema", F.lit(numbered.schema.json()))
    figures.write.parquet(f"{folder}/figures")
    mean = spark.read.schema(figures.schema).parquet(f"{folder}/figures").first()["mean"] or 1.0
    read = rows.select("doc", F.coalesce(F.col("_length").cast("long"), F.lit(0)).alias("length"), terms.alias("terms"))
    # Written, as the bounds of the ranges are found from all pieces before these move.
    stage = Stage(spark, f"{name}-pieces")
    read.mapInArrow(gather, _PIECES).write.option("compression", "zstd").parquet(stage.path("pieces"))
    found = spark.read.schema(_PIECES).parquet(stage.path("pieces"))
    dealt = found.repartitionByRange("term", "first").sortWithinPartitions("term", "first")
    dealt.mapInArrow(_cut(mean), _BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/postings")
    stage.clear()
    return Index(spark, folder)


def build_word_index(docs: DataFrame, folder: str | None = None) -> Index:
    """An index over the words of ``docs`` (``id, title, url, text``; ``id`` unique)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    return _build(docs, words, _gather(_words_in, True), n_words(F.col("text")), folder, "word-index")


def _kept_blocks(index: Index, terms: list[str], idf: dict[str, float], limit: int) -> DataFrame:
    """The blocks of ``terms`` that may hold one of the best ``limit`` rows, from their figures alone.

    A block has a row with its best share, and blocks of one term have different rows. So the best score of rank
    ``limit`` is at least that of the ``limit``-th best block of any term; a block goes where its own best and the best
    of all other terms do not reach it.
    """
    weight = F.lit(0.0)
    for term in terms:
        weight = F.when(F.col("term") == term, F.lit(idf[term])).otherwise(weight)
    blocks = index.postings.filter(F.col("term").isin(*terms)).withColumn("bound", weight * F.col("best"))
    reached, most = 0.0, {}
    for term in terms:
        # At most ``limit`` numbers of each term.
        top = [r[0] for r in blocks.filter(F.col("term") == term).select("bound").orderBy(F.desc("bound")).limit(limit).collect()]
        most[term] = top[0] if top else 0.0
        if len(top) == limit:
            reached = max(reached, top[-1])
    others = F.lit(0.0)
    for term in terms:
        others = F.when(F.col("term") == term, F.lit(sum(most.values()) - most[term])).otherwise(others)
    # Scores are shown to six digits; what is as good as the last shown one stays.
    return blocks.filter(F.col("bound") + others >= reached - 1e-5)


def search_bm25_indexed(index: Index, query: str, limit: int = 20, description: int | None = None) -> DataFrame:
    """What :func:`pagetable.operators.search.search_bm25` gives, from an index over the same rows.

    Reads the figures of the query's blocks, then those blocks that can matter, then the rows of the hits.
    """
    terms = query_terms(query)
    found = index.postings.filter(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("n")).collect()
    df = {term: n for term, n in found}
    idf = {t: float(np.log(1.0 + (index.size - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in terms}
    blocks = _kept_blocks(index, terms, idf, limit)
    entries = blocks.select("term", "first", F.explode(F.arrays_zip("beyond", "counts", "lengths")).alias("e"))
    entries = entries.select(
        "term", (F.col("first") + F.col("e.beyond")).alias("doc"), F.col("e.counts").alias("tf"), F.col("e.lengths").alias("len")
    )
    # One row for each row found, its terms side by side, so that scores are added in the query's order.
    tf = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = entries.groupBy("doc", "len").agg(*tf)
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        norm = F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.lit(index.mean))
        score = score + F.lit(idf[term]) * F.col(f"tf{i}") * (K1 + 1) / norm
    scored = counted.select("doc", F.round(score, 6).alias("score"))
    # Ties go to the smaller id, which only the rows know: fetch all that tie with the last one.
    last = scored.orderBy(F.desc("score")).limit(limit).agg(F.min("score")).first()[0]
    if last is None:
        return hit_columns(index.rows.limit(0).withColumn("score", F.lit(0.0)), "score", description)
    tied = scored.filter(F.col("score") >= last)
    ids = tied.join(index.rows.select("doc", "id"), "doc").orderBy(F.desc("score"), "id").limit(limit)
    best = ids.select("doc", "score").collect()  # at most ``limit`` pairs of numbers
    shown = index.rows.filter(F.col("doc").isin(*[r["doc"] for r in best]))
    scores = index.spark.createDataFrame([tuple(r) for r in best], "doc long, score double")
    return hit_columns(shown.join(F.broadcast(scores), "doc"), "score", description)


def build_substring_index(raw: DataFrame, folder: str | None = None) -> Index:
    """An index over the character trigrams of ``raw``'s ``content``, letter case aside."""
    return _build(raw, F.lower("content"), _gather(_trigrams_in, False), F.lit(1), folder, "substring-index")


def candidates(index: Index, query: str) -> DataFrame | None:
    """``doc`` of the rows that have all trigrams of ``query``, or begin one with a shorter query; null: all rows may match."""
    wanted = query.lower()
    if not wanted:
        return None
    if len(wanted) < 3:
        blocks = index.postings.filter(F.col("term").startswith(wanted))
        need = 1
    else:
        grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        blocks, need = index.postings.filter(F.col("term").isin(*grams)), len(grams)
    docs = blocks.select("term", F.col("first"), F.explode("beyond").alias("beyond"))
    docs = docs.select((F.col("first") + F.col("beyond")).alias("doc"))
    return docs.groupBy("doc").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("doc")


def post_search_indexed(index: Index, query: str, limit: int = 10) -> DataFrame:
    """What :func:`pagetable.operators.search.post_search` gives, from an index over the same posts."""
    found = candidates(index, query)
    rows = index.rows if found is None else index.rows.join(found, "doc", "left_semi")
    matching = rows.filter(F.lower("content").contains(query.lower()))
    return posts(matching).orderBy(F.desc("date"), "id").limit(limit)
