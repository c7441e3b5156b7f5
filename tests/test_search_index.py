"""Indexes against the scans they spare."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetable.operators import search as S
from pagetable.operators import search_index as I

WORDS = ["the", "of", "and", "Été", "x1", "rare", "very", "often", "a", "I"] + [f"w{i}" for i in range(60)]


def texts(rng, n):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, 80))) for _ in range(n)] + [None, "", " ", "the", "THE the"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 - i, f"t{i}" if i % 3 else None, f"u{i}", t) for i, t in enumerate(texts(random.Random(3), 700))]
    return spark.createDataFrame(rows, "id long, title string, url string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return I.build_word_index(docs, str(tmp_path_factory.mktemp("index") / "words"))


def shown(df):
    return sorted(map(tuple, df.select("id", "title", "url", "description", "score").collect()))


@pytest.mark.parametrize("query", ["the of", "rare w59", "Été", "the", "nowhere", "the nowhere w7 w8 w9", "x1 THE"])
@pytest.mark.parametrize("limit", [1, 7, 5000])
def test_ranked_search_equals_the_scan(docs, index, query, limit):
    assert shown(I.search_bm25_indexed(index, query, limit)) == shown(S.search_bm25(docs, query, limit))


def test_blocks_are_bounded_and_whole(docs, index):
    blocks = index.postings
    assert blocks.filter((F.col("n") > I.BLOCK) | (F.size("beyond") != F.col("n"))).isEmpty()
    found = blocks.select("term", F.explode(F.arrays_zip("beyond", "counts")).alias("e"), "first").select(
        "term", (F.col("first") + F.col("e.beyond")).alias("doc"), F.col("e.counts").alias("n")
    )
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(I._WORD), F.lit(0)))
    want = index.rows.select("doc", words.alias("term")).groupBy("term", "doc").agg(F.count("*").cast("int").alias("n"))
    columns = ["term", "doc", "n"]
    assert found.count() == want.count()
    assert found.select(columns).exceptAll(want.select(columns)).isEmpty()
    # Blocks of one term follow each other.
    assert blocks.groupBy("term").agg(F.count_if(F.col("n") < I.BLOCK).alias("k")).filter("k > 4").isEmpty()


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path):
    rows = [(i, "", "", "apple " * (20 if i < 30 else 1) + "pear " * (i % 2) + "filler " * 30) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, title string, url string, text string").coalesce(1)
    index = I.build_word_index(docs, str(tmp_path / "i"))
    idf = {"apple": 1.0}
    kept, every = I._kept_blocks(index, ["apple"], idf, 1), index.postings.filter("term = 'apple'")
    assert kept.count() == 1 < every.count()
    assert shown(I.search_bm25_indexed(index, "apple pear", 4)) == shown(S.search_bm25(docs, "apple pear", 4))


def test_texts_are_read_for_hits_alone(index):
    plan = I.search_bm25_indexed(index, "rare w59", 3)._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan")[1:] if "text:string" in part]
    assert len(scans) == 1 and "PushedFilters: [" in scans[0]
    assert "In(doc" in scans[0] or "EqualTo(doc" in scans[0]
    terms = index.postings.filter(F.col("term").isin("rare"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,rare)" in terms or "In(term" in terms


def raw_posts(spark, contents):
    rows = [(i, c, i % 7) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "id long, content string, k int").select(
        "id", F.timestamp_seconds(F.col("k")).alias("ts"), F.lit("u").alias("username"), F.lit(None).cast("string").alias("display_name"),
        "content", F.lit(1).alias("likes"), F.lit(2).alias("retweets"), F.lit(3).alias("replies"), F.lit("x").alias("url"),
    )


QUERIES = ["the", "THE OF", "été", "t", "1", "x1", " ", "  ", "of and", "zzz", "", "%", "_", "the\\", "\n", "ab", "abc", "abcd", "e"]


def test_substring_search_equals_the_scan(spark, tmp_path):
    contents = texts(random.Random(5), 300) + ["ab", "abc", "xabcd", "a%b_c", "the\\end", "line\nend", "İstanbul", "e", "T"]
    raw = raw_posts(spark, contents)
    index = I.build_substring_index(raw, str(tmp_path / "i"))
    for query in QUERIES:
        for limit in (3, 1000):
            got, want = I.post_search_indexed(index, query, limit), S.post_search(raw, query, limit)
            assert got.columns == want.columns
            assert list(map(tuple, got.collect())) == list(map(tuple, want.collect())), query


def test_candidates_are_pruned_to_rows_that_have_all_trigrams(spark, tmp_path):
    raw = raw_posts(spark, [f"item {i:04d} end" for i in range(500)])
    index = I.build_substring_index(raw, str(tmp_path / "i"))
    assert I.candidates(index, "0123").count() <= 3
    assert I.candidates(index, "em 0499 e").count() == 1
    assert I.candidates(index, "").__class__ is type(None)


def postings_of(rows):
    """``(term, row, count, length)`` in the order of the lists."""
    lists = lambda r: zip(*[iter(r["entries"])] * 3) if "entries" in r else zip(r["beyond"], r["counts"], r["lengths"])
    return [(r["term"], r["first"] + b, c, n) for r in rows for b, c, n in lists(r)]


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("gathered, size", [(1, 1), (300, 40), (1 << 20, 1 << 21)])
def test_pieces_of_terms_move_and_not_postings(monkeypatch, words, gathered, size):
    monkeypatch.setattr(I, "GATHERED", gathered)
    monkeypatch.setattr(I, "SLICE", size)
    monkeypatch.setattr(I, "PIECE", 16)
    monkeypatch.setattr(I, "CUT", 100)
    rng = random.Random(8)
    text = [None if rng.random() < 0.1 else " ".join(rng.choices(["the", "été", "é😀x", "ab", "a"], k=rng.randint(0, 9))) for _ in range(400)]
    doc = [*range(100, 250), *range(1 << 33, (1 << 33) + 200), *range(50)]  # a file read after a later one
    terms = [t and t.split() for t in text] if words else text
    kind = pa.list_(pa.string()) if words else pa.string()
    whole = pa.record_batch({"doc": doc, "length": pa.array([i % 5 for i in range(400)]), "terms": pa.array(terms, kind)})
    batches = [whole.slice(i, 64) for i in range(0, 400, 64)]
    pieces = list(I._gather(I._words_in if words else I._trigrams_in, words)(iter(batches)))
    want = []
    for i, (d, t) in enumerate(zip(doc, terms)):
        found = t or [] if words else [((t or "") + "\0\0")[k : k + 3] for k in range(len(t or ""))]
        want += [(x, d, found.count(x) if words else 1, i % 5) for x in set(found)]
    rows = [r for batch in pieces for r in batch.to_pylist()]
    assert sorted(postings_of(rows)) == sorted(want)
    assert max(len(r["entries"]) for r in rows) <= 3 * 16 and (gathered == 1 or len(rows) < len(want) / 4)
    # Pieces in the order of their first rows give all rows in order, and blocks that are full but for the last one.
    rows.sort(key=lambda r: (r["term"].encode(), r["first"]))
    dealt = [pa.RecordBatch.from_pylist(rows[i : i + 7], pieces[0].schema) for i in range(0, len(rows), 7)]
    blocks = [r for batch in I._cut(2.0)(iter(dealt)) for r in batch.to_pylist()]
    assert postings_of(blocks) == sorted(want, key=lambda p: (p[0].encode(), p[1]))
    sizes = {}
    for r in blocks:
        assert r["n"] == len(r["beyond"]) and r["last"] == r["first"] + r["beyond"][-1]
        sizes.setdefault(r["term"], []).append(r["n"])
    assert all(n[:-1] == [I.BLOCK] * (len(n) - 1) and n[-1] <= I.BLOCK for n in sizes.values())


def test_a_long_post_takes_time_in_proportion(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh é"), 1_500_000))
    raw = raw_posts(spark, [long, "short the"])
    index = I.build_substring_index(raw, str(tmp_path / "i"))
    got = I.post_search_indexed(index, long[1_400_000:1_400_012]).select("id").collect()
    assert [r["id"] for r in got] == [0]


def test_empty_tables(spark, docs, tmp_path):
    empty = I.build_word_index(docs.limit(0), str(tmp_path / "w"))
    assert I.search_bm25_indexed(empty, "the").collect() == []
    none = I.build_substring_index(raw_posts(spark, ["x"]).limit(0), str(tmp_path / "s"))
    assert I.post_search_indexed(none, "x").collect() == []
