"""The pipeline and the registered queries on a given table."""

import os

import pytest

import corpus_pipeline
from pagetable.llm import queries
from pagetable.session import Stage

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stage, columns, n = Stage(spark, "test"), docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage.save(step(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        left = docs.count()
        assert left == n if name == "personal_data" else 0.7 * n <= left <= n
        n = left
    assert corpus_pipeline.run(spark, SF_DIR).count() == n


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 0")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF_DIR).count() == 0


def test_stages_take_any_rows_and_columns(spark, documents, with_clashes):
    """Null, empty and very long texts, repeated rows and ids, and columns named like the stages' own."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    long = "plain words of some length " * 20000
    odd = documents((None, None), (None, ""), (900001, None), (900001, ""), (900002, long), (900003, "twice here"), (900003, "twice here"))
    docs = with_clashes(given.unionByName(odd))
    stage = Stage(spark, "test")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage.save(step(spark, docs, SF_DIR), name)
        assert docs.schema.names == before.schema.names and docs.dtypes == before.dtypes
        others = [c for c in docs.columns if c not in ("text", "n_chars")] if name == "personal_data" else docs.columns
        left = [f"`{c}`" for c in others]
        assert docs.select(left).exceptAll(before.select(left)).isEmpty()
        assert docs.filter("doc_id = 900002").count() == 1 and docs.filter("doc_id = 900003").count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


OTHERS = ("op1_template_leaks", "op11_collocations", "op12_spelling_variants")  # not one row per document


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in OTHERS])
def test_one_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR)
    if name == "op3_nearest_vectors":
        assert set(rows.columns) >= {"query_id", "rank", "vec_id", "score"}
    else:
        assert rows.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(corpus_pipeline.__file__)), "tools"))
    import check_oracles

    assert check_oracles.compare(spark, check_oracles.connect(SF_DIR), SF_DIR, name)[1] is None
