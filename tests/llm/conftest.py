import pytest

from pagetable.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Names that the operators use for columns of their own, here as columns of the input.
CLASHES = (
    "text", "words", "labels", "id", "ids", "part", "node", "key", "score", "kind", "start", "_row", "toxic", "severity",
    "grade", "p_toxic", "_toxicity", "_hash", "_hit", "_node", "lang_pred", "narrow", "held_out", "_best", "_last", "_part",
    "n", "n_words", "item_id", "item_node", "longest", "coverage", "record", "mark", "norm", "row", "phrase", "word", "run",
)


@pytest.fixture(scope="session")
def documents(spark):
    """A document table from texts, numbered from 0, or from ``(doc_id, text)`` pairs."""

    def build(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def with_clashes():
    """The same table with more columns, named like the operators' own."""
    from pyspark.sql import functions as F

    def widen(docs):
        return docs.withColumns({c: F.lit("x") for c in CLASHES if c not in docs.columns})

    return widen


@pytest.fixture(scope="session")
def vocabulary():
    return vocabulary_path()
