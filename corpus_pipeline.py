"""A document table made ready for training: filtered, deduplicated, decontaminated, redacted, encoded.

Every stage takes ``(spark, docs, sf_dir)`` and reads all rows that the stage before kept. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetable.llm import bpe, dart_minhash, decontaminate, pii, toxicity
from pagetable.llm.common import table
from pagetable.llm.queries import vocabulary_path
from pagetable.session import Stage, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject.

    Labels name documents by doc_id; the model is fitted to those among ``docs`` that have one. A null text
    is judged like an empty one, repeated rows alike; without labels of both classes, or rows, nothing goes.
    """
    tune(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # Rows travel whole, so that no column of theirs meets one of the model's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("text", F.col("_row.text"))
    return toxicity.score(rows, model).filter(~F.col("toxic")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id from each class of near duplicates, in one row.

    Texts without words are alike only when equal, a null one counts as empty; an empty table stays empty.
    """
    tune(spark)
    return dart_minhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not with other numbers or names either.

    A null or empty text holds none; an empty table or benchmark drops nothing.
    """
    tune(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text.

    A null text stays null; repeated rows are redacted alike, and an empty table stays empty.
    """
    tune(spark)
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", n)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digests of a round trip; a null text has no ids, an empty table no rows."""
    tune(spark)
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode_texts),
]

# Models are fitted and sketches compared on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    for name, step in STAGES[:-1]:
        docs = stage.save(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
