"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetable.llm import (
    bpe, collocations, dart_minhash, decontaminate, exact_dedup, hnsw, langid, licenses, pii, recompress, spelling,
    token_files, toxicity,
)
from pagetable.llm.common import table


def vocabulary_path() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.grade_documents(docs, labels)


def token_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(table(spark, sf_dir, "documents"), vocabulary_path())


def template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.matches(docs, benchmark)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(table(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def collocation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_template_leaks": template_leaks,
    "op2_toxicity_grades": toxicity_grades,
    "op3_nearest_vectors": nearest_vectors,
    "op4_license_scan": license_scan,
    "op5_bpe_round_trip": bpe_round_trip,
    "op6_repeated_passages": repeated_passages,
    "op7_personal_data": personal_data,
    "op8_token_files": token_file_round_trip,
    "op9_near_duplicates": near_duplicates,
    "op10_language_id": language_id,
    "op11_collocations": collocation_ranks,
    "op12_spelling_variants": spelling_variants,
    "op13_exact_copies": exact_copies,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.scan_sql(),
    "op11_collocations": collocations.SQL,
    "op13_exact_copies": exact_dedup.SQL,
}
