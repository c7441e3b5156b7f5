"""Reading page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagetable.functions.urls import is_binary

PAGE_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored page table: ``page_id, url, html`` and optionally ``status_code, final_url``.

    Formats without a schema of their own get the page schema, so nothing is inferred by a scan.
    """
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(f"{PAGE_SCHEMA}, status_code int, final_url string")
    return reader.load(path)


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages whose URL does not end in a binary suffix; filter before any parsing."""
    return pages.filter(~is_binary(F.col("url")))
