"""Stored pages in place of the network: lookup, status labels and failure messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.sources.page_store import PageStore

TIMEOUT_SECONDS = 30


def fetched(pages: DataFrame) -> DataFrame:
    """Pages whose fetch gave something: not those without HTML, nor errors with an empty body."""
    usable = F.col("html").isNotNull()
    if "status_code" in pages.columns:
        failed = F.coalesce(F.col("status_code") >= 400, F.lit(False))
        usable = usable & ~(failed & (F.col("html") == ""))
    return pages.filter(usable)


def lookup(frontier: DataFrame, pages: DataFrame | PageStore) -> DataFrame:
    """Fetch: every frontier row with the stored page of its ``url``, nulls where none is.

    In a store the frontier goes to the buckets and no page moves. In a plain table, of several copies of a page
    the one of least ``page_id`` is taken. Which that is, and whether it is asked for, is settled on ``(url, page_id)``
    alone; HTML moves once, to the frontier rows that want it, and rows without a stored page take no further part.
    """
    if isinstance(pages, PageStore):
        return frontier.join(pages.pages, "url", "left")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    asked = frontier.join(first, "url", "left")
    hits = asked.filter(F.col("page_id").isNotNull()).join(pages.drop("url"), "page_id")
    misses = asked.filter(F.col("page_id").isNull())
    return hits.unionByName(misses, allowMissingColumns=True)


def with_record(rows: DataFrame, records: DataFrame, spread: str) -> DataFrame:
    """Left join on ``page_id`` where very many rows have none: these lie by the column ``spread`` instead of together."""
    known = F.col("page_id").isNotNull()
    keyed = rows.withColumn("_key", F.coalesce("page_id", F.xxhash64(spread))).withColumn("_known", known)
    named = records.withColumnRenamed("page_id", "_key").withColumn("_known", F.lit(True))
    return keyed.join(named, ["_key", "_known"], "left").drop("_key", "_known")


def status_error(status: Column) -> Column:
    """``HTTP n`` from 400 on, else null. The page itself is kept either way."""
    return F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))


def fetch_error(kind: Column, detail: Column) -> Column:
    """Short message for a failure class of a fetch log; null for no failure."""
    return (
        F.when(kind == "timeout", F.lit(f"Timeout after {TIMEOUT_SECONDS}s"))
        .when(kind == "connection", F.concat(F.lit("Connection error: "), detail))
        .when(kind == "request", F.concat(F.lit("Request error: "), detail))
        .when(kind == "url", F.concat(F.lit("URL error: "), detail))
        .when(kind.isNotNull(), detail)
    )


def fetch_outcomes(log: DataFrame) -> DataFrame:
    """``error, n``: how often each outcome occurs in a log with
    ``status_code, error_kind, detail``."""
    error = F.coalesce(
        fetch_error(F.col("error_kind"), F.col("detail")), status_error(F.col("status_code"))
    )
    return log.groupBy(error.alias("error")).agg(F.count("*").alias("n"))
