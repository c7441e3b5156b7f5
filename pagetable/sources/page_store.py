"""Pages kept so that a lookup by URL moves no HTML.

A store is a folder of Parquet files in buckets by ``url``, sorted within them, one row per URL and with a Bloom filter of
each file's URLs. Joins on ``url`` read the buckets as they lie, and a search for single URLs opens one bucket each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pagetable.session import Stage


class PageStore:
    """A page table, written or to be, as declared here; ``pages`` reads it by its buckets."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, schema: StructType) -> None:
        self.folder, self.buckets, self.schema = folder, buckets, schema
        self._spark, self._table = spark, f"page_store_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        location = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self._table} ({columns}) USING parquet OPTIONS ('parquet.bloom.filter.enabled#url' 'true') "
            f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    @property
    def pages(self) -> DataFrame:
        return self._spark.table(self._table)

    def find(self, urls: list[str]) -> DataFrame:
        """The stored pages of a few URLs: only their buckets are opened, and of these files those that may hold them."""
        return self.pages.filter(F.col("url").isin(*urls))

    def forget(self) -> None:
        """Drops the table's name from the catalog; the folder stays."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self._table}")


def store_pages(pages: DataFrame, folder: str | None = None, buckets: int | None = None) -> PageStore:
    """Writes ``pages`` as a store; of several copies of a URL the one of least ``page_id`` is kept, null URLs are not.

    HTML moves once, to its bucket. Without a ``folder`` the store lies in the shared one; ``buckets`` defaults to the
    session's number of shuffle partitions.
    """
    spark = pages.sparkSession
    folder = folder or Stage(spark, "page-store").path("pages")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = pages.filter(F.col("url").isNotNull())
    first = named.groupBy("url").agg(F.min("page_id").alias("page_id"))
    # Both sides lie by url alone, which the join on both columns takes as it is and the buckets need.
    chosen = named.repartition(buckets, "url").join(first.repartition(buckets, "url"), ["url", "page_id"])
    store = PageStore(spark, folder, buckets, pages.schema)
    whole = chosen.dropDuplicates(["url", "page_id"]).select(*[F.col(f"`{c}`") for c in pages.columns])
    whole.write.mode("append").insertInto(store._table)
    return store
