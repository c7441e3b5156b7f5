"""Keeping derived tables for reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_link_table(links: DataFrame, name: str, buckets: int) -> DataFrame:
    """Store adjacency lists (``url, links``) as a table bucketed and sorted by ``url``.

    A walk joins its frontier to the lists once per level. On a bucketed table only the frontier
    is shuffled for that, so a link graph walked more than once should be kept this way.
    """
    spark = links.sparkSession
    links.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").saveAsTable(name)
    return spark.table(name)
