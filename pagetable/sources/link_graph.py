"""A link graph over integer ids, kept as tables so that it can be walked many times.

A graph is a folder of three tables. ``lists`` has the adjacency lists as given: ``url, page_id, links``, one row per
stored URL. ``urls`` is the dictionary, ``id, url, page_id`` of every URL in the lists: URLs are dealt by ranges and
numbered within their range, ``id = range * 2**34 + 2 * place``, plus one where the URL is not stored. So an id tells
by itself whether a page lies behind it and which range it is in, and ids of one site are close together.
``links`` holds ``id, links`` with the targets as an array of ids, in buckets by ``id`` and sorted within them, which
joins read as they lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pagetable.session import Stage

_RANGE_BITS = 34
_LISTS = "url string, page_id long, links array<string>"
_URLS = "id long, url string, page_id long"


def is_stored(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(1).cast("long")) == 0


def range_of(id_: Column) -> Column:
    """The range of the dictionary that an id was dealt in."""
    return F.shiftright(id_, _RANGE_BITS)


class LinkGraph:
    """The tables of a graph; ``most_links`` is the largest number of links of a page."""

    def __init__(self, spark: SparkSession, folder: str, table: str, buckets: int, most_links: int) -> None:
        self.folder, self.buckets, self.most_links = folder, buckets, most_links
        self.lists = spark.read.schema(_LISTS).parquet(f"{folder}/lists")
        self.urls = spark.read.schema(_URLS).parquet(f"{folder}/urls")
        self._table = table
        self.links = spark.table(table)

    def forget(self) -> None:
        """Drops the table's name from the catalog; the folder stays."""
        self.links.sparkSession.sql(f"DROP TABLE IF EXISTS {self._table}")


def _declared(spark: SparkSession, folder: str, buckets: int) -> str:
    name = f"link_graph_{uuid.uuid4().hex}"
    location = f"{folder}/links".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (id BIGINT, links ARRAY<BIGINT>) USING parquet "
        f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return name


def build_graph(lists: DataFrame, folder: str | None = None, buckets: int | None = None) -> LinkGraph:
    """Writes the graph of ``lists`` (``url, page_id, links``; one row per stored URL, links of any URLs).

    URLs move as text here only: twice for the dictionary and once for each link. Without a ``folder`` the graph lies in
    the shared one. ``buckets`` defaults to the session's number of shuffle partitions.
    """
    spark = lists.sparkSession
    folder = folder or Stage(spark, "link-graph").path("graph")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    widest = Observation()
    known = lists.filter(F.col("url").isNotNull()).select("url", F.col("page_id").cast("long").alias("page_id"), "links")
    known.observe(widest, F.max(F.size("links")).alias("most")).write.parquet(f"{folder}/lists")
    lists = spark.read.schema(_LISTS).parquet(f"{folder}/lists")

    targets = lists.select(F.explode("links").alias("url"), F.lit(None).cast("long").alias("page_id"))
    ends = lists.select("url", "page_id").unionByName(targets).filter(F.col("url").isNotNull())
    dealt = ends.groupBy("url").agg(F.min("page_id").alias("page_id")).repartitionByRange("url")
    # The partition's number in the upper 31 bits, the row's in the lower 33; kept as written.
    number = F.shiftleft(F.monotonically_increasing_id(), 1)
    stored = F.when(F.col("page_id").isNull(), 1).otherwise(0)
    dealt.sortWithinPartitions("url").select((number + stored).alias("id"), "url", "page_id").write.parquet(f"{folder}/urls")
    urls = spark.read.schema(_URLS).parquet(f"{folder}/urls")

    places = lists.join(urls.select("id", "url"), "url").select("id", F.posexplode("links").alias("pos", "url"))
    edges = places.join(urls.select(F.col("id").alias("to"), "url"), "url").select("id", "pos", "to")
    placed = F.sort_array(F.collect_list(F.struct("pos", "to")))
    links = edges.repartition(buckets, "id").groupBy("id").agg(placed["to"].alias("links"))
    name = _declared(spark, folder, buckets)
    links.write.mode("append").insertInto(name)
    return LinkGraph(spark, folder, name, buckets, max(widest.get["most"] or 0, 0))


def open_graph(spark: SparkSession, folder: str, buckets: int, most_links: int) -> LinkGraph:
    """A graph written before, by the ``folder``, ``buckets`` and ``most_links`` that it was built with."""
    return LinkGraph(spark, folder, _declared(spark, folder, buckets), buckets, most_links)
