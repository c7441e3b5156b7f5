"""Crawls started by a stream of seeds, over one stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetable.operators.traverse import crawl_order
from pagetable.sources.link_graph import LinkGraph
from pagetable.streaming.pages import new_urls


def crawl_seeds(
    seeds: DataFrame,
    graph: LinkGraph,
    path: str,
    checkpoint: str,
    depth: int = 1,
    limit: int | None = 10,
    delay: str = "1 hour",
) -> None:
    """Crawls each seed of the stream ``seed, ts`` once and writes ``seed, depth, rank, url, page_id`` to ``path``.

    A seed that comes again within ``delay`` is known from the stream's state and not crawled again; one that is later than
    the watermark is dropped. Each trigger walks its new seeds only, and the graph is never shuffled. A trigger
    that is repeated after a failure replaces what it had written. Runs until what is there is done.
    """
    spark = seeds.sparkSession

    def walk(batch: DataFrame, number: int) -> None:
        # Written first: a walk reads its seeds several times, and state must be read once only.
        fresh = f"{path}/seeds/batch={number}"
        batch.select("seed").write.mode("overwrite").parquet(fresh)
        found = spark.read.schema("seed string").parquet(fresh)
        order = crawl_order(graph.lists, found, depth, limit, graph)
        order.write.mode("overwrite").parquet(f"{path}/pages/batch={number}")

    once = new_urls(seeds.select(F.col("seed").alias("url"), "ts"), "ts", delay)
    query = (
        once.select(F.col("url").alias("seed"))
        .writeStream.foreachBatch(walk)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def crawled(graph: LinkGraph, path: str) -> DataFrame:
    """What :func:`crawl_seeds` has written so far."""
    schema = "seed string, depth int, rank long, url string, page_id long"
    return graph.lists.sparkSession.read.schema(schema).parquet(f"{path}/pages").select(*[c.split()[0] for c in schema.split(", ")])
