"""Crawls over a stream of seeds against one over all of them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagetable.operators import traverse as G
from pagetable.sources.link_graph import build_graph
from pagetable.streaming.crawl import crawl_seeds, crawled
from pagetable.streaming.pages import stream_pages

START = datetime(2024, 1, 1)


def test_crawl_over_several_triggers_equals_one(spark, tmp_path):
    """Seeds come again in one trigger and in later ones, out of order; one comes later than the watermark allows."""
    rng = random.Random(4)
    names = [f"http://h/n{i}" for i in range(30)]
    lists = [(u, i, sorted(rng.sample(names + ["http://h/gone"], rng.randint(0, 4)))) for i, u in enumerate(names)]
    graph = build_graph(spark.createDataFrame(lists, "url string, page_id long, links array<string>"))
    triggers = [
        [(names[0], 0), (names[1], 5), (names[0], 7)],
        [(names[2], 3), (names[0], 30), ("http://h/unknown", 31)],
        [(names[3], 300), (names[1], 299), (names[2], 301)],
        [(names[4], 1), (names[5], 295)],  # the first is hours behind the watermark
        [(names[1], 400), (names[3], 310)],
    ]
    for i, rows in enumerate(triggers):
        rows = [(s, START + timedelta(minutes=m)) for s, m in rows]
        spark.createDataFrame(rows, "seed string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_pages(spark, str(tmp_path / "in"), "seed string, ts timestamp", 1)
        crawl_seeds(stream, graph, str(tmp_path / "out"), str(tmp_path / "state"), 3, 6)
    got = crawled(graph, str(tmp_path / "out"))
    # When the watermark had passed it by an hour, n1 was forgotten, and crawled once more.
    once = {names[i]: 1 for i in (0, 2, 3, 5)} | {names[1]: 2}
    seeds = spark.createDataFrame([(s,) for s in once], "seed string")
    want = G.crawl_order(graph.lists, seeds, 3, 6, graph)
    expected = sorted(tuple(r) for r in want.collect() for _ in range(once[r.seed]))
    assert sorted(map(tuple, got.collect())) == expected
    assert got.filter(F.col("seed").isin(names[4], "http://h/unknown")).isEmpty()
