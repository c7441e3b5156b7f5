"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetable.session import Stage


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``node, label`` of every node in ``links`` (``a, b``), the label being its component's least node.

    Each round a node takes the least label around it and then that label's own label, so the number
    of rounds is about the logarithm of a component's diameter. Every round is written out, which
    cuts the lineage; neighbours' labels are combined map-side, so a node with very many links is no
    single task's work.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = both.groupBy("a").agg(F.min("b").alias("_least"))
    labels = start.select(F.col("a").alias("node"), F.least("a", "_least").alias("label"))
    labels = stage.save(labels, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        around = seen.groupBy("a").agg(F.min("label").alias("_around"))
        nearer = labels.join(around, F.col("node") == F.col("a"), "left").select(
            "node", "label", F.least("label", "_around").alias("_near")
        )
        owner = labels.select(F.col("node").alias("_near"), F.col("label").alias("_of"))
        moved = nearer.join(owner, "_near", "left").select(
            "node",
            F.least("_near", "_of").alias("label"),
            (F.least("_near", "_of") != F.col("label")).alias("_moved"),
        )
        moved = stage.save(moved, f"{name}-{turn}")
        labels = moved.select("node", "label")
        if moved.filter("_moved").isEmpty():
            return labels
