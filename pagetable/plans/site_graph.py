"""A link graph over stored pages for tables whose hrefs lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetable.functions.urls import netloc
from pagetable.operators.ranking import ranked


def site_positions(pages: DataFrame) -> DataFrame:
    """``host, url, r``: each page's number within its host, by ``page_id``."""
    hosts = pages.select("page_id", "url", netloc(F.col("url")).alias("host"))
    return ranked(hosts, ["host"], ["page_id"], name="r").select("host", "url", "r")


def site_links(positions: DataFrame) -> DataFrame:
    """``url, links``: per host, page ``r`` links to pages ``2r``, ``2r + 1`` and ``r - 1``.

    Each page names the at most two pages that link to it, which takes one join on
    ``(host, r)`` and no self-product. At most three links per page are collected.
    """
    r = F.col("r")
    sources = F.when(r >= 2, F.array(F.shiftright(r, 1), r + 1)).otherwise(F.array(r + 1))
    targets = positions.select("host", F.explode(sources).alias("r"), F.col("url").alias("dst"))
    return (
        positions.join(targets, ["host", "r"], "left")
        .groupBy("url")
        .agg(F.sort_array(F.collect_set("dst")).alias("links"))
    )


def site_seeds(positions: DataFrame) -> DataFrame:
    """``seed``: the first page of every host."""
    return positions.filter(F.col("r") == 1).select(F.col("url").alias("seed"))
