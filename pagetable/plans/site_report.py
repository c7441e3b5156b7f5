"""The flagship plan: map every site and describe each page on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagetable.operators.content import scrape
from pagetable.operators.traverse import site_tree
from pagetable.sources.fetch import with_record


def site_report(
    pages: DataFrame, seeds: DataFrame, link_lists: DataFrame, depth: int, limit: int | None = None
) -> DataFrame:
    """``root, url, depth, rank, n_links, title, text_length`` for every URL of every site."""
    tree = site_tree(pages, seeds, depth, limit, link_lists)
    # Pages are parsed where they lie; the ids that the walk carries find their records.
    records = scrape(pages).select("page_id", "title", "content_length")
    return with_record(tree, records, "url").select(
        "root",
        "url",
        "depth",
        "rank",
        F.size("links").alias("n_links"),
        "title",
        F.col("content_length").alias("text_length"),
    )
