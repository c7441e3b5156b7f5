"""Links of a page, the link graph's edges and their degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.functions import markup as M
from pagetable.functions.entities import decode_attribute
from pagetable.functions.strings import let, positions, strip
from pagetable.functions.urls import absolute_links, is_binary_path, netloc, resolve_targets
from pagetable.sources.nodes import dom_nodes, is_text, subtree


def hrefs(html: Column) -> Column:
    """Decoded ``href`` of every ``<a>`` start tag, in order, found without leaving the JVM."""
    tags = F.regexp_extract_all(html, F.lit(M.ANCHORS), F.lit(3))

    def href(attributes: Column) -> Column:
        found = [F.regexp_extract(attributes, M.HREF, g) for g in (1, 2, 3)]
        return F.concat(*found)

    values = F.transform(F.filter(tags, lambda t: t != ""), href)
    return F.transform(F.filter(values, lambda v: v != ""), decode_attribute)


def hrefs_from_nodes(nodes: Column) -> Column:
    """The same list taken from the node array."""
    anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & (n["attrs"]["href"] != ""))
    return F.transform(anchors, lambda n: n["attrs"]["href"])


def follow(url: Column, references: Column) -> Column:
    """References to internal links: resolved, same site, not binary, distinct, sorted."""
    kept = let(
        netloc(url),
        lambda host: F.filter(
            resolve_targets(url, references),
            lambda t: (t["netloc"] == host) & ~is_binary_path(t["path"]),
        ),
    )
    return F.sort_array(F.array_distinct(F.transform(kept, lambda t: t["url"])))


def internal_links(pages: DataFrame, from_nodes: bool = False) -> DataFrame:
    """``page_id, url, links``. Map-only; the default path has no Python stage."""
    refs = (
        hrefs_from_nodes(dom_nodes(F.col("html"))) if from_nodes else hrefs(F.col("html"))
    )
    found = pages.select("page_id", "url", refs.alias("refs"))
    return found.select("page_id", "url", follow(F.col("url"), F.col("refs")).alias("links"))


def link_sets(pages: DataFrame) -> DataFrame:
    """``url, page_id, links`` with one row per URL, the adjacency lists that traversal walks.

    Of several copies of a page the one of least ``page_id`` counts.
    """
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).filter(F.col("page_id").isNotNull())
    found = internal_links(pages).filter(F.col("page_id").isNotNull())
    # Rows of one URL and one page_id too are copies: any of them will do, and mostly there is none.
    return found.join(first, ["url", "page_id"]).groupBy("url", "page_id").agg(F.any_value("links").alias("links"))


def link_edges(links: DataFrame) -> DataFrame:
    """``src, pos, dst``: link sets as edges, ``pos`` counting from 0."""
    exploded = links.select(F.col("url").alias("src"), positions("links").alias("pos", "dst"))
    return exploded.filter(F.col("pos").isNotNull())


def link_degrees(edges: DataFrame) -> DataFrame:
    """``url, out_degree, in_degree`` of every URL that occurs in an edge.

    Each edge counts once for both of its ends, so one map-side combined aggregation does it.
    """
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.url").alias("url")).agg(
        F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree")
    )


def links_with_text(url: Column, nodes: Column, most: int | None = None) -> Column:
    """``array<struct<href, text>>``: every link in document order with its anchor text.

    The page's first ``<base href>`` is what references are relative to, as in a loaded page.
    ``most`` keeps that many characters of the text.
    """
    bases = F.filter(
        nodes, lambda n: (n["tag"] == "base") & F.map_contains_key(n["attrs"], F.lit("href"))
    )
    stated = F.get(F.filter(absolute_links(url, F.transform(bases, lambda n: n["attrs"]["href"])),
                            lambda u: u.isNotNull()), F.lit(0))
    url = F.when(F.size(bases) > 0, F.coalesce(stated, url)).otherwise(url)
    anchors = F.filter(
        nodes, lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], F.lit("href"))
    )
    targets = absolute_links(url, F.transform(anchors, lambda n: n["attrs"]["href"]))

    def text(anchor: Column) -> Column:
        below = F.transform(
            F.filter(subtree(nodes, anchor), is_text), lambda n: n["text"]
        )
        whole = strip(F.array_join(below, ""))
        return whole if most is None else F.substring(whole, 1, most)

    return F.zip_with(
        targets, anchors, lambda href, a: F.struct(href.alias("href"), text(a).alias("text"))
    )


def page_links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``page_id, pos, href, text``: all links of each page, duplicates and other sites kept.

    ``most`` keeps that many characters of the text.
    """
    parsed = pages.select(
        "page_id", "url", dom_nodes(F.col("html"), spaces=True).alias("nodes")
    )
    links = parsed.select("page_id", links_with_text(F.col("url"), F.col("nodes"), most).alias("links"))
    exploded = links.select("page_id", positions("links").alias("pos", "link"))
    return exploded.filter(F.col("pos").isNotNull()).select(
        "page_id", "pos", "link.href", "link.text"
    )
