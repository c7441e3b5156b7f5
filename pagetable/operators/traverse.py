"""Level-by-level walks of the link graph from many seeds at once: crawl and site map.

A walk runs over the ids of a :class:`LinkGraph`; URLs are joined back once, at its end. A level joins the frontier to
the bucketed adjacency arrays, which stay where they are, and moves ``(seed, id, place)`` as numbers. What a level
visits is written to the shared checkpoint folder under the id ranges it lies in; the next levels
read only the ranges that their own candidates lie in. The driver learns how many rows a level has in each partition and which
ranges it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pagetable.functions.urls import is_binary
from pagetable.operators.content import scrape
from pagetable.operators.links import link_sets
from pagetable.session import Stage
from pagetable.sources.fetch import fetched
from pagetable.sources.link_graph import LinkGraph, build_graph, is_stored, range_of

_VISIT = "seed long, id long, part int, idx long"


def _candidates(links: DataFrame, frontier: DataFrame, width: int) -> DataFrame:
    """``seed, id, place``: what the stored pages of ``frontier`` (``seed, id, order``) link to, each at its earliest place.

    A place is the order of the parent and that of the link in one number. Links to one target are combined map-side.
    """
    hits = frontier.filter(is_stored(F.col("id")))
    linked = links.join(hits, "id").select("seed", "order", F.posexplode("links").alias("pos", "id"))
    place = F.col("order") * F.lit(width).cast("long") + F.col("pos")
    return linked.groupBy("seed", "id").agg(F.min(place).alias("place"))


class _Walk:
    """The tables of one walk: per level, the visited ids in ``(seed, place)`` order.

    ``part`` is the number of the task that wrote a row and ``idx`` the row's place there. Tasks hold ranges of
    ``(seed, place)``, so with the rows of the tasks before, ``first[part]``, a row has a number in its level.
    """

    def __init__(self, graph: LinkGraph, stage: Stage) -> None:
        self.spark, self.graph, self.stage = graph.links.sparkSession, graph, stage
        self.first: list[list[int]] = []
        self._ranges: list[set[int]] = []

    def _path(self, level: int) -> str:
        return f"{self.stage.path('visited')}/level={level}"

    def add(self, rows: DataFrame, first: list[int] | None = None) -> int:
        """Writes the next level by id ranges and returns how many rows its numbers go up to."""
        met = Observation()
        path = self._path(len(self.first))
        seen = rows.withColumn("range", range_of(F.col("id")))
        seen = seen.observe(met, F.collect_set("range").alias("ranges"))
        seen.write.partitionBy("range").parquet(path)
        ranges = set(met.get["ranges"] or ())
        if first is None:
            first = _firsts(self.spark.read.schema(_VISIT).parquet(path)) if ranges else [0]
        self._ranges.append(ranges)
        self.first.append(first)
        return first[-1]

    def level(self, level: int) -> DataFrame:
        """``seed, id, order`` of one level."""
        rows = self.spark.read.schema(_VISIT).parquet(self._path(level))
        return rows.select("seed", "id", _order(self.first[level]).alias("order"))

    def seen(self, ranges: set[int]) -> DataFrame | None:
        """``seed, id`` of all levels within these ranges; no other file is read or listed."""
        paths = [
            f"{self._path(level)}/range={r}" for level, met in enumerate(self._ranges) for r in sorted(met & ranges)
        ]
        return self.spark.read.schema("seed long, id long").parquet(*paths) if paths else None

    def visits(self, seeds: DataFrame) -> DataFrame:
        """``seed, url, rank, depth, page_id`` of all levels."""
        offsets = [(level, part, n) for level, first in enumerate(self.first) for part, n in enumerate(first)]
        offsets = self.spark.createDataFrame(offsets, "level int, part int, first long")
        rows = self.spark.read.schema(f"{_VISIT}, level int").parquet(self.stage.path("visited"))
        placed = rows.join(F.broadcast(offsets), ["level", "part"]).select(
            "seed", "id", "level", (F.col("first") + F.col("idx")).alias("order")
        )
        # A seed's rows of one level are numbered without gaps.
        begin = placed.groupBy("seed", "level").agg(F.min("order").alias("begin"))
        ranked = placed.join(begin, ["seed", "level"])
        names = seeds.select(F.col("id").alias("seed"), F.col("url").alias("_seed"))
        found = ranked.join(names, "seed").join(self.graph.urls, "id", "left")
        return found.select(
            F.col("_seed").alias("seed"), F.coalesce("url", "_seed").alias("url"),
            (F.col("order") - F.col("begin") + 1).alias("rank"), F.col("level").alias("depth"), "page_id",
        )


def _order(first: list[int]) -> Column:
    """A row's number in its level."""
    return F.element_at(F.array(*[F.lit(n).cast("long") for n in first]), F.col("part") + 1) + F.col("idx")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of ``(seed, place)``, in order, with ``part`` and ``idx``."""
    dealt = rows.repartitionByRange("seed", "place").sortWithinPartitions("seed", "place")
    number = F.monotonically_increasing_id()
    return dealt.select(
        "seed", "id", F.shiftright(number, 33).cast("int").alias("part"),
        number.bitwiseAND(F.lit((1 << 33) - 1)).alias("idx"),
    )


def _firsts(rows: DataFrame) -> list[int]:
    """For each task's part, the number of rows in the parts before; one more for their total."""
    counts = dict(rows.groupBy("part").count().collect())
    first = [0]
    for part in range(max(counts, default=-1) + 1):
        first.append(first[-1] + counts.get(part, 0))
    return first


def _walk(
    graph: LinkGraph, seeds: DataFrame, depth: int, limit: int | None, failures_count: bool, stage: Stage
) -> DataFrame:
    """``seed, url, rank, depth, page_id`` of at most ``limit`` URLs per seed down to ``depth``.

    ``page_id`` is null for a URL that is not stored. A level keeps the first URLs that fit in the room
    left and drops the rest for good. With ``failures_count`` every visited URL takes up room, else
    only the stored ones do.
    """
    start = seeds.select(F.col("seed").alias("url")).distinct().filter(~is_binary(F.col("url")))
    if limit is not None and limit <= 0:
        start = start.limit(0)
    # A seed that the graph does not know has no page: any other odd number will do.
    unknown = -1 - F.shiftleft(F.monotonically_increasing_id(), 1)
    start = start.join(graph.urls.select("url", "id"), "url", "left")
    start = stage.save(start.select("url", F.coalesce("id", unknown).alias("id")), "seeds")
    walk, width = _Walk(graph, stage), max(graph.most_links, 1)
    walk.add(start.select(F.col("id").alias("seed"), "id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("idx")), [0])
    room = None
    for level in range(1, depth + 1):
        frontier = walk.level(level - 1)
        if limit is not None:
            taken = frontier if failures_count else frontier.filter(is_stored(F.col("id")))
            taken = taken.groupBy("seed").agg(F.count("*").alias("taken"))
            before = start.select(F.col("id").alias("seed"), F.lit(limit).cast("long").alias("n")) if room is None else room
            left = before.join(taken, "seed", "left").select("seed", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
            room = stage.save(left.filter("n > 0"), f"room-{level}")
            frontier = frontier.join(room.select("seed"), "seed", "left_semi")
        met = Observation()
        found = _candidates(graph.links, frontier, width).observe(
            met, F.count("*").alias("n"), F.collect_set(range_of(F.col("id"))).alias("ranges")
        )
        found = stage.save(found, f"candidates-{level}")
        if not met.get["n"]:
            break
        seen = walk.seen(set(met.get["ranges"]))
        fresh = found if seen is None else found.join(seen, ["seed", "id"], "left_anti")
        if limit is None:
            n = walk.add(_numbered(fresh))
        else:
            rows = stage.save(_numbered(fresh), f"numbered-{level}")
            first = _firsts(rows)
            begin = rows.groupBy("seed").agg(F.min(_order(first)).alias("begin"))
            kept = rows.join(begin, "seed").join(room, "seed").filter(_order(first) - F.col("begin") < F.col("n"))
            n = walk.add(kept.select("seed", "id", "part", "idx"), first)
        if n == 0:
            break
        if n * width >= 1 << 63:
            raise ValueError("too many URLs in one level of a walk")
    return walk.visits(start)


def _stored(visited: DataFrame) -> DataFrame:
    return visited.filter(F.col("page_id").isNotNull())


def _graph_of(pages: DataFrame, links: DataFrame | LinkGraph | None) -> LinkGraph:
    """The graph to walk: a given one, or one of the adjacency lists ``url, links``, or of the pages' own links.

    Lists and pages settle what is stored: URLs that have both a page and a list. Of lists given for one URL
    several times the least counts, and links with a binary suffix are not followed.
    """
    if isinstance(links, LinkGraph):
        return links
    if links is None:
        return build_graph(link_sets(fetched(pages)))
    ids = fetched(pages).groupBy("url").agg(F.min("page_id").alias("page_id"))
    lists = links.groupBy("url").agg(F.min("links").alias("links"))
    followed = F.filter("links", lambda u: ~is_binary(u)).alias("links")
    return build_graph(lists.join(ids, "url").select("url", "page_id", followed))


def crawl_order(
    pages: DataFrame,
    seeds: DataFrame,
    depth: int = 1,
    limit: int | None = 10,
    link_lists: DataFrame | LinkGraph | None = None,
) -> DataFrame:
    """``seed, depth, rank, url, page_id`` of the pages a crawl from each seed returns.

    Results come in the order of ``(depth, rank)``. ``limit`` counts stored pages only, a URL
    without one is visited but yields nothing; ``None`` is no limit.
    """
    stage = Stage(pages.sparkSession, "crawl")
    walk = _walk(_graph_of(pages, link_lists), seeds, depth, limit, False, stage)
    return _stored(walk).select("seed", "depth", "rank", "url", "page_id")


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    fmt: str = "text",
    depth: int = 1,
    limit: int | None = 10,
    link_lists: DataFrame | LinkGraph | None = None,
) -> DataFrame:
    """Page records of a crawl, with ``seed, depth, rank``.

    The walk carries the ids of the pages it returns. Pages are parsed where they lie, so HTML is never
    shuffled; only their records move, each once however many seeds share it.
    """
    order = crawl_order(pages, seeds, depth, limit, link_lists)
    return order.join(scrape(fetched(pages), fmt).drop("url"), "page_id")


def site_visits(
    pages: DataFrame,
    seeds: DataFrame,
    depth: int = 2,
    limit: int | None = 50,
    link_lists: DataFrame | LinkGraph | None = None,
) -> DataFrame:
    """``root, url, depth, rank, page_id``: one row per visited URL; ``page_id`` is null where none is stored."""
    return _site(pages, seeds, depth, limit, link_lists)[0]


def _site(pages, seeds, depth, limit, link_lists) -> tuple[DataFrame, DataFrame]:
    stage = Stage(pages.sparkSession, "site-map")
    graph = _graph_of(pages, link_lists)
    walk = _walk(graph, seeds, depth, limit, True, stage)
    return walk.select(F.col("seed").alias("root"), "url", "depth", "rank", "page_id"), graph.lists


def site_tree(
    pages: DataFrame,
    seeds: DataFrame,
    depth: int = 2,
    limit: int | None = 50,
    link_lists: DataFrame | LinkGraph | None = None,
) -> DataFrame:
    """``root, url, depth, rank, page_id, links``: one row per visited URL with all its internal links.

    ``limit`` counts visited URLs, stored or not; ``None`` is no limit. This is the form for sites
    of any size.
    """
    visits, links = _site(pages, seeds, depth, limit, link_lists)
    tree = visits.join(links.select("url", "links"), "url", "left")
    none = F.array().cast("array<string>")
    return tree.select("root", "url", "depth", "rank", "page_id", F.coalesce("links", none).alias("links"))


def site_totals(visits: DataFrame) -> DataFrame:
    """``root, total_urls`` of a site tree or its visits."""
    return visits.groupBy("root").agg(F.count("*").alias("total_urls"))


def site_map(
    pages: DataFrame,
    seeds: DataFrame,
    depth: int = 2,
    limit: int = 50,
    link_lists: DataFrame | LinkGraph | None = None,
) -> DataFrame:
    """One record per root: ``root, total_urls, urls, tree``.

    A record holds at most ``limit`` URLs; use :func:`site_tree` for whole sites.
    """
    rows = site_tree(pages, seeds, depth, limit, link_lists)
    maps = rows.groupBy("root").agg(
        F.count("*").alias("total_urls"),
        F.sort_array(F.collect_list("url")).alias("urls"),
        F.map_from_entries(F.collect_list(F.struct("url", "links"))).alias("tree"),
    )
    no_links = F.array().cast("array<string>")
    return (
        seeds.select(F.col("seed").alias("root")).distinct().join(maps, "root", "left").select(
            "root",
            F.coalesce("total_urls", F.lit(0).cast("long")).alias("total_urls"),
            F.coalesce("urls", no_links).alias("urls"),
            F.coalesce("tree", F.create_map("root", no_links)).alias("tree"),
        )
    )
