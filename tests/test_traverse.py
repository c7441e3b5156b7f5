"""Crawl and site map against a plain breadth-first walk."""

import random

import pytest
from pyspark.sql import functions as F

from pagetable.functions.urls import BINARY_SUFFIXES
from pagetable.operators import traverse as G
from pagetable.operators.ranking import first_per_group, ranked
from pagetable.plans.site_graph import site_links, site_positions, site_seeds
from pagetable.plans.site_report import site_report
from pagetable.sources.link_graph import build_graph, is_stored, open_graph
from pagetable.sources.tables import save_link_table

HOST = "http://h/"
GRAPH = {"s": "abc", "a": "ds", "c": "e", "d": "f", "e": "", "f": ""}  # b is not stored


def frames(spark, graph, seeds):
    pages = spark.createDataFrame(
        [(i, HOST + u, f"<title>{u}</title>") for i, u in enumerate(graph)],
        "page_id long, url string, html string",
    )
    links = spark.createDataFrame(
        [(HOST + u, sorted(HOST + v for v in vs)) for u, vs in graph.items()],
        "url string, links array<string>",
    )
    return pages, spark.createDataFrame([(HOST + s,) for s in seeds], "seed string"), links


def walk(graph, seed, depth, limit, failures_count):
    """Visited URLs in order, level by level; the oracle for both operators."""
    visited, level, stored = [], [seed], []
    for d in range(depth + 1):
        used = len(visited if failures_count else stored)
        fresh = [
            u for u in dict.fromkeys(level)
            if u not in visited and not u.endswith(tuple("." + s for s in BINARY_SUFFIXES))
        ]
        batch = fresh if limit is None else fresh[: max(0, limit - used)]
        visited += batch
        stored += [u for u in batch if u in graph]
        level = [v for u in batch if u in graph and d < depth for v in sorted(graph[u])]
    return visited, stored


def crawled(spark, graph, seeds, depth, limit):
    rows = G.crawl_order(*frames(spark, graph, seeds)[:2], depth, limit,
                         frames(spark, graph, seeds)[2]).collect()
    out = {s: [] for s in seeds}
    for r in sorted(rows, key=lambda r: (r.depth, r.rank)):
        out[r.seed.removeprefix(HOST)].append(r.url.removeprefix(HOST))
    return out


@pytest.mark.parametrize(
    "depth, limit, urls",
    [(0, 10, "s"), (1, 10, "sac"), (2, 10, "sacde"), (2, 3, "sad"), (1, 0, "")],
)
def test_crawl_cases(spark, depth, limit, urls):
    assert crawled(spark, GRAPH, "s", depth, limit)["s"] == list(urls)


@pytest.mark.parametrize("depth, limit, urls", [(1, 50, "abcs"), (2, 3, "abs")])
def test_map_cases(spark, depth, limit, urls):
    pages, seeds, links = frames(spark, GRAPH, "s")
    row = G.site_map(pages, seeds, depth, limit, links).first()
    assert row.total_urls == len(urls)
    assert row.urls == [HOST + u for u in urls]
    assert row.tree[HOST + "b"] == []
    assert row.tree[HOST + "s"] == [HOST + u for u in "abc"]


def test_binary_seed(spark):
    pages, _, links = frames(spark, GRAPH, "s")
    seeds = spark.createDataFrame([("http://h/f.pdf",)], "seed string")
    row = G.site_map(pages, seeds, link_lists=links).first()
    assert (row.total_urls, row.urls, row.tree) == (0, [], {"http://h/f.pdf": []})
    assert G.crawl_order(pages, seeds, link_lists=links).count() == 0


def test_random_graphs_many_seeds(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(30)] + ["x.pdf", "gone1", "gone2"]
    graph = {u: rng.sample(names, rng.randint(0, 5)) for u in names[:30]}
    seeds = names[:4] + ["gone1"]
    pages, seed_frame, links = frames(spark, graph, seeds)
    for depth, limit in ((4, None), (3, 7)):
        crawl = crawled(spark, graph, seeds, depth, limit)
        tree = G.site_tree(pages, seed_frame, depth, limit, links).collect()
        for s in seeds:
            assert crawl[s] == walk(graph, s, depth, limit, False)[1]
            mine = sorted((r.depth, r.rank, r.url) for r in tree if r.root == HOST + s)
            visited = walk(graph, s, depth, limit, True)[0]
            assert [u.removeprefix(HOST) for _, _, u in mine] == visited
            ranks = [k for d in range(depth + 1) for k in sorted(r for e, r, _ in mine if e == d)]
            assert ranks == [k + 1 for d in range(depth + 1)
                             for k in range(sum(e == d for e, _, _ in mine))]


def test_crawl_parses_links_from_pages_and_survives_copies(spark):
    html = "<title>{}</title><a href='/b'></a><a href='/a'></a><a href='/x.zip'></a>"
    rows = [(i, f"http://h/{u}", html.format(f"{u}{i}")) for i, u in enumerate("aabbb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://h/a",), ("http://h/a",)], "seed string")
    got = G.crawl(pages, seeds, depth=2).orderBy("depth", "rank").collect()
    assert [(r.url, r.title, r.content) for r in got] == [
        ("http://h/a", "a0", "a0"), ("http://h/b", "b2", "b2")
    ]
    report = site_report(pages, seeds, G.link_sets(pages), 2).orderBy("depth").collect()
    assert [(r.url, r.n_links, r.title, r.text_length) for r in report] == [
        ("http://h/a", 2, "a0", 2), ("http://h/b", 2, "b2", 2)
    ]


def test_error_pages_are_followed_and_empty_ones_are_not(spark):
    rows = [(0, "http://h/a", "<a href=/b></a><a href=/c></a><a href=/d></a>", 500),
            (1, "http://h/b", "", 404), (2, "http://h/c", None, None), (3, "http://h/d", "", 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int")
    seeds = spark.createDataFrame([("http://h/a",)], "seed string")
    got = G.crawl(pages, seeds, depth=1).orderBy("depth", "rank").collect()
    assert [(r.url, r.error) for r in got] == [("http://h/a", "HTTP 500"), ("http://h/d", None)]
    assert G.site_map(pages, seeds, 1).first().total_urls == 4


def test_ranked_equals_row_number(spark):
    """Of one group holding most rows, and with limits."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.randint(0, 99), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, major long, minor long")
    limits = spark.createDataFrame([("hot", 123), ("cold", 5)], "g string, n long")
    for cut in (None, limits):
        got = ranked(df, ["g"], ["major", "minor"], cut).collect()
        for g, n in (("hot", 123), ("cold", 5)):
            mine = sorted((r["rank"], r.major, r.minor) for r in got if r.g == g)
            want = sorted((m, i) for k, m, i in rows if k == g)[: n if cut else None]
            assert mine == [(k + 1, m, i) for k, (m, i) in enumerate(want)]


@pytest.mark.parametrize("k", [3, 1200])
def test_first_per_group(spark, k):
    df = spark.range(4000).select(F.expr("id % 3 = 0").alias("g"), "id")
    got = first_per_group(df, ["g"], [F.desc("id")], k).groupBy("g").agg(
        F.count("*"), F.min("id"), F.max("rank")
    )
    multiples = [i for i in range(3999, -1, -1) if i % 3 == 0][:k]
    others = [i for i in range(3999, -1, -1) if i % 3][:k]
    assert sorted(map(tuple, got.collect())) == [
        (False, k, others[-1], k), (True, k, multiples[-1], k)
    ]


def test_site_graph(spark):
    urls = [f"http://{h}/{i}" for i in range(6) for h in ("p", "q")][:11]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    positions = site_positions(pages)
    assert sorted(r.seed for r in site_seeds(positions).collect()) == ["http://p/0", "http://q/0"]
    links = {r.url: r.links for r in site_links(positions).collect()}
    assert set(links) == set(urls)
    for h, n in (("p", 6), ("q", 5)):
        for i in range(n):
            r = i + 1
            want = [f"http://{h}/{t - 1}" for t in (2 * r, 2 * r + 1, r - 1) if 1 <= t <= n]
            assert links[f"http://{h}/{i}"] == sorted(want)


def test_bucketed_links_are_not_shuffled(spark):
    pages, seeds, links = frames(spark, GRAPH, "s")
    table = save_link_table(links, "link_table", 4)
    assert G.crawl_order(pages, seeds, 2, 10, table).count() == 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = seeds.withColumnRenamed("seed", "url").join(table, "url")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE link_table")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def graph_of(spark, graph, **options):
    pages, seeds, links = frames(spark, graph, graph)
    ids = pages.select("url", "page_id")
    return pages, seeds, build_graph(links.join(ids, "url").select("url", "page_id", "links"), **options)


def test_new_urls_are_combined_before_the_shuffle(spark, no_broadcast):
    """A level moves numbers only, combined map-side, and nothing of the adjacency table."""
    _, _, graph = graph_of(spark, GRAPH, buckets=4)
    frontier = spark.range(3).select(F.col("id").alias("seed"), "id", F.lit(0).cast("long").alias("order"))
    found = G._candidates(graph.links, frontier.repartition(3), 9)
    plan = plans(found)
    assert "partial_min" in plan and "LeftAnti" not in plan and "SortMergeJoin" in plan
    # One exchange of the frontier to the buckets, one of the combined candidates.
    assert plan.count("Exchange hashpartitioning") == 2 and "SelectedBucketsCount" in plan.replace(" ", "")
    for field in found.schema.fields + frontier.schema.fields:
        assert field.dataType.typeName() == "long"
    source = graph.links.select("id", "links")
    assert "Exchange" not in plans(source.join(source.withColumnRenamed("links", "more"), "id"))


def test_ids_tell_what_is_stored(spark):
    _, _, graph = graph_of(spark, GRAPH)
    urls = {r.url.removeprefix(HOST): r for r in graph.urls.withColumn("stored", is_stored(F.col("id"))).collect()}
    assert set(urls) == set("sabcdef") and not urls["b"].stored and urls["b"].page_id is None
    assert all(urls[u].stored and urls[u].page_id is not None for u in "sacdef")
    assert len({r.id for r in urls.values()}) == 7
    links = {r.id: r.links for r in graph.links.collect()}
    assert links[urls["s"].id] == [urls[v].id for v in "abc"] and urls["e"].id not in links


def test_a_stored_graph_is_walked_again(spark, tmp_path):
    pages, seeds, graph = graph_of(spark, GRAPH, folder=str(tmp_path / "g"), buckets=3)
    again = open_graph(spark, graph.folder, graph.buckets, graph.most_links)
    for links in (graph, again):
        found = G.crawl_order(pages, seeds, 4, None, links).collect()
        for s in GRAPH:
            got = [r.url.removeprefix(HOST) for r in sorted(found, key=lambda r: (r.depth, r.rank)) if r.seed == HOST + s]
            assert got == walk(GRAPH, s, 4, None, False)[1]
    again.forget()


def test_levels_of_a_long_chain_read_their_own_ranges_only(spark, monkeypatch):
    """Over a chain of depth 30 a level reads what lies in its candidates' range, however much was visited before."""
    n = 31
    names = [f"{i:03d}" for i in range(n)]
    graph = {u: names[i + 1 : i + 2] + (names[i - 1 : i] if i else []) for i, u in enumerate(names)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        pages, _, whole = graph_of(spark, graph)
        read = []
        real = G._Walk.seen

        def seen(self, ranges):
            found = real(self, ranges)
            read.append((len(ranges), sum(map(len, self._ranges)), 0 if found is None else len(found.inputFiles())))
            return found

        monkeypatch.setattr(G._Walk, "seen", seen)
        start = spark.createDataFrame([(HOST + names[0],)], "seed string")
        got = G.crawl_order(pages, start, n, None, whole).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.url.removeprefix(HOST) for r in sorted(got, key=lambda r: r.depth)] == names
    assert len(read) >= n - 1 and max(x[0] for x in read) <= 2
    # 31 levels were visited; a range holds about a fourth to an eighth of them.
    assert max(x[2] for x in read) <= 20 and read[-1][1] >= 30


def test_crawl_needs_both_list_and_page_and_takes_a_list_once(spark):
    """A listed URL without a page yields nothing; a URL listed twice is visited once."""
    pages, seeds, links = frames(spark, GRAPH, "s")
    links = links.union(links).union(
        spark.createDataFrame([(HOST + "b", [HOST + "z"])], links.schema)
    )
    got = G.crawl(pages, seeds, depth=1, limit=10, link_lists=links).orderBy("depth", "rank")
    assert [r.url.removeprefix(HOST) for r in got.collect()] == ["s", "a", "c"]


def test_html_is_scanned_once_and_not_shuffled(spark, tmp_path):
    pages, seeds, links = frames(spark, GRAPH, "s")
    pages.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.crawl(pages, seeds, link_lists=links)._jdf.queryExecution().optimizedPlan()
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    html = next(part for part in text.split("html#")[1:])[:4].strip(",] ")
    assert text.count("Relation") >= 1 and html
    joins = [i for i, line in enumerate(text.splitlines()) if "Join " in line]
    parse = [i for i, line in enumerate(text.splitlines()) if "EvalPython" in line]
    assert parse and max(joins) < min(parse)
