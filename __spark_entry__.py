"""

Each query reads whole given tables, or tables Spark derives from them.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagetable.functions import urls as U
from pagetable.operators import content as C
from pagetable.operators import extract as X
from pagetable.operators import links as L
from pagetable.operators import login, profiles, search, search_index
from pagetable.operators import traverse as G
from pagetable.plans.site_graph import site_links, site_positions, site_seeds
from pagetable.plans.site_report import site_report
from pagetable.session import Stage, tune
from pagetable.sources import fetch, sinks
from pagetable.sources.link_graph import build_graph
from pagetable.sources.nodes import with_nodes
from pagetable.sources.page_store import store_pages
from pagetable.sources.pages import read_pages
from pagetable.streaming.crawl import crawl_seeds, crawled
from pagetable.streaming.pages import new_urls, run_available, stream_pages

SCHEMA = "article: title=h1, first=p"
LIST_SCHEMA = {
    "baseSelector": "nav > ul li",
    "fields": [
        {"name": "label", "selector": "a[href^='/']", "type": "text"},
        {"name": "odd", "selector": "li:nth-child(odd) > a", "type": "text"},
        {"name": "absent", "selector": "h2, h3.x", "type": "text"},
    ],
}
PAGE_QUERY, DOC_QUERY, POST_QUERY = "The of, and!", "stand the une", "the"
HANDLE = "@Customer#000000007"
PAGE_STATUS = "element_at(array(200, 200, 404, 200, 503), cast(page_id % 5 as int) + 1)"

CRAWL_DEPTH, CRAWL_LIMIT, MAP_LIMIT = 3, 5, 4
FULL_DEPTH = 4
START = 1704067200  # seconds; a stream takes nothing from before 1970


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def _with_status(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status_code", F.expr(PAGE_STATUS))


# --- URLs ---------------------------------------------------------------------------------


def url_parts(spark, sf_dir):
    parts = U.split_url(F.col("url"))
    return _page_urls(spark, sf_dir).select("page_id", parts.alias("p")).select("page_id", "p.*")


def same_site(spark, sf_dir):
    """Each page against the next one, and against variants of its own URL."""
    pages = _page_urls(spark, sf_dir).select("page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    url = F.col("url")
    return pages.join(following, "page_id").select(
        "page_id",
        U.same_site(url, F.col("next")).alias("with_next"),
        U.same_site(url, F.regexp_replace(url, "^https?:", "ftp:")).alias("other_scheme"),
        U.same_site(url, F.regexp_replace(url, "^(https?://)", "$1www.")).alias("www"),
        U.same_site(url, F.regexp_replace(url, "^(https?://[^/]+)", "$1:80")).alias("port"),
    )


HREF_CASES = (
    "", "#top", "javascript:void(0)", "mailto:q@a.com", "//c.com/z", "/k#frag", " /pad ",
    "?p=2", "k", "../k", "./a//b/../c", "http://b.com/x?y#z", "HTTPS://b.com/", "/../up",
)


def normalized_urls(spark, sf_dir):
    """Every page as the base of every kind of reference."""
    cases = F.array(*[F.lit(h) for h in HREF_CASES])
    resolved = F.zip_with(
        cases,
        U.resolve_targets(F.col("url"), cases),
        lambda h, t: F.struct(h.alias("href"), t["url"].alias("resolved")),
    )
    rows = _page_urls(spark, sf_dir).select("page_id", F.explode(resolved).alias("r"))
    return rows.select("page_id", "r.*")


SUFFIX_CASES = (
    "/f.PDF", "/f.pdf?x=1", "/f?file=x.pdf", "/f.tar.gz", "/f.html", "/f.js", "/f.json",
    "/d.zip/", "/f.docx#a", "/f.css;v=2",
)


def binary_urls(spark, sf_dir):
    variants = F.explode(F.array(*[F.lit(s) for s in SUFFIX_CASES])).alias("suffix")
    rows = _page_urls(spark, sf_dir).select("page_id", "url", variants)
    url = F.concat(F.regexp_extract("url", r"^https?://[^/?#]+", 0), "suffix")
    return rows.select("page_id", "suffix", U.is_binary(url).alias("is_binary"))


# --- Sources ------------------------------------------------------------------------------


def page_lookup(spark, sf_dir):
    """Stored URLs and as many that are not stored, looked up."""
    pages = _pages(spark, sf_dir)
    missing = pages.select(F.concat("url", F.lit("/missing")).alias("url"))
    found = fetch.lookup(pages.select("url").union(missing), pages)
    return found.select("url", "page_id", F.length("html").alias("n_chars"))


def page_store_lookup(spark, sf_dir):
    """The same over pages kept in buckets by URL."""
    pages = _pages(spark, sf_dir)
    missing = pages.select(F.concat("url", F.lit("/missing")).alias("url"))
    found = fetch.lookup(pages.select("url").union(missing), store_pages(pages))
    return found.select("url", "page_id", F.length("html").alias("n_chars"))


def status_labels(spark, sf_dir):
    pages = _with_status(_page_urls(spark, sf_dir).select("page_id"))
    return pages.withColumn("error", fetch.status_error(F.col("status_code")))


def fetch_outcomes(spark, sf_dir):
    """Events read as a fetch log."""
    kind = (
        F.when(F.col("event_type") == "error", "timeout")
        .when(F.col("event_type") == "click", "connection")
        .when(F.col("event_type") == "purchase", "request")
        .when(F.col("event_type") == "signup", F.when(F.col("value") < 10, "url").otherwise("dns"))
    )
    log = _table(spark, sf_dir, "events").select(
        F.when(F.col("value") < 20, 200).when(F.col("value") < 60, 404).otherwise(500)
        .alias("status_code"),
        kind.alias("error_kind"),
        F.concat(F.lit("code "), F.get_json_object("props", "$.k")).alias("detail"),
    )
    return fetch.fetch_outcomes(log)


# --- Page text ----------------------------------------------------------------------------


def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.title(F.col("html")).alias("title"))


def _text_query(fn):
    def query(spark, sf_dir):
        nodes = with_nodes(_pages(spark, sf_dir), elements=False)
        return nodes.select("page_id", fn(F.col("nodes")).alias("text"))

    return query


def scrape_text(spark, sf_dir):
    return C.scrape(_with_status(_pages(spark, sf_dir)), "text")


def scrape_json(spark, sf_dir):
    return C.scrape(_pages(spark, sf_dir), "json")


def scrape_markdown(spark, sf_dir):
    return C.scrape(_pages(spark, sf_dir), "markdown")


def snapshot(spark, sf_dir):
    return C.snapshot(_pages(spark, sf_dir))


# --- Links --------------------------------------------------------------------------------


def internal_links(spark, sf_dir):
    found = L.internal_links(_pages(spark, sf_dir))
    return found.select("page_id", "url", F.array_join("links", "\n").alias("links"))


def internal_links_from_nodes(spark, sf_dir):
    found = L.internal_links(_pages(spark, sf_dir), from_nodes=True)
    return found.select("page_id", "url", F.array_join("links", "\n").alias("links"))


def link_edges(spark, sf_dir):
    return L.link_edges(L.link_sets(_pages(spark, sf_dir)))


def link_degrees(spark, sf_dir):
    return L.link_degrees(link_edges(spark, sf_dir))


def page_links(spark, sf_dir):
    return L.page_links(_pages(spark, sf_dir))


# --- Traversal ----------------------------------------------------------------------------


def _site_graph(spark, sf_dir):
    """Pages, seeds and adjacency lists; every page also links to one URL that is not stored."""
    pages = _pages(spark, sf_dir)
    stage = Stage(spark, "site-graph")
    positions = stage.save(site_positions(_page_urls(spark, sf_dir)), "positions")
    gone = F.array(F.concat(F.lit("http://"), U.netloc(F.col("url")), F.lit("/gone")))
    links = site_links(positions).select(
        "url", F.sort_array(F.array_union("links", gone)).alias("links")
    )
    return pages, site_seeds(positions), stage.save(links, "links")


def crawl_limited(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    return G.crawl_order(pages, seeds, CRAWL_DEPTH, CRAWL_LIMIT, links).drop("page_id")


def crawl_records(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    found = G.crawl(pages, seeds, "text", FULL_DEPTH, None, links)
    return found.select("seed", "depth", "rank", "url", "title", "content", "content_length")


def site_tree(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    tree = G.site_tree(pages, seeds, FULL_DEPTH, None, links)
    return tree.drop("page_id").withColumn("links", F.array_join("links", "\n"))


def site_tree_limited(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    tree = G.site_tree(pages, seeds, CRAWL_DEPTH, MAP_LIMIT, links)
    return tree.drop("page_id").withColumn("links", F.array_join("links", "\n"))


def site_totals(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    return G.site_totals(G.site_visits(pages, seeds, FULL_DEPTH, None, links))


def site_map(spark, sf_dir):
    pages, seeds, links = _site_graph(spark, sf_dir)
    maps = G.site_map(pages, seeds, CRAWL_DEPTH, MAP_LIMIT, links)
    entries = F.transform(
        F.map_entries("tree"),
        lambda e: F.concat(e["key"], F.lit(" -> "), F.array_join(e["value"], " ")),
    )
    return maps.select(
        "root",
        "total_urls",
        F.array_join("urls", "\n").alias("urls"),
        F.array_join(F.sort_array(entries), "\n").alias("tree"),
    )


def flagship(spark, sf_dir):
    """Every site mapped to full depth, each URL with its title and clean-text length."""
    pages, seeds, links = _site_graph(spark, sf_dir)
    return site_report(pages, seeds, links, FULL_DEPTH)


# --- Extraction ---------------------------------------------------------------------------


def extract_rows(spark, sf_dir):
    return X.extract_rows(_pages(spark, sf_dir), SCHEMA)


def extract_lists(spark, sf_dir):
    return X.extract_rows(_pages(spark, sf_dir), LIST_SCHEMA)


def extract_pages(spark, sf_dir):
    found = X.extract(_with_status(_pages(spark, sf_dir)), SCHEMA)
    return found.withColumn("data", F.to_json("data"))


def extract_none(spark, sf_dir):
    """A base selector that matches no page."""
    found = X.extract(_pages(spark, sf_dir), "table.results: a=td, b=th")
    return found.select("page_id", F.size("data").alias("n"), "error")


def scrape_with_schema(spark, sf_dir):
    return X.scrape_with_schema(_pages(spark, sf_dir), SCHEMA).drop("data")


# --- Search, posts, profiles --------------------------------------------------------------


def _page_documents(spark, sf_dir):
    records = C.scrape(_pages(spark, sf_dir))
    return records.select(F.col("page_id").alias("id"), "title", "url", F.col("content").alias("text"))


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("url"),
        "text",
    )


def search_pages(spark, sf_dir):
    return search.search(_page_documents(spark, sf_dir), PAGE_QUERY)


def search_documents(spark, sf_dir):
    return search.search(_documents(spark, sf_dir), DOC_QUERY, 20)


def search_bm25(spark, sf_dir):
    return search.search_bm25(_documents(spark, sf_dir), DOC_QUERY, 20)


def search_bm25_indexed(spark, sf_dir):
    """The same from an inverted index over the documents."""
    return search_index.search_bm25_indexed(search_index.build_word_index(_documents(spark, sf_dir)), DOC_QUERY, 20)


def _posts(spark, sf_dir):
    """Conversation turns read as posts."""
    return _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(1704067200 + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
        F.nullif(F.col("role"), F.lit("system")).alias("username"),
        F.when(F.col("role") == "user", F.lit("User")).alias("display_name"),
        F.col("text").alias("content"),
        F.length("text").cast("long").alias("likes"),
        F.col("turn").alias("retweets"),
        (F.col("conv_id") % 7).alias("replies"),
        F.concat(F.lit("https://posts.example/"), "conv_id", F.lit("/"), "turn").alias("url"),
    )


def _shown_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def post_search(spark, sf_dir):
    return _shown_date(search.post_search(_posts(spark, sf_dir), POST_QUERY))


def post_search_indexed(spark, sf_dir):
    """The same from an index of trigrams."""
    index = search_index.build_substring_index(_posts(spark, sf_dir))
    return _shown_date(search_index.post_search_indexed(index, POST_QUERY))


def _users_and_activity(spark, sf_dir):
    """Customers read as users, events as their posts."""
    users = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("handle")
    )
    activity = _table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("id"),
        "ts",
        F.lit(None).cast("string").alias("username"),
        F.lit(None).cast("string").alias("display_name"),
        F.col("event_type").alias("content"),
        F.get_json_object("props", "$.k").cast("long").alias("likes"),
        F.floor("value").alias("retweets"),
        F.lit(0).cast("long").alias("replies"),
        F.concat(F.lit("https://posts.example/"), "event_id").alias("url"),
    )
    return users, activity


def user_timeline(spark, sf_dir):
    users, activity = _users_and_activity(spark, sf_dir)
    return _shown_date(search.timeline(users, activity, HANDLE))


def user_timelines(spark, sf_dir):
    users, activity = _users_and_activity(spark, sf_dir)
    known = users.select(F.concat(F.lit("@"), "handle").alias("handle"))
    handles = known.union(users.filter("id % 10 = 0").select(F.concat("handle", F.lit("x"))))
    return _shown_date(search.timelines(users, activity, handles))


def profile_records(spark, sf_dir):
    """Orders read as one-job profiles; finished ones have no education, open ones no end date."""
    raw = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://profiles.example/"), "o_orderkey").alias("url"),
        F.concat(F.lit("Person "), "o_custkey").alias("name"),
        F.lit(None).cast("string").alias("about"),
        F.col("o_orderpriority").alias("headline"),
        F.lit("").alias("location"),
        F.col("o_orderstatus").alias("company"),
        F.lower("o_orderpriority").alias("job_title"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.array(
                F.struct(
                    F.col("o_orderpriority").alias("position"),
                    F.col("o_orderstatus").alias("company_name"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("from_date"),
                    F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy"))
                    .alias("to_date"),
                )
            ),
        ).alias("experiences"),
        F.when(
            F.col("o_orderstatus") != "F",
            F.array(
                F.struct(
                    F.lit("School").alias("institution"), F.col("o_orderstatus").alias("degree")
                )
            ),
        ).alias("educations"),
    )
    shaped = profiles.profiles(raw)
    return shaped.select(
        "url", "name", "about", "headline", "location", "company", "job_title",
        F.to_json("experiences").alias("experiences"), F.to_json("education").alias("education"),
    )


LOGIN_FORMS = (
    '<form><input type=email name=m><input type="password"><button>Go</button></form>',
    '<form><INPUT NAME="UserEMAIL"><input type=submit value="Next"></form>'
    '<p role=alert>Wrong <b>password</b></p>',
    '<form hidden><input type=email><input type=password><button>Log in</button></form>',
    '<input type=text disabled><input id=login-box><button type=button>Cancel</button>'
    '<div class="FormError"></div><p id=error2>No</p>',
)


def login_forms(spark, sf_dir):
    """Every page with one of four forms put in front of its article."""
    form = F.element_at(
        F.array(*[F.lit(f) for f in LOGIN_FORMS]), (F.col("page_id") % 4 + 1).cast("int")
    )
    pages = _pages(spark, sf_dir).select(
        "page_id", F.replace("html", F.lit("<article>"), F.concat(form, F.lit("<article>")))
        .alias("html"),
    )
    return login.login_forms(pages)


# --- Sinks and streams --------------------------------------------------------------------


def json_lines(spark, sf_dir):
    """Links written as JSON lines and read back as text."""
    path = Stage(spark, "json-lines").path("links")
    sinks.write_json_lines(L.internal_links(_pages(spark, sf_dir)), path)
    return spark.read.text(path)


def json_array(spark, sf_dir):
    hits = search_documents(spark, sf_dir).select("score", "id", "title", "url")
    return sinks.json_array(hits, ["id"], 20)


def json_array_pretty(spark, sf_dir):
    hits = search_documents(spark, sf_dir).select("score", "id", "title", "url")
    return sinks.json_array(hits, ["id"], 20, pretty=True)


def json_arrays(spark, sf_dir):
    """The three longest pages of every site, each site's as one pretty array."""
    pages = _pages(spark, sf_dir).select(
        U.netloc(F.col("url")).alias("host"), "page_id", "url", F.length("html").alias("n_chars")
    )
    return sinks.json_arrays(pages, ["host"], [F.desc("n_chars"), F.col("page_id")], 3, pretty=True)


def content_only(spark, sf_dir):
    """Rows as JSON where there are any, else the page's text; both from one parse."""
    return sinks.content_only(X.extract_or_text(_with_status(_pages(spark, sf_dir)), SCHEMA))


def stream_titles(spark, sf_dir):
    """Titles and links computed by a stream over the pages, in several micro-batches."""
    stage = Stage(spark, "stream")
    stage.save(_pages(spark, sf_dir).repartition(5, "page_id"), "pages")
    pages = stream_pages(spark, stage.path("pages"), files_per_trigger=2)
    shaped = pages.select(
        "page_id",
        C.title(F.col("html")).alias("title"),
        F.size(L.follow(F.col("url"), L.hrefs(F.col("html")))).alias("n_links"),
    )
    run_available(shaped, stage.path("out"), stage.path("checkpoint"))
    return spark.read.schema(shaped.schema).parquet(stage.path("out"))


def stream_new_urls(spark, sf_dir):
    """Every URL that pages link to, once, by a stream with a bounded visited set in several micro-batches."""
    stage = Stage(spark, "new-urls")
    links = L.internal_links(_pages(spark, sf_dir)).select(
        "page_id", F.explode("links").alias("url"), F.timestamp_seconds(F.col("page_id") + START).alias("ts")
    )
    stage.save(links.repartition(4, "page_id"), "links")
    stream = stream_pages(spark, stage.path("links"), "page_id long, url string, ts timestamp", 2)
    run_available(new_urls(stream, "ts", "1000 days").select("url"), stage.path("out"), stage.path("checkpoint"))
    return spark.read.schema("url string").parquet(stage.path("out"))


def stream_crawl(spark, sf_dir):
    """The limited crawl with its seeds arriving as a stream, each of them twice."""
    pages, seeds, links = _site_graph(spark, sf_dir)
    ids = pages.select("url", "page_id")
    graph = build_graph(links.join(ids, "url").select("url", "page_id", "links"))
    stage = Stage(spark, "stream-crawl")
    arriving = seeds.select("seed", F.explode(F.array(F.lit(0), F.lit(60))).alias("s"))
    timed = arriving.select("seed", F.timestamp_seconds(F.col("s") + START).alias("ts"))
    stage.save(timed.repartition(4, "seed", "ts"), "seeds")
    stream = stream_pages(spark, stage.path("seeds"), "seed string, ts timestamp", 2)
    crawl_seeds(stream, graph, stage.path("out"), stage.path("checkpoint"), CRAWL_DEPTH, CRAWL_LIMIT)
    return crawled(graph, stage.path("out")).drop("page_id")


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, "/root/testdata/sf0.001")


def _training_data():
    """Queries and SQL of the ``llm`` subpackage and the pipeline over it, as far as both exist."""
    found, sql = {}, {}
    try:
        from pagetable.llm.queries import ORACLES, QUERIES
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith("pagetable.llm"):
            raise
        return found, sql
    found, sql = dict(QUERIES), dict(ORACLES)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "url_parts": url_parts,
        "same_site": same_site,
        "normalized_urls": normalized_urls,
        "binary_urls": binary_urls,
        "page_lookup": page_lookup,
        "page_store_lookup": page_store_lookup,
        "status_labels": status_labels,
        "fetch_outcomes": fetch_outcomes,
        "page_title": page_title,
        "clean_text": _text_query(C.clean_text),
        "body_text": _text_query(C.body_text),
        "rendered_text": _text_query(C.rendered_text),
        "scrape_text": scrape_text,
        "scrape_json": scrape_json,
        "scrape_markdown": scrape_markdown,
        "snapshot": snapshot,
        "internal_links": internal_links,
        "internal_links_from_nodes": internal_links_from_nodes,
        "link_edges": link_edges,
        "link_degrees": link_degrees,
        "page_links": page_links,
        "crawl_limited": crawl_limited,
        "crawl_records": crawl_records,
        "site_tree": site_tree,
        "site_tree_limited": site_tree_limited,
        "site_totals": site_totals,
        "site_map": site_map,
        "site_report": flagship,
        "extract_rows": extract_rows,
        "extract_lists": extract_lists,
        "extract_pages": extract_pages,
        "extract_none": extract_none,
        "scrape_with_schema": scrape_with_schema,
        "search_pages": search_pages,
        "search_documents": search_documents,
        "search_bm25": search_bm25,
        "search_bm25_indexed": search_bm25_indexed,
        "post_search": post_search,
        "post_search_indexed": post_search_indexed,
        "user_timeline": user_timeline,
        "user_timelines": user_timelines,
        "profiles": profile_records,
        "login_forms": login_forms,
        "json_lines": json_lines,
        "json_array": json_array,
        "json_array_pretty": json_array_pretty,
        "json_arrays": json_arrays,
        "content_only": content_only,
        "stream_titles": stream_titles,
        "stream_new_urls": stream_new_urls,
        "stream_crawl": stream_crawl,
        **_training_data()[0],
    }


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES

    return {**ORACLES, **_training_data()[1]}
