"""Search, posts, profiles, login pages, sinks, lookups and streams."""

import json
import re
from collections import Counter
from datetime import datetime
from math import log

import pytest
from pyspark.sql import functions as F

from pagetable.operators import content as C
from pagetable.operators import links as L
from pagetable.operators import search as S
from pagetable.operators.login import login_forms
from pagetable.operators.profiles import profiles
from pagetable.sources import fetch, sinks
from pagetable.sources.pages import html_pages, read_pages
from pagetable.sources.page_store import store_pages
from pagetable.streaming.pages import new_urls, run_available, stream_pages

TEXTS = ["The cat; the dog", "dog dog cat", "theme catalog", "", None, "Été the été", "CAT the the"]


def documents(spark):
    rows = [(i, None if i == 0 else f"t{i}", f"u{i}", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, title string, url string, text string")


def counts(text, terms):
    words = re.findall(r"\w+", (text or "").lower())
    return [words.count(t) for t in terms], len(words)


def test_search(spark):
    for query, limit in (("the CAT?", 3), ("été", 5), ("absent", 5)):
        terms = S.query_terms(query)
        scores = {i: sum(counts(t, terms)[0]) for i, t in enumerate(TEXTS)}
        want = sorted((-n, i) for i, n in scores.items() if n)[:limit]
        got = S.search(documents(spark), query, limit).collect()
        assert sorted((-r.score, r.id) for r in got) == want
    first = S.search(documents(spark), "dog cat", 10).filter("id = 0").first()
    assert (first.title, first.url, first.description) == ("", "u0", TEXTS[0])
    with pytest.raises(ValueError):
        S.search(documents(spark), "?!")


def test_bm25(spark):
    docs = documents(spark).filter("text IS NOT NULL")
    texts = {i: t for i, t in enumerate(TEXTS) if t is not None}
    terms = S.query_terms("the dog")
    stats = {i: counts(t, terms) for i, t in texts.items()}
    mean = sum(n for _, n in stats.values()) / len(stats)
    df = [sum(c[k] > 0 for c, _ in stats.values()) for k in range(2)]
    want = {}
    for i, (tf, n) in stats.items():
        score = sum(
            log(1 + (len(stats) - df[k] + 0.5) / (df[k] + 0.5)) * tf[k] * 2.2
            / (tf[k] + 1.2 * (0.25 + 0.75 * n / mean))
            for k in range(2)
        )
        if any(tf):
            want[i] = round(score, 6)
    got = {r.id: r.score for r in S.search_bm25(docs, "the dog", 10).collect()}
    assert got == pytest.approx(want, abs=1e-6)


POST = (
    "id long, ts timestamp, user_id long, username string, display_name string, content string, "
    "likes long, retweets long, replies long, url string"
)


def raw_posts(spark):
    day = datetime(2024, 1, 1)
    rows = [
        (i, day.replace(hour=i % 5), i % 2, "u" if i else None, "U" if i else None, f"Hello {i}",
         i, 0, 0, f"p{i}") for i in range(8)
    ]
    return spark.createDataFrame(rows, POST)


def test_post_search(spark):
    rows = S.post_search(raw_posts(spark), "HELLO", 4).collect()
    assert rows[0].asDict().keys() == set(S.POST_FIELDS)
    assert [r.id for r in rows] == [4, 3, 2, 7]
    anonymous = S.post_search(raw_posts(spark), "hello 0").first()
    assert (anonymous.user, anonymous.fullname) == ("unknown", "")
    assert S.post_search(raw_posts(spark), "bye").count() == 0


def test_timelines(spark):
    users = spark.createDataFrame([(0, "even"), (1, "odd"), (2, "quiet")], "id long, handle string")
    assert [r.id for r in S.timeline(users, raw_posts(spark), "@@odd", 3).collect()] == [3, 7, 1]
    assert S.timeline(users, raw_posts(spark), "nobody").count() == 0
    handles = spark.createDataFrame([("@odd",), ("even",), ("quiet",), ("no",)], "handle string")
    rows = S.timelines(users, raw_posts(spark), handles, 2).collect()
    assert sorted((r.handle, r["rank"], r.id) for r in rows if r.error is None) == [
        ("even", 1, 4), ("even", 2, 2), ("odd", 1, 3), ("odd", 2, 7)
    ]
    assert sorted((r.handle, r.error, r.id) for r in rows if r.error) == [
        ("no", "User not found: no", None), ("quiet", "No tweets found", None)
    ]


def test_profiles(spark):
    raw = spark.createDataFrame(
        [("u", "n", None, "h", "l", "c", "j", [("p", "co", "2020", None)], [("s", "d")]),
         ("v", "n", None, "h", "l", "c", "j", None, None)],
        "url string, name string, about string, headline string, location string, company string, "
        "job_title string, experiences array<struct<position:string,company_name:string,"
        "from_date:string,to_date:string>>, educations array<struct<institution:string,"
        "degree:string>>",
    )
    full, bare = profiles(raw).orderBy("url").collect()
    assert [e.asDict() for e in full.experiences] == [
        {"title": "p", "company": "co", "duration": "2020 - None"}
    ]
    assert [tuple(e) for e in full.education] == [("s", "d")]
    assert (bare.experiences, bare.education) == ([], [])


LOGIN = [
    ("<input name=u type=EMAIL><input type=email><input type=password><button>x</button>",
     ("input[type=email]", True, True, None)),
    ("<input NAME=myEMAIL type=tel><a>no button</a>", ("input[name*=email i]", False, False, None)),
    ("<div hidden><input type=email><button>Log in</button></div><input type=password disabled>"
     "<input type=hidden name=user>", (None, False, False, None)),
    ("<div role=alert> Bad\n <b>login</b>" + "!" * 300 + "</div>",
     (None, False, False, "Bad login" + "!" * 300)),
    ("<button type=button>Cancel</button><div role=button aria-label='Sign in'></div>",
     (None, False, True, None)),
    ("<button type=button>Go back</button><input type=text>",
     ("input[type=text]", False, False, None)),
    ("<p>plain", (None, False, False, None)),
]


def test_login_forms(spark, page_frame):
    rows = login_forms(page_frame(*[h for h, _ in LOGIN])).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in rows] == [want for _, want in LOGIN]
    cut = login_forms(page_frame(LOGIN[3][0]), 200).first()
    assert cut.error_text == LOGIN[3][1][3][:200]


def test_fetch(spark):
    log_rows = [
        (200, None, None), (404, None, None), (500, None, None), (None, "timeout", "t"),
        (None, "connection", "refused"), (None, "request", "r"), (None, "url", "u"),
        (None, "other", "o"), (404, None, None),
    ]
    log_frame = spark.createDataFrame(
        log_rows, "status_code int, error_kind string, detail string"
    )
    assert {r.error: r.n for r in fetch.fetch_outcomes(log_frame).collect()} == {
        None: 1, "HTTP 404": 2, "HTTP 500": 1, "Timeout after 30s": 1,
        "Connection error: refused": 1, "Request error: r": 1, "URL error: u": 1, "o": 1,
    }


def test_lookup_picks_one_copy(spark):
    pages = spark.createDataFrame(
        [(2, "a", "x"), (1, "a", "y"), (3, "b", "z")], "page_id long, url string, html string"
    )
    frontier = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "url string, k int")
    rows = fetch.lookup(frontier, pages).collect()
    assert sorted((r.url, r.k, r.html or "") for r in rows) == [
        ("a", 1, "y"), ("a", 2, "y"), ("c", 1, "")
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é/"), (1, None)], "id long, t string")
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted(lines) == ['{"id":1,"t":null}', '{"id":2,"t":"é/"}']
    assert sorted(r.value for r in sinks.json_lines(df).collect()) == sorted(lines)
    array = sinks.json_array(df, ["id"], 100).first().value
    assert array == '[{"id":1,"t":null},{"id":2,"t":"é/"}]'
    pretty = sinks.json_array(df, ["id"], 100, pretty=True).first().value
    assert json.loads(pretty) == json.loads(array) and "\n" in pretty
    assert sinks.json_array(df.limit(0), ["id"], 5).first().value == "[]"
    assert sinks.json_array(df.limit(0), ["id"], 5, pretty=True).first().value == "[]"
    assert pretty == json.dumps([{"id": 1, "t": None}, {"id": 2, "t": "é/"}], indent=2, ensure_ascii=False)

    records = spark.sql(
        "SELECT array(named_struct('a', 'x')) AS data, 'c' AS content UNION ALL "
        "SELECT array(), 'c' UNION ALL SELECT null, null"
    )
    values = sorted(r.value for r in sinks.content_only(records).collect())
    assert values == ["", '[{"a":"x"}]', "c"]
    sinks.write_text(sinks.content_only(records), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 3


def test_pretty_json_is_indented_by_two(spark):
    df = spark.sql(
        """SELECT 1 AS id, 'a"\\\\b\\n' AS `q"s`, array('x', null) AS l, CAST(array() AS array<int>) AS e,
        named_struct('x', 1.5D, 'y', true, 'z', named_struct('k', 'v')) AS s, map('m', array(map('n', 2))) AS m,
        CAST(null AS array<int>) AS n"""
    )
    value = sinks.json_array(df, ["id"], 5, pretty=True).first().value
    want = [{
        "id": 1, 'q"s': df.first()[1], "l": ["x", None], "e": [], "s": {"x": 1.5, "y": True, "z": {"k": "v"}},
        "m": {"m": [{"n": 2}]}, "n": None,
    }]
    assert value == json.dumps(want, indent=2, ensure_ascii=False)


def test_json_arrays_per_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", 7), (None, 3)]
    df = spark.createDataFrame(rows, "g string, v long")
    for pretty in (False, True):
        got = {r.g: r.value for r in sinks.json_arrays(df, ["g"], [F.desc("v")], 3, pretty).collect()}
        want = {"hot": [{"v": 499}, {"v": 498}, {"v": 497}], "cold": [{"v": 7}], None: [{"v": 3}]}
        dump = (lambda v: json.dumps(v, indent=2)) if pretty else (lambda v: json.dumps(v, separators=(",", ":")))
        assert got == {g: dump(v) for g, v in want.items()}


def test_page_store_moves_no_html(spark, tmp_path):
    rows = [(2, "a", "x"), (1, "a", "y"), (3, "b", "z"), (4, None, "n"), (1, "a", "y")]
    rows += [(10 + i, f"u{i}", f"h{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    store = store_pages(pages, str(tmp_path / "store"), 4)
    frontier = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1), (None, 9), ("u7", 3)], "url string, k int")
    got = fetch.lookup(frontier, store)
    assert sorted((r.url or "", r.k, r.html or "") for r in got.collect()) == [
        ("", 9, ""), ("a", 1, "y"), ("a", 2, "y"), ("c", 1, ""), ("u7", 3, "h7")
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fetch.lookup(frontier, store)._jdf.queryExecution().executedPlan().toString()
        plain = fetch.lookup(frontier, pages)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange, that of the frontier, and none above the scan with html.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "Exchange" not in plan[plan.index("FileScan") :]
    # In a plain table, rows without a page are no part of the join that carries html.
    assert "Union" in plain and "Join Inner" in plain
    assert [r.html for r in store.find(["u7"]).collect()] == ["h7"]
    single = store.find(["u7"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(url,u7)" in single or "In(url" in single
    assert len(list((tmp_path / "store").glob("*.parquet"))) <= 4
    store.forget()


def test_rows_without_a_page_do_not_meet_in_one_task(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 5, F.col("id")).alias("page_id"), F.concat(F.lit("u"), "id").alias("url"))
    records = spark.range(-2000, 2000).select(F.col("id").alias("page_id"), F.lit("t").alias("title"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in fetch.with_record(rows, records, "url").select(
            "page_id", "title", F.spark_partition_id().alias("p")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r[0] for r in got if r[1] == "t") == list(range(5))
    assert len(got) == 1000 and max(Counter(r[2] for r in got).values()) < 500


def test_sources(spark, page_frame, tmp_path):
    pages = page_frame("<p>a", "<p>b", url=["http://h/a", "http://h/b.pdf"])
    pages.write.json(str(tmp_path / "pages"))
    stored = read_pages(spark, str(tmp_path / "pages"), "json")
    assert stored.columns == ["page_id", "url", "html", "status_code", "final_url"]
    assert [r.url for r in html_pages(stored).collect()] == ["http://h/a"]


def test_link_degrees(spark):
    links = spark.createDataFrame(
        [("a", ["b", "c"]), ("b", ["c"]), ("d", [])], "url string, links array<string>"
    )
    edges = L.link_edges(links)
    assert sorted(map(tuple, edges.collect())) == [("a", 0, "b"), ("a", 1, "c"), ("b", 0, "c")]
    degrees = {r.url: (r.out_degree, r.in_degree) for r in L.link_degrees(edges).collect()}
    assert degrees == {"a": (2, 0), "b": (1, 1), "c": (0, 2)}


def test_stream_equals_batch(spark, page_frame, tmp_path):
    pages = page_frame(*[f"<title>T{i}</title><p>x{i}<a href=/{i}>l</a>" for i in range(8)])
    pages.repartition(4).write.parquet(str(tmp_path / "in"))

    def shaped(df):
        links = L.follow(F.col("url"), L.hrefs(F.col("html")))
        return C.scrape(df.withColumn("links", links))

    stream = stream_pages(spark, str(tmp_path / "in"), files_per_trigger=1)
    run_available(shaped(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = shaped(pages).collect()
    assert Counter(map(str, got)) == Counter(map(str, want)) and len(got) == 8


def test_stream_sees_each_url_once(spark, tmp_path):
    rows = [(i, f"u{i % 3}", datetime(2024, 1, 1, 0, i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_pages(spark, str(tmp_path / "in"), "page_id long, url string, ts timestamp", 1)
    once = new_urls(stream, "ts", "1 hour")
    run_available(once, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        "u0", "u1", "u2"
    ]
