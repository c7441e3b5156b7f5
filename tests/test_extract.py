"""Schema grammar, selectors and extraction."""

import random
import time
import warnings

import pytest
from pyspark.sql import functions as F

from pagetable.operators import extract as X
from pagetable.operators.selectors import SelectorError, check, select, steps_of
from pagetable.sources.matching import Matcher
from pagetable.sources.nodes import dom_nodes, found_nodes, with_nodes


@pytest.mark.parametrize(
    "spec, base, fields",
    [
        ("article.product_pod: title=h3 a, price=.price_color", "article.product_pod",
         [("title", "h3 a"), ("price", ".price_color")]),
        ("article.product_pod: h3 a=title .price_color=price", "article.product_pod",
         [("title", "a"), ("price", ".price_color")]),
        ("article: title=h1", "article", [("h1", "title")]),
        ("title=h1, p=p", "body", [("title", "h1"), ("p", "p")]),
        ("li: a=b, bad, =x, y=, a=c", "li", [("a", "c")]),
        ('{"baseSelector":"li","fields":[{"name":"t","selector":"a","type":"text"}]}', "li",
         [("t", "a")]),
        ({"baseSelector": "a:first-child", "fields": [{"name": "t", "selector": "[x='a,b']"}]},
         "a:first-child", [("t", "[x='a,b']")]),
    ],
)
def test_schema_grammar(spec, base, fields):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        schema = X.parse_schema(spec)
    assert (schema.base, list(schema.fields)) == (base, fields)


@pytest.mark.parametrize("spec", ['{"fields":[]}', "article:", "", None, "no fields here"])
def test_schema_without_fields_is_refused(spec):
    with pytest.raises(ValueError):
        X.parse_schema(spec)


def test_single_field_order():
    with pytest.warns(UserWarning):
        assert X.parse_schema("article: title=h1").fields == (("h1", "title"),)
    assert X.parse_schema("article: title=h1", order="name").fields == (("title", "h1"),)


@pytest.mark.parametrize("bad", ["a:hover", "a + b", "", "a,,b", "a[", "a >", "> a", "::before"])
def test_unsupported_selectors_are_refused(bad):
    with pytest.raises(SelectorError):
        check(bad)


DOC = (
    "<div id=top class='a b'><h3><a href=/1 title='x y'>1</a></h3><p>2</p><p class=B>3</p>"
    "<ul><li>4</li><li lang=EN>5</li></ul></div><a href=/6.pdf>6</a>"
)
SELECTED = {
    "a": "1 6", "*[href]": "1 6", "#top a": "1", "h3 > a": "1", "div > a": "", ".a.b > p": "2 3",
    "p.B": "3", "p.b": "", "[href$='.pdf']": "6", "[href^=\"/\"]": "1 6", "[title~=y]": "1",
    "[title*='x y']": "1", "[lang=en]": "", "[lang=en i]": "5", "[LANG=EN]": "5",
    "li:first-child": "4", "li:nth-child(2)": "5", "p:nth-child(odd)": "3",
    "p:nth-child(even), li": "2 4 5", "div ul li": "4 5", "html > body > div h3 a": "1",
    "[title^='']": "", "li , a[href='/1'],a": "1 4 5 6",
}


def test_selectors(spark, page_frame):
    nodes = page_frame(DOC).select(dom_nodes(F.col("html")).alias("n"))
    n = F.col("n")
    columns = [select(n, s).alias(f"c{i}") for i, s in enumerate(SELECTED)]
    row = nodes.select(n, *columns).first()

    def text(element):
        return "".join(t.text for t in row.n if t.tag is None and element.id < t.id <= element.last)

    got = {s: " ".join(text(e) for e in row[f"c{i}"]) for i, s in enumerate(SELECTED)}
    assert got == SELECTED


def test_selectors_in_one_walk(spark, page_frame):
    """All selectors matched while parsing give what each gives over the node array."""
    rng = random.Random(6)
    tags = ["div", "p", "a", "ul", "li", "h3", "b", "span", "script"]
    pages = [DOC]
    for _ in range(40):
        html = ""
        for _ in range(rng.randint(0, 60)):
            tag = rng.choice(tags)
            attr = rng.choice(["", " class='a b'", " class=B", " href=/1", " title='x y'", " id=top", " lang=EN", " href=x.pdf"])
            html += rng.choice([f"<{tag}{attr}>", f"</{tag}>", f"<{tag}{attr}>t</{tag}>", "text"])
        pages.append(html)
    frame = page_frame(*pages).repartition(2)
    selectors = list(SELECTED)
    n = F.col("n")
    rows = frame.select(
        dom_nodes(F.col("html")).alias("n"), found_nodes(F.col("html"), [steps_of("html"), *map(steps_of, selectors)]).alias("f")
    ).select("f", *[F.transform(select(n, s), lambda e: e["id"]).alias(f"c{i}") for i, s in enumerate(selectors)]).collect()
    for row in rows:
        for i, s in enumerate(selectors):
            assert [f.id for f in row.f or () if i + 1 in (f.hits or ())] == (row[f"c{i}"] or []), s


def test_a_page_of_very_many_matches(spark, page_frame):
    """20,000 bases with as many matches, in time that grows with the page."""
    item = "<li><b>{}</b><i>y</i></li>"
    took = []
    for n in (2000, 20000):
        pages = page_frame("<ul>" + "".join(item.format(i) for i in range(n)) + "</ul>" + "<b></b>" * n)
        X.extract_rows(pages, "li: t=b, u=i, v=em").count()
        start = time.time()
        rows = X.extract_rows(pages, "li: t=b, u=i, v=em").agg(
            F.count("*"), F.sum("t"), F.count_if(F.col("u") == "y"), F.count_if(F.col("v") == "")
        ).first()
        took.append(time.time() - start)
        assert tuple(rows) == (n, n * (n - 1) / 2, n, n)
    assert took[1] < 25 * took[0] + 1


def test_many_fields_cost_one_walk():
    """Ten selectors take less than twice the steps of one: an element's tag settles which are tried."""

    def cost(fields):
        matcher = Matcher([steps_of(s) for s in ("li", *fields)])
        entries = sum(len(v) for v in matcher._by_tag.values()) + len(matcher._any)
        state = (0, 0)
        start = time.perf_counter()
        for i in range(40000):
            matcher.step(("li", "b", "i", "p", "td", "div")[i % 6], {}, 1, state)
        return entries, time.perf_counter() - start

    one, ten = cost(["b"]), cost(["b", "i", "em", "u", "s", "q", "h1", "h2", "h3", "h4"])
    assert ten[0] == one[0] + 9 and ten[1] < 2 * one[1] + 0.1


def test_found_over_nodes_equals_found_while_parsing(spark, page_frame):
    pages = page_frame("<div>a<script>s</script><ul><li>1<b>2</b></li><li><ul><li>3</li></ul></li></ul></div>", "", None)
    schema = X.parse_schema("li: t=b, d=div li, s=script")
    body = X.parse_schema("body: d=div, s=script, l=ul > li")
    for s in (schema, body):
        parsed = pages.select(X.found_by(F.col("html"), s).alias("f"), dom_nodes(F.col("html")).alias("n"))
        both = parsed.select(
            X.extract_items(F.col("f"), s).alias("a"), X.extract_items(X.found_in(F.col("n"), s), s).alias("b")
        ).collect()
        assert all(r.a == r.b for r in both) and both[0].a


def test_extract(spark, page_frame):
    item = "<li><b> {} <i>x</i></b><b>second</b></li>"
    pages = page_frame(
        "<h2><ul>" + item.format("a") + "<li></li></ul></h2>",
        "<ul>" + "".join(item.format(i) for i in range(51)) + "</ul>",
        "<p>none",
        "<li><b>y</b></li>",
        None,
    ).withColumn("status_code", F.when(F.col("page_id") == 3, 404).otherwise(200))
    rows = X.extract(pages, "li: t=b, far=h2 b, s=b > i").orderBy("page_id").collect()
    assert [tuple(d) for d in rows[0].data] == [("ax", "ax", "x"), ("", "", "")]
    assert len(rows[1].data) == 51 and tuple(rows[1].data[50]) == ("50x", "", "x")
    cut = X.extract(pages, "li: t=b, far=h2 b, s=b > i", most=50).filter("page_id = 1").first()
    assert cut.data == rows[1].data[:50]
    assert [(r.data, r.error) for r in rows[2:]] == [
        (None, "No data extracted"), (None, "HTTP 404"), (None, "not stored")
    ]
    assert X.extract_rows(pages, "li: t=b, u=b").count() == 53


def test_extract_skips_script_text_unless_asked(spark, page_frame):
    pages = page_frame("<div>a<script>s</script>b</div>")
    assert X.extract_rows(pages, "body: d=div, s=script").first()[2:] == ("ab", "s")


def test_scrape_with_schema(spark, page_frame):
    row = X.scrape_with_schema(page_frame("<title>T</title><p>é"), "body: p=p, q=q").first()
    assert (row.title, row.content, row.content_length) == ("T", '[{"p":"é","q":""}]', 18)


def test_node_job_runs_once(spark, page_frame):
    plan = X.extract(page_frame("x"), "li: t=b, u=h2 b")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") == 1
    assert "Exchange" not in physical
    assert with_nodes(page_frame("x")).columns == ["page_id", "url", "html", "nodes"]
