"""Entities, the node job and page text."""

import html as stdlib_html
import random
import time

import pytest
from pyspark.sql import functions as F

from pagetable.functions.entities import decode_attribute, decode_text
from pagetable.functions.strings import strip
from pagetable.operators import content as C
from pagetable.operators import links as L
from pagetable.operators.markdown import to_markdown
from pagetable.sources.nodes import _attr_text, _Nodes, dom_nodes, node_table, with_nodes

REFS = (
    "a &amp; b", "&#65;&#x42;&#128;&#0;&#xD800;&#x110000;&#99999999999;&#X1f600;", "&notit; &not",
    "&notin; &foo; &amp &am &copy2", "&nbsp;x&eacute;&NotEqualTilde;&copy;&middot;&quot;",
    "&#1;x&#13;", "&", "&;", "&#;", "&#x;", "&&amp;&", "no refs", "", "?a=1&copy=2&lt;3",
)


def test_entities_agree_with_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in REFS], "t string")
    got = df.select("t", decode_text(F.col("t")).alias("d"), decode_attribute(F.col("t")).alias("a"))
    for r in got.collect():
        assert r.d == stdlib_html.unescape(r.t), r.t
        assert r.a == _attr_text(r.t), r.t


def test_strip_is_unicode_strip(spark):
    texts = ["\xa0 x ", "\x1c\x85y　", "  ", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def trees(page_frame, *htmls):
    """Each page's node array as an indented outline."""
    pages = page_frame(*htmls)
    rows = pages.select("page_id", dom_nodes(F.col("html"), spaces=True)).orderBy("page_id")
    outlines = []
    for _, nodes in rows.collect():
        assert [n.id for n in nodes] == list(range(1, len(nodes) + 1))
        for n in nodes:
            assert all(m.depth > n.depth for m in nodes if n.id < m.id <= n.last)
        outlines.append("|".join("." * n.depth + (n.tag or repr(n.text)) for n in nodes))
    return outlines


REPAIRED = [
    ("<p><b>x<br><p>y", "..p|...b|....'x'|....br|..p|...'y'"),
    ("<p>a<div>b</div>c", "..p|...'a'|..div|...'b'|..'c'"),
    ("<ul><li>1<li><ul><li>2</ul>3</ul>", "..ul|...li|....'1'|...li|....ul|.....li|......'2'|....'3'"),
    ("a<!-- c -->b", "..'a'|..'b'"),
    ("a &amp; b < c", "..'a & b < c'"),
    ("<div><b>x</div>y</b>z", "..div|...b|....'x'|..'yz'"),
    ("y<SCRIPT>var t='</p>';</SCRIPT>z", "..'y'|..script|...\"var t='</p>';\"|..'z'"),
    ("<a href=1>x<a href=2>y", "..a|...'x'|..a|...'y'"),
    ("<p>1</p></p>2", "..p|...'1'|..p|..'2'"),
    ("<select><option>a<option>b</select>", "..select|...option|....'a'|...option|....'b'"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "..dl|...dt|....'a'|...dd|....'b'|...dt|....'c'"),
    ("x<img src=a>y<hr/>z", "..'x'|..img|..'y'|..hr|..'z'"),
    ("x<a href='never closed", "..'x'"),
]


def test_tree_repair(spark, page_frame):
    assert trees(page_frame, *[html for html, _ in REPAIRED]) == [
        "html|.body|" + outline for _, outline in REPAIRED
    ]


def test_head_and_body_are_implied_once(spark, page_frame):
    html = "<!DOCTYPE html><title>t</title><meta x><p>a</body></html>b<body class=z>c"
    assert trees(page_frame, html, "<script>s</script>z") == [
        "html|.head|..title|...'t'|..meta|.body|..p|...'abc'",
        "html|.head|..script|...'s'|.body|..'z'",
    ]


def test_deep_nesting_is_not_quadratic():
    for unit in ("<div>", "<p><button><div>", "<b><p>", "<td>", "<li><ul>"):
        nodes = _Nodes(True, False)
        nodes.add_page(unit * 20000 + "x" + "</i></p>" * 20000)
        assert len(nodes.rows) > 20000


def test_attributes(spark, page_frame):
    html = """<P ID=one Class='a  b' data-x="1 &gt; 0" hidden id=two title=a&copy=b>t"""
    nodes = page_frame(html).select(dom_nodes(F.col("html"))).first()[0]
    want = {"id": "one", "class": "a  b", "data-x": "1 > 0", "hidden": "", "title": "a&copy=b"}
    assert nodes[2].attrs == want


def test_node_table_and_nulls(spark, page_frame):
    pages = page_frame("<p>x</p>", None, "")
    assert with_nodes(pages).filter("nodes IS NULL").count() == 1
    rows = node_table(pages).orderBy("page_id", "node_id").collect()
    assert [(r.page_id, r.kind, r.tag, r.text) for r in rows] == [
        (0, "element", "html", None), (0, "element", "body", None), (0, "element", "p", None),
        (0, "text", None, "x"),
    ]


TITLES = [
    ("<title> T &amp; &lt;x </title><title>no</title>", "T & <x"),
    ("<TITLE lang=en>\n\xa0T </TITLE>", "T"),
    ("<p>none", ""),
    ("<title></title>", ""),
    ("<!-- <title>c</title> --><script>'<title>s</title>'</script><title>real", "real"),
    ("<!-- <title>&amp; </title> -->", "&amp;"),
    ("<title/>x", ""),
    ("<p a='<title>q</title>'>x<title>y</title>", "y"),
]


def test_title(spark, page_frame):
    pages = page_frame(*[html for html, _ in TITLES])
    got = pages.select("page_id", C.title(F.col("html"))).orderBy("page_id").collect()
    assert [r[1] for r in got] == [title for _, title in TITLES]


FURNISHED = (
    "<head><title>T</title></head><body class='menu'><header>h</header><nav>n</nav>"
    "<div class='x sidebar'>s</div><p> a <b>b</b></p><aside>q</aside><noscript>ns</noscript>"
    "<template>t</template><div>one\n\n \ntwo</div><footer>f</footer>"
)


def texts_of(page_frame, html, elements=False):
    nodes = with_nodes(page_frame(html), elements=elements)
    n = F.col("nodes")
    return nodes.select(C.clean_text(n), C.body_text(n), C.rendered_text(n)).first()


@pytest.mark.parametrize("elements", [False, True])
def test_the_three_texts(spark, page_frame, elements):
    clean, body, rendered = texts_of(page_frame, FURNISHED, elements)
    assert clean == "T\ns\na\nb\none\n\n \ntwo"
    assert body == "a\nb\none\ntwo"
    assert rendered == "h\nn\ns\na\nb\nq\none\n\n \ntwo\nf"


def test_caps_count_characters(spark, page_frame):
    clean, body, rendered = texts_of(page_frame, "<p>" + "\U0001f600" * 16000)
    assert (len(clean), len(body), len(rendered)) == (16000, 16000, 16000)
    nodes = with_nodes(page_frame("<p>" + "\U0001f600" * 16000))
    cut = nodes.select(C.clean_text(F.col("nodes"), 10000), C.rendered_text(F.col("nodes"), 15000))
    assert [len(t) for t in cut.first()] == [10000, 15000]


def test_a_long_run_after_a_reference_is_kept(spark):
    text = "x &amp" + "a1" * 60 + " y &ampersand &" + "b" * 90 + "; &notin; &notit"
    got = spark.createDataFrame([(text,)], "t string").select(decode_text(F.col("t"))).first()[0]
    assert got == stdlib_html.unescape(text)


def test_scrape_record(spark, page_frame):
    pages = page_frame("<title>T</title><p>é", "<script>x</script>", None).withColumn(
        "status_code", F.expr("CASE page_id WHEN 1 THEN 404 WHEN 0 THEN 200 END")
    )
    ok, empty, missing = C.scrape(pages).orderBy("page_id").collect()
    assert (ok.title, ok.content, ok.content_length, ok.error) == ("T", "T\né", 3, None)
    assert (empty.content, empty.content_length, empty.error) == ("[No content]", 12, "HTTP 404")
    assert (missing.error, missing.content, missing.content_length) == ("not stored", None, None)
    with pytest.raises(ValueError):
        C.scrape(pages, "pdf")


# The first line of a page loses its indent, the content being trimmed.
MARKDOWN = [
    ("<h2>T</h2><p>a  <b>b</b>\n<i>c</i></p><p>d", "## T\n\na **b** _c_\n\nd"),
    ("<ul><li>a<li>b<ol><li>c</li><li>d</li></ol></ul>e",
     "* a\n  * b\n    1. c\n    2. d\n\ne"),
    ("<a href='/x' title='t'>l</a> <a href='#q'>in</a><img src=i alt=j>", '[l](/x "t") in'),
    ("x<br>y<hr>z", "x  \ny\n\n* * *\n\nz"),
    ("<pre>a\n  b</pre>c", "a\n      b\n\nc"),
    ("<blockquote><p>a</p><p>b</p></blockquote>c", "> a\n\n> b\n\nc"),
    ("<p>use <code>x  y</code></p>", "use `x y`"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>",
     "A| B  \n---|---  \n1| 2"),
    ("<nav>n</nav><div class=ad>a</div>", ""),
]


def test_markdown(spark, page_frame):
    pages = page_frame(*[html for html, _ in MARKDOWN])
    nodes = pages.select("page_id", dom_nodes(F.col("html"), spaces=True).alias("n"))
    got = nodes.select("page_id", to_markdown(F.col("n"))).orderBy("page_id").collect()
    assert [r[1] for r in got] == [markdown for _, markdown in MARKDOWN]


def test_snapshot(spark, page_frame):
    pages = page_frame(
        "<title>T</title><p>hello", "<a href='/q#f'></a>", "", url="http://a.com/"
    )
    cards = [r.snapshot.split("\n") for r in C.snapshot(pages).orderBy("page_id").collect()]
    assert cards[0] == ["URL:  http://a.com/", "Title: T", "─" * 50, "hello"]
    assert cards[1][3:] == ["Links found:", "  [no text] → http://a.com/q#f"]
    assert cards[2][3:] == ["[Empty page]"]


LINKS = """<a href="/b">x</a><A HREF='/a'>y</A><a href=/b#q>z</a><a>no</a><a href>e</a>
<a href="http://o.com/">o</a><a href="/f.pdf">f</a><a href="#t">t</a><!-- <a href="/c">c</a> -->
<script>"<a href='/s'>"</script><a title="<a href='/q'>" href=/d?x&amp;y>d</a><a name=n
href = "/e" href="/g">e</a>"""


def test_internal_links(spark, page_frame):
    base = "http://a.com/x/y"
    want = [f"http://a.com/{p}" for p in ("a", "b", "d?x&y", "e")]
    for from_nodes in (False, True):
        assert L.internal_links(page_frame(LINKS, url=base), from_nodes).first().links == want


def test_page_links_keep_order_and_text(spark, page_frame):
    html = "<a href=/a> <b>x</b> y </a><a href='http://o.com'>z</a><a href=/a>" + "w" * 90 + "</a>"
    rows = L.page_links(page_frame(html)).orderBy("pos").collect()
    assert [(r.href, r.text) for r in rows] == [
        ("http://a.com/a", "x y"), ("http://o.com", "z"), ("http://a.com/a", "w" * 90)
    ]
    assert L.page_links(page_frame(html), 80).filter("pos = 2").first().text == "w" * 80
    based = page_frame("<base href='http://b.com/d/'><base href=/e/><a href=f>g</a>")
    assert L.page_links(based).first().href == "http://b.com/d/f"
    assert L.internal_links(based).first().links == ["http://a.com/x/f"]


def test_both_paths_agree_on_random_markup(spark, page_frame):
    """The JVM expressions and the node job cut tag soup into the same titles and links."""
    rng = random.Random(7)
    bits = [
        "<a href=/p{}>", "</a>", "<a href='/q{}'", ">", "<!--", "-->", "<script>", "</script>",
        "<title>t{}", "</title>", "text &amp; {}", "<a title='>' href=\"/r{}\">", "<p ", "<", "</",
        "<textarea>", "</textarea>", "<!x>", "<a/href=/s{}>", "'", '"', "<style>", "</style >",
    ]
    htmls = [
        "".join(rng.choice(bits).format(i) for i in range(rng.randint(1, 14))) for _ in range(400)
    ]
    pages = page_frame(*htmls).repartition(4)
    fast = {r.page_id: r.links for r in L.internal_links(pages).collect()}
    slow = {r.page_id: r.links for r in L.internal_links(pages, from_nodes=True).collect()}
    assert [h for i, h in enumerate(htmls) if fast[i] != slow[i]] == []

    def first_title(nodes):
        found = next((n for n in nodes if n.tag == "title"), None)
        if found is None:
            return None
        return "".join(n.text for n in nodes if n.parent == found.id).strip()

    rows = with_nodes(pages).select("html", C.title(F.col("html")).alias("t"), "nodes").collect()
    wrong = [(r.html, r.t) for r in rows if first_title(r.nodes) not in (None, r.t)]
    assert wrong == []


def test_text_that_looks_like_a_list_is_escaped(page_frame):
    page = page_frame("<p>1. one<p>- dash<p>+ plus<p>a - b<p>1.5 x<p><code>- c</code><pre>- d</pre>")
    nodes = with_nodes(page)
    shown = nodes.select(to_markdown(F.col("nodes"))).first()[0]
    lines = [line for line in shown.split("\n") if line.strip()]
    assert lines == ["1\\. one", "\\- dash", "\\+ plus", "a - b", "1.5 x", "`- c`", "    - d"]


def test_markdown_of_very_many_lists_grows_with_the_page(spark, page_frame):
    """Depth in lists and quotes comes with each node, so no node is held against all lists."""
    item = "<ul><li>{}<ol><li>x</li></ol></li></ul><blockquote>q</blockquote><table><tr><td>a<td>b</table>"
    took = []
    for n in (500, 4000):
        pages = page_frame("<body>" + "".join(item.format(i) for i in range(n)))
        C.scrape(pages, "markdown").count()
        start = time.time()
        text = C.scrape(pages, "markdown").first().content
        took.append(time.time() - start)
        assert text.count("  1. x") == n and text.count("> q") == n and text.count("a| b") == n
    assert took[1] < 16 * took[0] + 2
