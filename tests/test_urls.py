"""URL expressions against the standard library."""

from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from pagetable.functions import urls as U

BASES = (
    "http://a.com/x/y", "http://a.com", "https://A.com/p/q/?z=1#f", "http://a.com/d//e/f",
    "ftp://x/y", "http://u@h:81/",
)
HREFS = (
    "", "#top", "javascript:void(0)", "JavaScript:x", "mailto:q@a.com", "HTTPS://b.com/",
    "HTTP://a.com/Q", "?p=2", "//c.com/z", "../k", " /pad ", "/k#frag", "a//b/", "./", "../..",
    "../../../q/./w/../e", "/../k", "/a/./b/..", "http:", "http:foo", "https://z.com/?", "/x?",
    "  ", "a;b", ";p", "//", "http:///q", "?", "/a\tb", "\x01/z", "x:y", "..", ".", "é/ü?ß",
)


def expected(base, href):
    if not href or href.startswith(("#", "javascript:")):
        return None
    full = urljoin(base, href.split("#")[0])
    return full if full.startswith(("http://", "https://")) else None


def test_normalize_url_agrees_with_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", U.normalize_url(F.col("b"), F.col("h")).alias("r")).collect()
    wrong = [(r.b, r.h, r.r, expected(r.b, r.h)) for r in got if r.r != expected(r.b, r.h)]
    assert wrong == []


def test_normalize_url_of_null_and_broken(spark):
    df = spark.createDataFrame(
        [("http://a.com/", None), ("http://a.com/", "http://[::1/x")], "b string, h string"
    )
    got = [r[0] for r in df.select(U.normalize_url(F.col("b"), F.col("h"))).collect()]
    assert got == [None, None]


def test_split_url_agrees_with_urlsplit(spark):
    urls = [*BASES, "", "x", "HTTP://A/b?c?d#e#f", "//h/p", "1http://a", "a+b.c-1://h?q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", U.split_url(F.col("u")).alias("p")).collect():
        want = urlsplit(r.u)
        assert tuple(r.p) == (want.scheme, want.netloc, want.path, want.query), r.u


SAME_SITE = {
    "https://a.com/x": True, "http://www.a.com/": False, "http://a.com:8080/": False,
    "http://A.com/": False, "http://[a": False,
}


def test_same_site(spark):
    df = spark.createDataFrame([(u,) for u in SAME_SITE], "u string")
    got = df.select("u", U.same_site(F.lit("http://a.com/"), F.col("u"))).collect()
    assert dict(map(tuple, got)) == SAME_SITE


BINARY = {
    "/f.PDF": True, "/f.pdf?x=1": True, "/f?file=x.pdf": False, "/f.tar.gz": True,
    "/f.html": False, "/f.js": True, "/f.json": False, "/f.js;v=1": True,
}


def test_is_binary(spark):
    df = spark.createDataFrame([(p,) for p in BINARY], "p string")
    got = df.select("p", U.is_binary(F.concat(F.lit("http://a.com"), "p"))).collect()
    assert dict(map(tuple, got)) == BINARY


def test_absolute_links_keep_fragments_and_schemes(spark):
    cases = {
        "#top": "http://a.com/x/y#top", "mailto:q@a.com": "mailto:q@a.com", "z#f": "http://a.com/x/z#f",
        "": "http://a.com/x/y", "http://b.com/q#r": "http://b.com/q#r",
    }
    df = spark.createDataFrame([(list(cases),)], "h array<string>")
    got = df.select(U.absolute_links(F.lit("http://a.com/x/y"), F.col("h"))).first()[0]
    assert dict(zip(cases, got)) == cases
