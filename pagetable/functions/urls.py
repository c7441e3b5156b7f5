"""URL algebra as column expressions: split, resolve, same-site and file-suffix tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagetable.functions.strings import let

# Path endings that are never HTML.
BINARY_SUFFIXES = (
    "pdf", "zip", "rar", "7z", "gz", "tar", "exe", "dmg",
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico",
    "mp3", "mp4", "avi", "mov", "wav",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "css", "js", "woff", "woff2", "ttf", "eot",
)

# RFC 3986, appendix B, with the scheme held to its legal characters.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_LEADING = r"^[\x00-\x20]+"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def split_url(url: Column) -> Column:
    """``struct(scheme, netloc, path, query)``; absent parts are ``''``.

    One regular expression pass: the parts are rewritten as lines (a cleaned URL holds no
    line feed) and then split. Null for a netloc with an unbalanced bracket.
    """
    trimmed = F.when(
        url.rlike(r"^[\x00-\x20]|[\t\r\n]"),
        F.regexp_replace(F.regexp_replace(url, _LEADING, ""), r"[\t\r\n]", ""),
    ).otherwise(url)
    lines = F.split(F.regexp_replace(trimmed, _URL, "$1\n$2\n$3\n$4"), "\n", -1)

    def to_struct(p: Column) -> Column:
        parts = F.struct(
            F.lower(p[0]).alias("scheme"),
            p[1].alias("netloc"),
            p[2].alias("path"),
            p[3].alias("query"),
        )
        return F.when(p[1].contains("[") == p[1].contains("]"), parts)

    return let(lines, to_struct)


def netloc(url: Column) -> Column:
    """Host part with port and user info, letter case kept."""
    return split_url(url)["netloc"]


def same_site(a: Column, b: Column) -> Column:
    """Exact equality of the two netlocs; false when either URL cannot be split."""
    return F.coalesce(netloc(a) == netloc(b), F.lit(False))


def is_binary_path(path: Column) -> Column:
    """Does a URL path end in a suffix known not to be HTML?"""
    own = F.when(path.contains(";"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    return F.lower(own).rlike(r"\.(?:" + "|".join(BINARY_SUFFIXES) + r")\z")


def is_binary(url: Column) -> Column:
    """The same test on a URL: its query never counts."""
    return is_binary_path(split_url(url)["path"])


def _merge_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(kept, tail), "/")


def _target(base: Column, netloc: Column, path: Column, query: Column) -> Column:
    url = F.concat(
        base["scheme"],
        F.lit("://"),
        netloc,
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.struct(url.alias("url"), netloc.alias("netloc"), path.alias("path"))


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _clean_path(path: Column) -> Column:
    return F.when(path.rlike(_DOT_SEGMENT), _rooted(_merge_dots(path))).otherwise(_rooted(path))


def _resolve_parts(base: Column, ref: Column) -> Column:
    """Join a split reference onto a split base of the same scheme (RFC 3986, section 5.2)."""
    folder = F.regexp_replace(base["path"], r"[^/]*$", "")
    relative = F.regexp_replace(F.concat(folder, F.lit("/"), ref["path"]), "/{2,}", "/")
    own_query = ref["query"]
    return (
        F.when(ref["netloc"] != "", _target(base, ref["netloc"], ref["path"], own_query))
        .when(
            ref["path"].startswith("/"),
            _target(base, base["netloc"], _clean_path(ref["path"]), own_query),
        )
        .when(
            ref["path"] == "",
            _target(
                base,
                base["netloc"],
                base["path"],
                F.when(own_query == "", base["query"]).otherwise(own_query),
            ),
        )
        .otherwise(_target(base, base["netloc"], let(relative, _clean_path), own_query))
    )


def _resolve_one(base: Column, href: Column) -> Column:
    usable = (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")
    target = F.substring_index(href, "#", 1)

    def join(ref: Column) -> Column:
        web_base = base["scheme"].isin("http", "https")
        same_scheme = (ref["scheme"] == "") | (ref["scheme"] == base["scheme"])
        absolute = target.startswith("http://") | target.startswith("https://")
        as_is = F.struct(target.alias("url"), ref["netloc"], ref["path"])
        return (
            F.when(ref.isNull(), None)
            .when(web_base & same_scheme, _resolve_parts(base, ref))
            .when(absolute, as_is)
        )

    return F.when(usable, let(split_url(target), join))


def resolve_targets(base_url: Column, hrefs: Column) -> Column:
    """``array<struct<url, netloc, path>>`` of absolute http(s) URLs, null where the reference is
    not a link to follow.

    The base is split once, whatever the number of references.
    """
    return let(
        split_url(base_url), lambda base: F.transform(hrefs, lambda h: _resolve_one(base, h))
    )


def _absolute_one(base: Column, href: Column) -> Column:
    def join(ref: Column) -> Column:
        own_scheme = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
        fragment = F.regexp_extract(href, r"(?s)#.*", 0)
        return F.when(own_scheme | ref.isNull(), href).otherwise(
            F.concat(_resolve_parts(base, ref)["url"], fragment)
        )

    return let(split_url(F.substring_index(href, "#", 1)), join)


def absolute_links(base_url: Column, hrefs: Column) -> Column:
    """Every reference in absolute form, whatever its scheme, fragments kept."""
    return let(
        split_url(base_url), lambda base: F.transform(hrefs, lambda h: _absolute_one(base, h))
    )


def normalize_url(base_url: Column, href: Column) -> Column:
    """Resolve one reference against its page; null when it is not a link to follow."""
    return F.element_at(resolve_targets(base_url, F.array(href)), 1)["url"]
