"""Page to title, text and page record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.functions import markup as M
from pagetable.functions.entities import decode_text
from pagetable.functions.strings import let, strip
from pagetable.operators.markdown import to_markdown
from pagetable.sources.fetch import status_error
from pagetable.sources.nodes import dom_nodes, is_text

NO_CONTENT = "[No content]"


def first_chars(text: Column, most: int | None) -> Column:
    """The first ``most`` characters of a text, all of it for ``None``."""
    return text if most is None else F.substring(text, 1, most)


def title(html: Column) -> Column:
    """Text of the first title element, trimmed and decoded; ``''`` when there is none.

    Scans the page only up to that title. Pages whose only title is not an element (inside a
    comment, say) fall back to the first literal ``<title>…</title>``, left undecoded.
    """

    def from_element(element: Column) -> Column:
        text = strip(decode_text(F.regexp_replace(element, M.TITLE_OPEN, "")))
        literal = strip(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))
        return F.when(element != "", text).otherwise(literal)

    return let(F.regexp_extract(html, M.FIRST_TITLE, 3), from_element)


def _lines(nodes: Column, mask: int, wanted: int = 0) -> Column:
    """Trimmed, non-empty texts of the nodes whose zone bits under ``mask`` equal ``wanted``."""
    texts = F.filter(nodes, lambda n: is_text(n) & (n["zone"].bitwiseAND(mask) == wanted))
    return F.filter(F.transform(texts, lambda n: strip(n["text"])), lambda t: t != "")


def clean_text(nodes: Column, most: int | None = None) -> Column:
    """All text outside page furniture, one line per text node; ``most`` keeps that many characters."""
    lines = _lines(nodes, M.ZONE_DROP | M.ZONE_RAW)
    return first_chars(F.array_join(lines, "\n"), most)


def body_text(nodes: Column) -> Column:
    """Body text without furniture elements or furniture classes; blank lines removed."""
    lines = _lines(
        nodes, M.ZONE_DROP | M.ZONE_RAW | M.ZONE_BOILER | M.ZONE_BODY, wanted=M.ZONE_BODY
    )
    split_again = F.split(F.array_join(lines, "\n"), "\n", -1)
    return F.array_join(F.filter(split_again, lambda line: strip(line) != ""), "\n")


def rendered_text(nodes: Column, most: int | None = None) -> Column:
    """Body text as a reader sees it (furniture included); ``most`` keeps that many characters."""
    lines = _lines(nodes, M.ZONE_UNSEEN | M.ZONE_BODY, wanted=M.ZONE_BODY)
    return first_chars(F.array_join(lines, "\n"), most)


def text_content(nodes: Column, most: int | None = None) -> Column:
    return let(
        clean_text(nodes, most), lambda t: F.when(t == "", NO_CONTENT).otherwise(strip(t))
    )


def _column_or(pages: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in pages.columns else default


def scrape(pages: DataFrame, fmt: str = "text", most: int | None = None) -> DataFrame:
    """Page record for every page: ``text``, ``json`` (same content) or ``markdown`` content.

    ``most`` keeps that many characters of the first two. Map-only. Rows without HTML keep their ``url`` and get an ``error``.
    """
    if fmt not in ("text", "json", "markdown"):
        raise ValueError(f"unknown format: {fmt}")
    markdown = fmt == "markdown"
    html = F.col("html")
    status = _column_or(pages, "status_code", F.when(html.isNotNull(), F.lit(200)))
    keys = [c for c in pages.columns if c not in ("url", "html", "status_code", "final_url")]
    parsed = pages.select(
        *keys,
        "url",
        _column_or(pages, "final_url", F.when(html.isNotNull(), F.col("url"))).alias("final_url"),
        status.cast("int").alias("status_code"),
        title(html).alias("title"),
        html.isNull().alias("_missing"),
        dom_nodes(html, elements=markdown, spaces=markdown).alias("_nodes"),
    )
    content = to_markdown(F.col("_nodes")) if markdown else text_content(F.col("_nodes"), most)
    shaped = parsed.withColumn("content", content)
    return shaped.select(
        *keys,
        "url",
        F.lit(fmt).alias("format"),
        F.when(F.col("_missing"), F.lit("not stored"))
        .otherwise(status_error(F.col("status_code")))
        .alias("error"),
        "final_url",
        "status_code",
        "title",
        "content",
        F.length("content").alias("content_length"),
    )


def snapshot(
    pages: DataFrame,
    most_text: int | None = None,
    most_links: int | None = None,
    most_label: int | None = None,
    most_href: int | None = None,
) -> DataFrame:
    """``page_id, url, snapshot``: a plain text card of each page.

    The limits are characters of text, links of a page without text, and characters of a link's
    label and target; all of everything by default.
    """
    from pagetable.operators.links import links_with_text

    parsed = pages.select(
        "page_id",
        "url",
        title(F.col("html")).alias("title"),
        dom_nodes(F.col("html"), spaces=True).alias("nodes"),
    )
    links = links_with_text(F.col("url"), F.col("nodes"))
    if most_links is not None:
        links = F.slice(links, 1, most_links)
    link_lines = F.transform(
        links,
        lambda a: F.concat(
            F.lit("  "),
            first_chars(F.when(a["text"] == "", "[no text]").otherwise(a["text"]), most_label),
            F.lit(" → "),
            first_chars(a["href"], most_href),
        ),
    )
    no_text = F.when(
        F.size(links) > 0, F.concat_ws("\n", F.lit("Links found:"), link_lines)
    ).otherwise("[Empty page]")
    body = let(
        rendered_text(F.col("nodes"), most_text),
        lambda t: F.when(t == "", no_text).otherwise(t),
    )
    card = F.concat_ws(
        "\n",
        F.concat(F.lit("URL:  "), "url"),
        F.concat(F.lit("Title: "), "title"),
        F.lit("─" * 50),
        body,
    )
    return parsed.select("page_id", "url", card.alias("snapshot"))
