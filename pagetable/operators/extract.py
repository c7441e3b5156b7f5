"""Schema extraction: pages to rows of named text fields."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.functions import markup as M
from pagetable.functions.strings import let, positions, strip
from pagetable.operators.content import text_content, title
from pagetable.operators.selectors import check, select, steps_of
from pagetable.sources.fetch import status_error
from pagetable.sources.nodes import dom_nodes, found_nodes, is_text


@dataclass(frozen=True)
class Schema:
    """Where rows come from and which fields they have, ``(name, selector)`` in order."""

    base: str
    fields: tuple[tuple[str, str], ...]


def _from_mapping(spec: dict) -> Schema:
    fields: dict[str, str] = {}
    for f in spec.get("fields", []):
        fields[f["name"]] = f["selector"]
    return Schema(spec["baseSelector"], tuple(fields.items()))


def parse_schema(spec: str | dict, order: str | None = None) -> Schema:
    """Read ``"base: name=selector, name2=selector2"``, a JSON object or a dict.

    Without a comma the fields are blank-separated ``selector=name`` pairs; ``order="name"`` or
    ``order="selector"`` says which side comes first whatever the separator. Raises ``ValueError``
    when no field can be read.
    """
    if not spec:
        raise ValueError("empty extraction schema")
    if isinstance(spec, dict):
        schema = _from_mapping(spec)
    else:
        schema = _parse_text(spec, order)
    if not schema.fields:
        raise ValueError(f"no fields in extraction schema: {spec!r}")
    for selector in (schema.base, *(s for _, s in schema.fields)):
        check(selector)
    return schema


def _parse_text(spec: str, order: str | None) -> Schema:
    try:
        loaded = json.loads(spec)
    except json.JSONDecodeError:
        loaded = None
    if isinstance(loaded, dict) and "baseSelector" in loaded:
        return _from_mapping(loaded)

    head, colon, tail = spec.partition(":")
    base, rest = (head.strip(), tail.strip()) if colon else ("body", spec)
    commas = "," in rest
    pairs = [c.strip().partition("=") for c in (rest.split(",") if commas else rest.split())]
    pairs = [(left.strip(), right.strip()) for left, eq, right in pairs if eq]
    pairs = [p for p in pairs if all(p)]
    name_first = order == "name" if order else commas
    if order is None and not commas and len(pairs) == 1:
        warnings.warn(
            "a single field is read as selector=name; pass order='name' for name=selector",
            stacklevel=3,
        )
    fields = dict(pairs) if name_first else {name: selector for selector, name in pairs}
    return Schema(base, tuple(fields.items()))


def _steps(ids: Column) -> Column:
    """Powers of two, largest first, whose sum reaches any place in ``ids``."""
    return F.transform(
        F.sequence(F.length(F.bin(F.size(ids))) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k)
    )


def _up_to(ids: Column, steps: Column, bound: Column) -> Column:
    """How many of the ascending ``ids`` are at most ``bound``, by halving."""
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(ids, at + step - 1) <= bound, at + step).otherwise(at)
    )


def _ids(items: Column) -> Column:
    return F.transform(items, lambda n: n["id"])


def found_by(html: Column, schema: Schema) -> Column:
    """What the selectors of a schema match in a page: the base's first, then the fields'."""
    return found_nodes(html, [steps_of(s) for s in (schema.base, *(s for _, s in schema.fields))])


def found_in(nodes: Column, schema: Schema) -> Column:
    """The same, from a page's whole node array, for operators that need that anyway."""

    def found(n: Column, raw: Column, hits: Column, text: Column) -> Column:
        return F.struct(n["id"].alias("id"), raw.alias("raw"), n["last"].alias("last"), hits.alias("hits"), text.alias("text"))

    none = F.array().cast("array<int>")
    lists = [F.transform(
        F.filter(nodes, is_text),
        lambda n: found(n, n["zone"].bitwiseAND(M.ZONE_RAW) != 0, none, strip(n["text"])),
    )]
    def hit_by(i: int, selector: str) -> Column:
        raw, text = M.TAG_ZONES[M.ZONE_RAW], F.lit(None).cast("string")
        return F.transform(
            select(nodes, selector), lambda n: found(n, n["tag"].isin(*raw), F.array(F.lit(i)), text)
        )

    selectors = (schema.base, *(s for _, s in schema.fields))
    return F.concat(*lists, *[hit_by(i, s) for i, s in enumerate(selectors)])


def extract_items(found: Column, schema: Schema, most: int | None = None) -> Column:
    """``array<struct<field…>>``: one struct of texts per base element; ``most`` keeps the page's first.

    ``found`` is :func:`found_by` the schema. Base elements, the matches of each field and texts are lists
    in document order, so a base's first match and a match's texts are found by halving.
    """
    n_fields = len(schema.fields)

    def lists(found: Column) -> Column:
        texts = F.filter(found, lambda n: n["text"].isNotNull())

        def hit_by(i: int) -> Column:
            return F.filter(found, lambda n: F.array_contains(n["hits"], i)).alias(f"m{i}")

        return F.struct(texts.alias("texts"), *[hit_by(i) for i in range(n_fields + 1)])

    def with_index(x: Column) -> Column:
        names = ["texts", *(f"m{i}" for i in range(1, n_fields + 1))]
        ids = [_ids(x[c]) for c in names]
        return F.struct(
            *[x[c].alias(c) for c in (*names, "m0")],
            *[i.alias(f"{c}_ids") for c, i in zip(names, ids)],
            *[_steps(x[c]).alias(f"{c}_steps") for c in names],
        )

    def text(x: Column, element: Column) -> Column:
        first = _up_to(x["texts_ids"], x["texts_steps"], element["id"])
        last = _up_to(x["texts_ids"], x["texts_steps"], element["last"])
        below = F.filter(F.slice(x["texts"], first + 1, last - first), lambda t: ~t["raw"] | element["raw"])
        return F.when(element.isNull(), "").otherwise(F.array_join(F.transform(below, lambda t: t["text"]), ""))

    def row(x: Column, base: Column) -> Column:
        def field(i: int) -> Column:
            at = _up_to(x[f"m{i}_ids"], x[f"m{i}_steps"], base["id"])
            first = F.get(x[f"m{i}"], at)
            return let(F.when(first["id"] <= base["last"], first), lambda e: text(x, e))

        return F.struct(*[field(i).alias(name) for i, (name, _) in enumerate(schema.fields, 1)])

    def rows(x: Column) -> Column:
        bases = x["m0"] if most is None else F.slice(x["m0"], 1, most)
        return F.transform(bases, lambda b: row(x, b))

    return let(found, lambda f: let(lists(f), lambda x: let(with_index(x), rows)))


def extract(
    pages: DataFrame,
    spec: str | dict | Schema,
    order: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """``page_id, url, data, error``: extracted rows per page, or why there are none.

    Pages with an error status are filtered out of the node job by nulling their HTML.
    """
    schema = spec if isinstance(spec, Schema) else parse_schema(spec, order)
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    failed = status_error(status)
    parsed = pages.select(
        "page_id",
        "url",
        failed.alias("_failed"),
        found_by(F.when(failed.isNull(), F.col("html")), schema).alias("_found"),
    )
    data = parsed.withColumn("_data", extract_items(F.col("_found"), schema, most))
    error = F.coalesce(
        F.col("_failed"),
        F.when(F.col("_found").isNull(), F.lit("not stored")),
        F.when(F.size("_data") == 0, F.lit("No data extracted")),
    )
    return data.select(
        "page_id", "url", F.when(error.isNull(), F.col("_data")).alias("data"), error.alias("error")
    )


def extract_or_text(
    pages: DataFrame, spec: str | dict | Schema, order: str | None = None
) -> DataFrame:
    """``page_id, url, data, content``: extracted rows and the page's text, from one parse."""
    schema = spec if isinstance(spec, Schema) else parse_schema(spec, order)
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    parsed = pages.select(
        "page_id", "url", status_error(status).alias("_failed"), dom_nodes(F.col("html")).alias("_nodes")
    )
    found = F.when(F.col("_failed").isNull(), extract_items(found_in(F.col("_nodes"), schema), schema))
    return parsed.select("page_id", "url", found.alias("data"), text_content(F.col("_nodes")).alias("content"))


def extract_rows(
    pages: DataFrame, spec, order: str | None = None, most: int | None = None
) -> DataFrame:
    """Long form: ``page_id, pos`` and one column per field."""
    found = extract(pages, spec, order, most).select("page_id", positions("data").alias("pos", "item"))
    return found.filter(F.col("pos").isNotNull()).select("page_id", "pos", "item.*")


def scrape_with_schema(
    pages: DataFrame, spec, order: str | None = None, most: int | None = None
) -> DataFrame:
    """Page record whose content is the JSON text of the extracted rows."""
    schema = spec if isinstance(spec, Schema) else parse_schema(spec, order)
    parsed = pages.select(
        "page_id", "url", title(F.col("html")).alias("title"), found_by(F.col("html"), schema).alias("found"),
    )
    with_data = parsed.withColumn("data", extract_items(F.col("found"), schema, most))
    content = F.to_json("data")
    return with_data.select(
        "page_id",
        "url",
        F.lit("json").alias("format"),
        "title",
        "data",
        content.alias("content"),
        F.length(content).alias("content_length"),
    )
