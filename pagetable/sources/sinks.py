"""JSON output in the shapes a scraper's users expect."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pagetable.operators.ranking import first_per_group


def _json(value) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _pretty(value: Column, kind: DataType, depth: int = 0) -> Column:
    """JSON with one element per line and two more blanks per level; ``kind`` is the value's type."""
    inner, outer = F.lit("\n" + "  " * (depth + 1)), F.lit("\n" + "  " * depth)

    def enclosed(items: Column, brackets: str) -> Column:
        lines = F.array_join(F.transform(items, lambda x: F.concat(inner, x)), ",")
        whole = F.concat(F.lit(brackets[0]), lines, outer, F.lit(brackets[1]))
        return F.when(F.size(items) == 0, brackets).otherwise(whole)

    if isinstance(kind, StructType):
        fields = [
            F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), _pretty(value[f.name], f.dataType, depth + 1))
            for f in kind.fields
        ]
        text = enclosed(F.array(*fields).cast("array<string>"), "{}")
    elif isinstance(kind, ArrayType):
        text = enclosed(F.transform(value, lambda x: _pretty(x, kind.elementType, depth + 1)), "[]")
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(
            _scalar(e["key"].cast("string")), F.lit(": "), _pretty(e["value"], kind.valueType, depth + 1)
        )
        text = enclosed(F.transform(F.map_entries(value), entry), "{}")
    else:
        text = _scalar(value)
    return F.when(value.isNull(), "null").otherwise(text)


def _scalar(value: Column) -> Column:
    listed = _json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_lines(df: DataFrame) -> DataFrame:
    """``value``: each row as one compact JSON object, null fields kept, text unescaped."""
    return df.select(_json(F.struct("*")).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per line, in as many files as there are partitions."""
    df.write.option("ignoreNullFields", "false").json(path)


def _element(df: DataFrame, columns: list[str], pretty: bool) -> Column:
    """A row's JSON as an element of an array."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return _pretty(row, StructType([df.schema[c] for c in columns]), 1) if pretty else _json(row)


def _array_of(elements: Column, pretty: bool) -> Column:
    if not pretty:
        return F.concat(F.lit("["), F.array_join(elements, ","), F.lit("]"))
    lines = F.concat(F.lit("[\n  "), F.array_join(elements, ",\n  "), F.lit("\n]"))
    return F.when(F.size(elements) == 0, "[]").otherwise(lines)


def json_array(df: DataFrame, order: list[str], limit: int, pretty: bool = False) -> DataFrame:
    """``value``: the first ``limit`` rows by ``order`` as one JSON array, ``pretty`` with one element per line.

    One document is one row, so it takes a limit; write JSON lines for anything unbounded.
    """
    element = _element(df, df.columns, pretty).alias("text")
    keyed = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], element)
    rows = df.orderBy(*order).limit(limit).agg(F.sort_array(F.collect_list(keyed)).alias("_rows"))
    return rows.select(_array_of(F.col("_rows.text"), pretty).alias("value"))


def json_arrays(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, pretty: bool = False
) -> DataFrame:
    """``keys`` and ``value``: for each group its first ``limit`` rows by ``order``, without the keys, as a JSON array.

    ``order`` must be total within a group. Groups are cut in salted parts first, so none is ever collected whole.
    """
    first = first_per_group(df, keys, order, limit)
    element = _element(df, [c for c in df.columns if c not in keys], pretty).alias("text")
    rows = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", element))).alias("_rows"))
    return rows.select(*keys, _array_of(F.col("_rows.text"), pretty).alias("value"))


def content_only(records: DataFrame) -> DataFrame:
    """``value``: per record its ``data`` as JSON if there is any, else its ``content``."""
    content = F.col("content") if "content" in records.columns else F.lit(None)
    chosen = [content, F.lit("")]
    if "data" in records.columns:
        chosen.insert(0, F.when(F.size("data") > 0, _json("data")))
    return records.select(F.coalesce(*chosen).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    """Write a ``value`` frame as text files."""
    df.select("value").write.text(path)
