"""Exact ranks and top-k per group that survive one group holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from pagetable.session import Stage

_SALTS = 64


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    limits: DataFrame | None = None,
    name: str = "rank",
) -> DataFrame:
    """Adds ``row_number() OVER (PARTITION BY keys ORDER BY order)``, from 1.

    A plain window would sort each group in one task. Here all rows are dealt by ranges of
    ``(keys, order)``, whose bounds Spark samples so that every range has about as many rows, and
    written. A group that spans ranges gets its offsets from their counts, and rows are numbered within
    their range only.

    ``limits`` (keys, ``n``) keeps the first ``n`` rows of each group; ranges wholly beyond the
    limit are dropped before anything is sorted.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    rows = Stage(df.sparkSession, "ranked").save(dealt, "rows")
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset")
    )
    if limits is not None:
        offsets = offsets.join(limits.select(*keys, "n"), keys).filter(F.col("_offset") < F.col("n"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = rows.join(offsets, [*keys, "_range"]).withColumn(
        name, F.col("_offset") + F.row_number().over(within)
    )
    if limits is not None:
        numbered = numbered.filter(F.col(name) <= F.col("n")).drop("n")
    return numbered.drop("_range", "_offset")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    ``order`` must be total. Each group is first cut within salted parts, so no task sorts more of a
    group than its part and what the parts leave.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(_SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = (
        salted.withColumn("_part_rank", F.row_number().over(part))
        .filter(F.col("_part_rank") <= k)
        .drop("_salt", "_part_rank")
    )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
