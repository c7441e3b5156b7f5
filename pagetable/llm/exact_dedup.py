"""Exact duplicates: groups by a 128-bit hash of the normalised text, told apart by their bytes.

Narrow rows of ``hash, doc_id`` are grouped first, with counts combined map-side, so copies move as
numbers and not as texts. Only texts whose hash occurs more than once are then compared: they are
grouped by hash and whole text, equal ones combined map-side, and a hash that has two texts is a
collision, whose rows are grouped by their texts instead.

A group may hold a third of all rows. The at most ``HOT`` groups that large meet their rows by a
broadcast; the rest, each below one part in ``HOT``, by an exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import spot_map, whole_text, with_spotted
from pagetable.session import Stage

HOT = 1000
GAP = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, GAP, " ")


def fingerprint(text: Column) -> Column:
    """128 bits of hash."""
    return F.unhex(F.md5(text))


def _repeated_only(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Texts whose hash is marked in a bit map of the repeated ones: all of those, and few others.

    The map has a fixed size, so it is broadcast. Over very many groups more texts pass; they only
    take part in a comparison that they do not need.
    """
    spots = spot_map(groups.filter("n > 1").select("mark"))
    return with_spotted(texts, F.col("mark"), spots).filter("_spotted").select("mark", "norm")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size, least doc_id and the row that stays of each group; a null doc_id comes after all others."""
    stays = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), stays.alias("keep_row")
    )


def _decided(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    hot = F.broadcast(groups.filter(F.col("n") * HOT >= total))
    large = rows.join(hot, keys)
    small = rows.join(hot.select(*keys), keys, "left_anti").join(groups, keys)
    return large.unionByName(small).select(
        "record", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _numbered(docs: DataFrame, columns: list[str], mark: Callable[[Column], Column]) -> DataFrame:
    """``record`` (the given columns), ``doc_id``, ``norm`` and its ``mark``; nothing of ``docs`` can clash."""
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"), F.col("doc_id"),
        normalized(whole_text()).alias("norm"),
    )
    return held.withColumn("mark", mark(F.col("norm")))


def decide(
    docs: DataFrame, columns: list[str] | None = None, mark: Callable[[Column], Column] = fingerprint
) -> DataFrame:
    """One row per row of ``docs``: ``record, keep_id, group_size, kept, text_sha256``.

    ``record`` is a struct of the ``columns`` asked for (default: all). Texts are equal when they are the same after
    each run of ASCII white space is replaced by one space; a null text counts as empty. The row with the
    least doc_id stays, null doc_ids coming last; of several rows with that doc_id and text
    exactly one does. ``keep_id`` is null only where no row of the group has a doc_id. An empty table gives no
    rows. ``mark`` is the hash that groups are first made by; with a weak one results are the same.
    """
    columns = docs.columns if columns is None else columns
    stage = Stage(docs.sparkSession, "exact-dedup")
    texts = _numbered(docs, columns, mark)
    narrow = texts.select("record", "doc_id", "mark", F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = stage.save(narrow.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = stage.save(_grouped(rows, ["mark"]), "groups")

    distinct = _repeated_only(texts.select("mark", "norm"), groups).groupBy("mark", "norm").count()
    collisions = distinct.groupBy("mark").count().filter("count > 1").select("mark")
    collisions = stage.save(collisions, "collisions")
    total = rows.count()
    if collisions.isEmpty():
        return _decided(rows, groups, ["mark"], total)
    clear = _decided(
        rows.join(collisions, "mark", "left_anti"), groups.join(collisions, "mark", "left_anti"), ["mark"], total
    )
    held = texts.join(collisions, "mark").withColumn("sha", F.unhex(F.sha2("norm", 256)))
    held = stage.save(held.withColumn("row", F.monotonically_increasing_id()), "colliding")
    return clear.unionByName(_decided(held, _grouped(held, ["mark", "norm"]), ["mark", "norm"], total))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    return decide(docs).filter("kept").select("record.*")


def exact_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``; see :func:`decide`."""
    return decide(docs, ["doc_id"]).select("record.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
