"""Keyword search over stored texts, post search and user timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.operators.ranking import first_per_group
from pagetable.session import Stage

K1, B = 1.2, 0.75  # fixed values: the usual BM25 parameters

POST_FIELDS = ("id", "date", "user", "fullname", "content", "likes", "retweets", "replies", "url")


_WORD = r"[\p{L}\p{N}]+"


def n_words(text: Column) -> Column:
    """How many runs of letters and digits the text has."""
    return F.regexp_count(text, F.lit(_WORD))


def count_terms(text: Column, terms: list[str]) -> Column:
    """Whole-word occurrences of the (lower-case) terms, letter case aside; null for a null text."""
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}])"
    return F.regexp_count(F.lower(text), F.lit(pattern))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, cut like the texts are. Raises ``ValueError`` for none."""
    words = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    if not words:
        raise ValueError(f"no search terms in {query!r}")
    return list(dict.fromkeys(words))


def hit_columns(docs: DataFrame, score_column: str, description: int | None) -> DataFrame:
    """Search-hit columns; missing values become ``''``. The description is the text, or so many
    characters of it."""
    text = F.col("text") if description is None else F.substring("text", 1, description)
    return docs.select(
        "id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url")],
        F.coalesce(text, F.lit("")).alias("description"),
        score_column,
    )


def search(
    docs: DataFrame, query: str, limit: int = 5, description: int | None = None
) -> DataFrame:
    """Best ``limit`` of ``id, title, url, text`` by how often the query's terms occur.

    Scores are computed row by row, so the plan is one scan and a bounded top-k: no shuffle.
    """
    score = count_terms(F.col("text"), query_terms(query))
    best = docs.withColumn("score", score.cast("long")).orderBy(F.desc("score"), "id").limit(limit)
    # Tested after the limit: earlier, the filter would score every text a second time.
    return hit_columns(best.filter(F.col("score") > 0), "score", description)


def search_bm25(
    docs: DataFrame, query: str, limit: int = 20, description: int | None = None
) -> DataFrame:
    """Best ``limit`` documents by BM25 (Robertson and Zaragoza, 2009), scores to 6 digits.

    One pass over the texts counts words and terms; only these numbers are written. The collection's
    figures and the best rows come from them, and texts are fetched for the best rows alone.
    ``id`` must be unique.
    """
    terms = query_terms(query)
    stage = Stage(docs.sparkSession, "bm25")
    counts = docs.select(
        "id",
        n_words(F.col("text")).alias("_len"),
        *[count_terms(F.col("text"), [t]).alias(f"_tf{i}") for i, t in enumerate(terms)],
    )
    counted = stage.save(counts, "counts")
    collection = counted.select(
        F.struct(
            F.count("*").alias("n"),
            F.avg("_len").alias("mean"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
        )
    ).scalar()
    score = F.lit(0.0)
    with_stats = counted.withColumn("_all", collection)
    for i in range(len(terms)):
        tf, df, n = F.col(f"_tf{i}"), F.col(f"_all.df{i}"), F.col("_all.n")
        idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("_len") / F.col("_all.mean"))
        score = score + idf * tf * (K1 + 1) / norm
    # Every term found adds a positive amount, so documents without any are the ones at zero.
    scored = with_stats.withColumn("_score", score).withColumn("score", F.round("_score", 6))
    best = scored.orderBy(F.desc("score"), F.desc(F.col("_score") > 0), "id").limit(limit)
    best = best.filter(F.col("_score") > 0).select("id", "score")
    # At most ``limit`` rows of two numbers.
    return hit_columns(docs.join(F.broadcast(best), "id"), "score", description)


def posts(raw: DataFrame) -> DataFrame:
    """The nine post fields of a raw post table; an absent user is ``unknown``."""
    return raw.select(
        "id",
        F.col("ts").alias("date"),
        F.coalesce("username", F.lit("unknown")).alias("user"),
        F.coalesce("display_name", F.lit("")).alias("fullname"),
        "content",
        "likes",
        "retweets",
        "replies",
        "url",
    )


def post_search(raw: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Newest ``limit`` posts whose content contains the query, letter case aside."""
    matching = raw.filter(F.lower("content").contains(query.lower()))
    return posts(matching).orderBy(F.desc("date"), "id").limit(limit)


def _handle(name: Column) -> Column:
    return F.ltrim(name, F.lit("@"))


def timeline(users: DataFrame, raw: DataFrame, handle: str, limit: int = 20) -> DataFrame:
    """Newest ``limit`` posts of one user; empty for an unknown handle.

    ``users`` has ``id, handle``; ``raw`` has ``user_id`` and the post columns. The handle names
    one user, so the broadcast side is a single id.
    """
    user = users.filter(F.col("handle") == handle.lstrip("@")).orderBy("id").limit(1)
    own = raw.join(F.broadcast(user.select(F.col("id").alias("user_id"))), "user_id")
    shown = posts(own).drop("user", "fullname")
    return shown.orderBy(F.desc("date"), "id").limit(limit)


def timelines(users: DataFrame, raw: DataFrame, handles: DataFrame, limit: int = 20) -> DataFrame:
    """Newest ``limit`` posts of every handle in ``handles``, as ``handle, rank`` and the post.

    A handle that no user has, or whose user has no posts, gives one row with ``error`` and nulls.
    Handles are resolved first, so only the posts of asked users are ranked.
    """
    asked = handles.select(_handle(F.col("handle")).alias("handle")).distinct()
    known = (
        asked.join(users.select("handle", "id"), "handle", "left")
        .groupBy("handle")
        .agg(F.min("id").alias("user_id"))
    )
    wanted = raw.join(known.select("user_id"), "user_id", "left_semi")
    cut = first_per_group(wanted, ["user_id"], [F.desc("ts"), F.col("id")], limit)
    rows = known.join(cut, "user_id", "left")
    # The two messages.
    error = F.when(
        F.col("user_id").isNull(), F.concat(F.lit("User not found: "), "handle")
    ).when(F.col("rank").isNull(), "No tweets found")
    return rows.select(
        "handle", "rank", "id", F.col("ts").alias("date"), "content", "likes", "retweets",
        "replies", "url", error.alias("error"),
    )
