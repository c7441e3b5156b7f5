"""License scans over a positional index of rare words, in DataFrame functions alone.

A template is a passage that must stand in the file word for word and key phrases that must stand
anywhere in it. The document frequencies of all template words are counted first. Then only a
template's rarest words are looked up: their positions, shifted by where the passage has them, are
intersected, and what is left is compared with the passage itself. Since every place of a passage
holds all its words, no place is missed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pagetable.llm.common import runs_of, whole_text

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
RARE_WORDS = 3  # positions of so many words of a template are intersected


class Template(NamedTuple):
    label: str
    passage: str
    keys: tuple[str, ...] = ()


# The phrases whose places are counted, and the labels that they give.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
# Passages of well-known licenses and phrases that each of them has elsewhere.
MORE = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             ("the software is provided as is",)),
    Template("apache-2", "unless required by applicable law or agreed to in writing",
             ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification",
             ("this list of conditions",)),
    Template("gpl", "under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
)


def license_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    return runs_of(F.translate(text, UPPER, LOWER), GAP)


def word_frequencies(tokenized: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; one row per word comes back."""
    lits = F.array(*[F.lit(w) for w in vocabulary])
    found = tokenized.select(F.explode(F.array_intersect("words", lits)).alias("word"))
    counted = found.groupBy("word").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in counted}


def _places(phrase: list[str], rare: list[str]) -> Column:
    """Starts of a phrase, from ``words`` and the postings ``_index``."""
    starts = None
    for word in rare:
        at = phrase.index(word)
        # The word's position in the passage turns each posting into a start of the passage.
        shifted = F.transform(
            F.filter("_index", lambda p: p["word"] == word), lambda p: p["at"] - at
        )
        starts = shifted if starts is None else F.array_intersect(starts, shifted)
    whole = F.array(*[F.lit(w) for w in phrase])
    return F.filter(
        starts,
        lambda s: F.when(s >= 0, F.slice("words", s + 1, len(phrase)) == whole).otherwise(False),
    )


def scan(docs: DataFrame, base=BASE, more=MORE, text: str = "text") -> DataFrame:
    """Adds ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all base passages, ``first_word`` and ``last_word`` are their
    smallest and largest starts (null without any). ``labels`` has the base labels and those of
    further templates whose passage and key phrases all stand in the text. ``score`` is
    ``1 - 1 / (1 + places)`` over the places of every template that counts. A null text has no
    words; columns of ``docs`` that are named like an added one give way to it. Map-only but for
    the frequencies, an aggregate with one row per template word.
    """
    kept = [F.col(c) for c in docs.columns if c not in ADDED]
    tokenized = docs.select(
        F.struct(*kept).alias("_row"), license_words(whole_text(text)).alias("words")
    )
    phrases = dict.fromkeys(p for t in (*base, *more) for p in (t.passage, *t.keys))
    vocabulary = sorted({w for p in phrases for w in p.split()})
    frequency = word_frequencies(tokenized.select("words"), vocabulary)
    rare = {}
    for p in phrases:
        # A word that a phrase has twice gives two shifts, so it is no posting.
        once = [w for w in dict.fromkeys(p.split()) if p.split().count(w) == 1]
        rare[p] = sorted(once, key=lambda w: (frequency[w], w))[:RARE_WORDS]
    looked_up = sorted({w for ws in rare.values() for w in ws})
    posting = F.transform(
        "words",
        lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("word"), i.alias("at"))),
    )
    indexed = tokenized.withColumn("_index", F.filter(posting, lambda p: p.isNotNull()))
    places = {p: f"_places{i}" for i, p in enumerate(phrases)}
    found = indexed.withColumns({places[p]: _places(p.split(), rare[p]) for p in phrases})

    def stands(t: Template) -> Column:
        ok = F.size(places[t.passage]) > 0
        for key in t.keys:
            ok &= F.size(places[key]) > 0
        return ok

    def labels(templates) -> Column:
        each = F.array(*[F.when(stands(t), F.lit(t.label)) for t in templates])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(each))), ",")

    starts = F.concat(*[places[t.passage] for t in base])
    n_all = sum(
        (F.when(stands(t), F.size(places[t.passage])).otherwise(0) for t in more), F.size(starts)
    )
    return found.select(
        "_row.*",
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels((*base, *more)).alias("labels"),
        (1 - 1 / (1 + n_all)).cast("double").alias("score"),
    )


def scan_sql() -> str:
    """The same for DuckDB, by comparing every phrase at every word."""

    def at(phrase: str) -> str:
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        return f"list_filter(range(len(w)), lambda i: {same})"

    def stands(t: Template) -> str:
        return " AND ".join(f"len({at(p)}) > 0" for p in (t.passage, *t.keys))

    def labels(templates) -> str:
        each = ", ".join(f"CASE WHEN {stands(t)} THEN '{t.label}' END" for t in templates)
        present = f"list_filter([{each}], lambda x: x IS NOT NULL)"
        return f"coalesce(array_to_string(list_sort(list_distinct({present})), ','), '')"

    starts = " || ".join(at(t.passage) for t in BASE)
    more = " + ".join(f"CASE WHEN {stands(t)} THEN len({at(t.passage)}) ELSE 0 END" for t in MORE)
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base,
               list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
               base_labels, labels, (1 - 1 / (1 + len(s) + n_more)::DOUBLE) AS score
        FROM (SELECT doc_id, w, {starts} AS s, {more} AS n_more, {labels(BASE)} AS base_labels,
                     {labels((*BASE, *MORE))} AS labels
              FROM (SELECT doc_id, {words} AS w FROM documents))"""
