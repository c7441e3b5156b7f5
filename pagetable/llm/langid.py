"""Language identification by compression: the language whose dictionary shrinks a text most.

Per language a zstandard raw-content dictionary is cut from a bounded sample of its training texts.
A text is compressed with every dictionary and gets the language of the smallest result.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pagetable.operators.ranking import first_per_group

SAMPLE_TEXTS = 200  # training texts per language, at most
PIECE_CHARS = 320  # letters that each of them gives to the dictionary, which zstandard matches along its whole length
BLOCK = 16 << 10  # bytes compressed at once, so that the dictionary counts all along a long text
MARGIN = 0.02  # an answer is narrow when the second language needs less than 2 % more bytes
LEVEL = 6
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """The text in lower case with every run of anything but letters as one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """One dictionary per language of ``text, lang``, the language of most texts first.

    The sample takes each language's ``SAMPLE_TEXTS`` different texts of smallest hash, which any
    order of the rows gives alike, and a piece of each. A first pass over hashes alone finds the largest hash taken, a language
    cut in salted parts; a second one reads the texts. What reaches the
    driver is bounded by the parameters above times the number of languages.
    """
    usable = labelled.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("_hash", F.xxhash64("text"))
    hashes = usable.select("lang", "_hash").distinct()
    least = first_per_group(hashes, ["lang"], [F.col("_hash")], SAMPLE_TEXTS)
    least = least.groupBy("lang").agg(F.max("_hash").alias("_last"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    taken = F.lit(False)
    bounds = least.collect()
    for row in bounds:
        taken |= (F.col("lang") == row["lang"]) & (F.col("_hash") <= row["_last"])
    # A piece of each text, from a place that its hash chooses.
    whole = letters(F.col("text"))
    room = F.greatest(F.length(whole) - PIECE_CHARS, F.lit(0)) + 1
    part = F.substring(whole, F.pmod(F.col("_hash"), room).cast("int") + 1, F.lit(PIECE_CHARS))
    parts = usable.filter(taken).groupBy("lang", "_hash").agg(F.min(part).alias("_part"))
    found: dict[str, list[str]] = {}
    for row in parts.orderBy("lang", "_hash").collect():
        found.setdefault(row["lang"], []).append(row["_part"])
    by_size = sorted(found, key=lambda lang: (-sizes[lang], lang))
    return {lang: " ".join(found[lang]).encode() for lang in by_size}


@lru_cache(maxsize=4)
def _compressors(contents: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    found = []
    for content in contents:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(
            level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False,
            write_dict_id=False,
        ))
    return found


def identify(docs: DataFrame, known: dict[str, bytes], column: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``narrow``.

    ``score`` is the share of bytes that the best language saves against the second (1 where
    there is no second); ``narrow`` tells that it is under ``MARGIN``, for callers that reject such
    answers. A text that is null or has no letter is ``und`` with score 0, and so is every text when
    no language is known. Ties go to the language named first in ``known``. Map-only.
    """
    langs, contents = list(known), tuple(known.values())

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        tools = _compressors(contents)
        preds, scores = [], []
        for text in texts:
            if not tools or not text or not text.strip():
                preds.append(UNKNOWN)
                scores.append(0.0)
                continue
            data = text.encode()
            blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(len(tool.compress(b)) for b in blocks) for tool in tools]
            first, *rest = sorted(sizes)
            preds.append(langs[sizes.index(first)])
            scores.append(1 - first / rest[0] if rest else 1.0)
        return pd.DataFrame({"lang_pred": preds, "score": scores})

    shown = letters(F.col(column))
    got = docs.withColumn("_best", best(shown))
    return (
        got.withColumn("lang_pred", F.col("_best.lang_pred"))
        .withColumn("score", F.col("_best.score"))
        .withColumn("narrow", F.col("score") < MARGIN)
        .drop("_best")
    )


def predict_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, narrow`` for every document.

    Dictionaries come from the documents that are not held out (crc32 of the doc_id modulo 4 is not
    2; a null doc_id is not held out) and have a language. Predictions see the text alone; a null or empty one is
    ``und``, repeated rows are told alike, and an empty table gives no rows.
    """
    held_out = is_held_out(F.col("doc_id"))
    known = dictionaries(docs.filter(~held_out).select("text", "lang"))
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), known)
    return found.select("doc_id", "held_out", "lang_pred", "score", "narrow")
