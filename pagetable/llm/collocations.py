"""Phrases of words that stand together more often than apart, by multikey quicksort of suffixes.

The places of a chunk's words are pointers to suffixes. Three-way partitioning by the word at some depth
leaves those equal to the pivot together: their number is the count of the phrase so far, and they alone are
partitioned by the next word. Partitions that cannot reach the least count are abandoned.

That holds only where all suffixes with the same leading words meet, so Spark routes them there. Words are
counted first, and pieces end at infrequent ones, which no frequent phrase holds. What is left is routed by
the first two words. A leading phrase that at least one in ``HOT`` words begins is not routed by
itself: it is counted where it stands, and its suffixes go by one word more. These phrases are found with
the words: whatever is that frequent overall is half as frequent or more in some chunks, and these
hold at least half of it. Suffixes travel packed, many to a row: in order and word place by word place, which compresses
well, as numbers of the ``COMMON`` most frequent words or of words that the row brings along.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagetable.llm.common import mix
from pagetable.operators.ranking import first_per_group
from pagetable.session import Stage

LONGEST = 5
LEAST = 100
TOP = 2000
HOT = 4096
CHUNK_BYTES = 1 << 24  # text that a task holds at a time
BUCKET = 500_000  # suffixes that meet in a task, on average
COMMON = 48 << 10  # words that all tasks know by number; the other 16-bit numbers are those of a row's own words
_BITS = 1 << 23  # of the map of frequent words, whatever their number

_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of many texts: ``codes`` into ``names``, and the ``piece`` that each stands in."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        firsts = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
        kind = _KIND[data]
        # A break may stand at a text's first byte, and a text begins a piece as a break does.
        breaks = np.flatnonzero(kind == _BREAK)
        inside = kind == _WORD
        del kind
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[firsts] = inside[firsts]
        place = np.flatnonzero(start)
        self.piece = (np.searchsorted(breaks, place) + np.searchsorted(firsts, place, "right")).astype(np.int32)
        del place, breaks
        letters = _LOWER[data[inside]]
        edges = np.append(np.flatnonzero(start[inside]), len(letters)).astype(np.int64)
        names = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(letters)]
        ).dictionary_encode()
        self.codes, self.names = names.indices.to_numpy(zero_copy_only=False), names.dictionary

    def keep(self, known: np.ndarray) -> None:
        """Words that are not ``known`` go, and pieces end where they stood."""
        here = known[self.codes]
        self.piece = (self.piece + np.cumsum(~here, dtype=np.int32))[here]
        self.codes = self.codes[here]

    def ends(self) -> np.ndarray:
        """For each word, where its piece ends."""
        edges = np.flatnonzero(np.append(True, self.piece[1:] != self.piece[:-1])) if len(self.piece) else self.piece
        sizes = np.diff(np.append(edges, len(self.piece)))
        return np.repeat(edges + sizes, sizes)


def equal_prefixes(codes: np.ndarray, at: np.ndarray, end: np.ndarray, least: int, longest: int = LONGEST):
    """``depth, place, count`` of every prefix that at least ``least`` of the suffixes ``at`` to ``end`` begin with."""
    least = max(least, 1)
    live = at < end
    at, end = at[live], end[live]
    todo = [(at, end, codes[at], 0)]
    while todo:
        at, end, keys, depth = todo.pop()
        n = len(at)
        if n < least:
            continue
        pivot = np.sort(keys[:: max(1, n // 15)])
        pivot = pivot[len(pivot) // 2]
        equal, less = keys == pivot, keys < pivot
        count = int(np.count_nonzero(equal))
        if count < n:
            for side in (less, ~(less | equal)):
                if np.count_nonzero(side) >= least:
                    todo.append((at[side], end[side], keys[side], depth))
            if count < least:
                continue
            at, end = at[equal], end[equal]
        depth += 1
        yield depth, int(at[0]), count
        if depth < longest:
            live = at + depth < end
            at, end = at[live], end[live]
            if len(at) >= least:
                todo.append((at, end, codes[at + depth], depth))


def _chunks(batches, size: int):
    """``lang, texts`` of each language of about ``size`` bytes at a time, and the number of their words' upper bound."""
    waiting, n = [], 0

    def parts():
        table = pa.Table.from_batches(waiting).combine_chunks()
        langs = table["lang"].combine_chunks()
        return [(lang, table["text"].combine_chunks().filter(pc.equal(langs, lang)))
                for lang in langs.unique()]

    for batch in batches:
        waiting.append(batch)
        n += batch.nbytes
        if n >= size:
            yield parts()
            waiting, n = [], 0
    if n:
        yield parts()


def _phrases(words: Words, found) -> list[str]:
    """Texts of ``(depth, place)``."""
    return [
        b" ".join(words.names.take(pa.array(words.codes[at : at + depth])).to_pylist()).decode() for depth, at in found
    ]


def _counts(docs: DataFrame, hot: int, longest: int, chunk_bytes: int) -> DataFrame:
    """``lang, phrase, n`` of all words; of phrases, where frequent in a chunk; and of no words, the number of all."""

    def count(batches):
        for parts in _chunks(batches, chunk_bytes):
            parts = [(lang, Words(texts)) for lang, texts in parts]
            least = sum(len(w.codes) for _, w in parts) // (2 * hot) + 1
            for lang, words in parts:
                numbers = np.bincount(words.codes, minlength=len(words.names))
                names = words.names.cast(pa.binary()).cast(pa.string())
                found = [
                    f for f in equal_prefixes(words.codes, np.arange(len(words.codes)), words.ends(), least, longest)
                    if f[0] > 1
                ]
                names = pa.concat_arrays([names, pa.array(_phrases(words, [f[:2] for f in found]) + [""], pa.string())])
                numbers = np.concatenate([numbers, [f[2] for f in found], [len(words.codes)]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(names), pa.string()), names, pa.array(numbers)], ["lang", "phrase", "n"]
                )

    rows = docs.mapInArrow(count, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _mark(lang: bytes, word: bytes) -> int:
    return zlib.crc32(lang + b"\0" + word) % _BITS


def _bit_map(words: DataFrame) -> np.ndarray:
    """Which marks a frequent word has; of fixed size, so far more words only let others pass."""
    mark = F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")) % _BITS
    spots = words.select(mark.alias("mark")).groupBy(F.expr("mark div 64").alias("place"))
    bits = spots.agg(F.bit_or(F.expr("shiftleft(1L, cast(mark % 64 as int))")).alias("bits"))
    out = np.zeros(_BITS // 64, np.int64)
    for place, value in bits.collect():
        out[place] = value
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


_PACKED = "bucket int, lang string, words array<string>, codes binary, sizes binary, phrase string, n long"


def _packed(
    docs: DataFrame, known: np.ndarray, common: dict, hot: dict, buckets: int, longest: int, chunk_bytes: int
) -> DataFrame:
    """Suffixes by the bucket of their leading words; hot phrases with their counts instead."""

    def rows(lang: str, words: Words):
        mark = lang.encode()
        names = words.names.to_pylist()
        words.keep(np.fromiter((known[_mark(mark, w)] for w in names), bool, len(names)))
        codes, end = words.codes.astype(np.int64), words.ends()
        at = np.arange(len(codes))
        end = np.minimum(end, at + longest)
        at, end = at[end - at >= 2], end[end - at >= 2]
        depth = np.full(len(at), 2, np.int8)

        # Suffixes whose leading words are hot go on by one word more, level by level.
        place = {w: i for i, w in enumerate(names)} if hot.get(lang) else {}
        level = {(w,): i for w, i in place.items()}
        rest, node = np.arange(len(at)), codes[at]
        for size in range(2, longest + 1):
            keys, phrases = [], []
            for phrase in hot.get(lang, {}).get(size, ()):
                if phrase[:-1] in level and phrase[-1] in place:
                    keys.append(level[phrase[:-1]] * len(names) + place[phrase[-1]])
                    phrases.append(phrase)
            if not keys:
                break
            order = np.argsort(keys)
            keys, phrases = np.array(keys)[order], [phrases[i] for i in order]
            long = end[rest] - at[rest] >= size
            rest, node = rest[long], node[long]
            key = node * len(names) + codes[at[rest] + size - 1]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[spot] == key
            rest, node = rest[hit], spot[hit]
            for phrase, n in zip(phrases, np.bincount(node, minlength=len(keys)).tolist()):
                if n:
                    text = b" ".join(phrase)
                    yield xxhash.xxh32_intdigest(text) % buckets, None, None, None, text.decode(), n
            # Those that end here are counted; no suffix of as many words is left to route.
            depth[rest] = np.where(end[rest] - at[rest] == size, 0, size + 1)
            level = {p: i for i, p in enumerate(phrases)}
        at, end, depth = at[depth > 0], end[depth > 0], depth[depth > 0]
        if not len(at):
            return
        used = np.unique(codes)
        hashes = np.zeros(len(names), np.uint64)
        hashes[used] = [xxhash.xxh64_intdigest(names[i]) for i in used.tolist()]
        route = np.full(len(at), xxhash.xxh64_intdigest(mark), np.uint64)
        for i in range(longest):
            goes = np.flatnonzero(depth > i)
            route[goes] = mix(route[goes] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes[at[goes] + i]])
        bucket = (route % np.uint64(buckets)).astype(np.int32)
        del route
        number = pc.index_in(words.names, value_set=pa.array(common.get(lang, ([], []))[0], pa.large_binary()))
        number = number.fill_null(-1).to_numpy(zero_copy_only=False)
        number = np.append(np.array(common.get(lang, ([], []))[1], np.int64), -1)[number]
        order = np.lexsort((codes[at + 1], codes[at], bucket))
        bucket, at, size, depth = bucket[order], at[order], (end - at)[order], depth[order]
        shape = (size + 8 * depth.astype(np.int64)).astype(np.uint8)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(bucket))):
            flat = codes[np.concatenate([at[a:b][size[a:b] > i] + i for i in range(longest)])]
            shown = number[flat]
            rare = shown < 0
            own, local = np.unique(flat[rare], return_inverse=True)
            shown[rare] = COMMON + local
            kind = np.uint16 if COMMON + len(own) <= 1 << 16 else np.uint32
            yield int(bucket[a]), own, shown.astype(kind).tobytes(), shape[a:b].tobytes(), None, None

    def pack(batches):
        schema = pa.schema([
            ("bucket", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("codes", pa.binary()),
            ("sizes", pa.binary()), ("phrase", pa.string()), ("n", pa.int64()),
        ])
        for parts in _chunks(batches, chunk_bytes):
            for lang, texts in parts:
                words = Words(texts)
                names = words.names.cast(pa.binary()).cast(pa.string())
                packed = list(rows(lang.as_py(), words))
                for at in range(0, len(packed), 512):
                    buckets_, own, codes, sizes, phrases, n = zip(*packed[at : at + 512])
                    edges = np.append(0, np.cumsum([0 if o is None else len(o) for o in own])).astype(np.int32)
                    flat = np.concatenate([o for o in own if o is not None] or [np.zeros(0, np.int64)])
                    lists = pa.ListArray.from_arrays(pa.array(edges), names.take(pa.array(flat)))
                    columns = [pa.array(buckets_, pa.int32()), pa.array([lang.as_py()] * len(own)), lists,
                               pa.array(codes, pa.binary()), pa.array(sizes, pa.binary()),
                               pa.array(phrases, pa.string()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(pack, _PACKED)


def _sorted_bucket(common: dict, least: int, longest: int):
    """Frequent phrases of one bucket's suffixes."""
    shown = {number: word.decode() for words, numbers in common.values() for word, number in zip(words, numbers)}

    def count(table: pa.Table) -> pa.Table:
        out = []
        for lang in table["lang"].unique().to_pylist():
            rows = table.filter(pc.equal(table["lang"], lang))
            hot = rows.filter(pc.is_valid(rows["phrase"])).group_by("phrase").aggregate([("n", "sum")])
            out += [(lang, p, n) for p, n in zip(hot["phrase"].to_pylist(), hot["n_sum"].to_pylist()) if n >= least]
            rows = rows.filter(pc.is_valid(rows["codes"]))
            if not rows.num_rows:
                continue
            words = rows["words"].combine_chunks()
            counts = words.value_lengths().to_numpy()
            names = words.flatten().dictionary_encode()
            local = names.indices.to_numpy()
            names = names.dictionary.to_pylist()
            shapes = [np.frombuffer(s, np.uint8) for s in rows["sizes"].to_pylist()]
            shape = np.concatenate(shapes)
            size, depth = shape % 8, shape // 8
            end = np.cumsum(size, dtype=np.int64)
            at = end - size
            codes, before, done = np.empty(int(end[-1]), np.int32), 0, 0
            for packed, n, own in zip(rows["codes"].to_pylist(), counts.tolist(), shapes):
                packed = np.frombuffer(packed, np.uint16 if COMMON + n <= 1 << 16 else np.uint32).astype(np.int32)
                rare = packed >= COMMON
                packed[rare] = COMMON + local[before + packed[rare] - COMMON]
                before += n
                starts, sizes, read = at[done : done + len(own)], own % 8, 0
                done += len(own)
                for i in range(longest):
                    here = starts[sizes > i] + i
                    codes[here] = packed[read : read + len(here)]
                    read += len(here)
            # Shorter phrases than those that suffixes were routed by have others elsewhere.
            for routed in np.unique(depth).tolist():
                here = depth == routed
                for long, place, n in equal_prefixes(codes, at[here], end[here], least, longest):
                    if long >= routed:
                        phrase = codes[place : place + long].tolist()
                        out.append((lang, " ".join([shown[c] if c < COMMON else names[c - COMMON] for c in phrase]), n))
        langs, phrases, n = zip(*out) if out else ((), (), ())
        return pa.table({
            "lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "n": pa.array(n, pa.int64()),
        })

    return count


def frequent_phrases(
    docs: DataFrame, stage: Stage, least: int = LEAST, longest: int = LONGEST, hot: int = HOT,
    chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of words and phrases that occur ``least`` times, and ``lang, n``: all words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = _counts(rows, hot, longest, chunk_bytes).filter((F.col("n") >= least) | (F.col("phrase") == ""))
    counts = stage.save(counts, "words")
    is_phrase = F.contains("phrase", F.lit(" "))
    words = counts.filter(~is_phrase & (F.col("phrase") != ""))
    totals = counts.filter(F.col("phrase") == "").select("lang", "n")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # At most 2 * hot of each length: they were counted where frequent only, in disjoint places.
    leading: dict[str, dict[int, list]] = {}
    for lang, phrase in counts.filter(is_phrase & (F.col("n") * 2 * hot >= total)).select("lang", "phrase").collect():
        phrase = tuple(phrase.encode().split(b" "))
        leading.setdefault(lang, {}).setdefault(len(phrase), []).append(phrase)
    common: dict[str, tuple[list, list]] = {}
    most = words.orderBy(F.desc("n"), "lang", "phrase").limit(COMMON).select("lang", "phrase").collect()
    for number, (lang, word) in enumerate(most):
        own = common.setdefault(lang, ([], []))
        own[0].append(word.encode())
        own[1].append(number)
    packed = _packed(rows, _bit_map(words), common, leading, max(1, -(-total // bucket)), longest, chunk_bytes)
    count = _sorted_bucket(common, least, longest)
    found = packed.groupBy("bucket").applyInArrow(count, "lang string, phrase string, n long")
    return stage.save(words.unionByName(found), "phrases"), totals


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, hot: int = HOT,
    chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language of ``docs`` (``text, lang``).

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends and these into words at spaces and
    tabs. A phrase of 2 to ``longest`` words of one piece that occurs ``a >= least`` times is cut in two where
    ``floor(1000 * a * n / (l * r))`` is least, first at the shortest first part; ``n`` counts all words
    of the language, ``l`` and ``r`` the two parts. A phrase that always stands in one and the same longer phrase
    is left out. Ties go to larger ``a``, then to the phrase first in byte order. A null text is empty, a null language
    is ``und``; a language without phrases, or an empty table, gives no rows.
    """
    stage = Stage(docs.sparkSession, "collocations")
    found, totals = frequent_phrases(docs, stage, least, longest, hot, chunk_bytes, bucket)
    return rank_phrases(found, totals, top)


def rank_phrases(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Scores and ranks from ``lang, phrase, n`` of all frequent words and phrases, and ``lang, n`` of all words."""
    words = F.split("phrase", " ")
    phrases = found.filter(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    parts = cut.join(found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    parts = parts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # 38 digits hold the product for up to 10 ** 17 words.
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    parts = parts.join(totals, "lang")
    above = (F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).cast("decimal(38,0)")
    parts = parts.withColumn("_above", above).withColumn("_below", (exact["l"] * exact["r"]).cast("decimal(38,0)"))
    scored = parts.withColumn("score", F.expr("_above div _below").cast("long"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
    # A phrase in a longer one as often as at all is also in one a word longer as often.
    longer = phrases.filter(F.size("w") > 2).select(
        "lang", "a", F.explode(F.array(
            F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w")), " ")
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(F.coalesce("_longer", F.lit(0)) < F.col("c.a"))
    rows = kept.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = first_per_group(rows, ["lang"], order, top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), spans AS (
  SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places
), f AS (
  SELECT lang, k AS size, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS n FROM spans GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 100
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, t.n,
    (1000::HUGEINT * c.a * t.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[: c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), inside AS (
  SELECT DISTINCT q.lang, p.phrase
  FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates) q,
    LATERAL (SELECT unnest(list_transform(range(1, q.size - q.m + 2),
      lambda i: array_to_string(q.w[i : i + q.m - 1], ' '))) AS phrase) p
  JOIN candidates c ON c.lang = q.lang AND c.phrase = p.phrase AND 100 * q.a >= 100 * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""
