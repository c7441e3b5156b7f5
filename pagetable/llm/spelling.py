"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

One replaced letter changes two counts by one, up and down; one inserted letter changes one. So the words near
a given one lie in a small box around its counts, among words of its own length and of the next. A
tree is searched with what is left of the box: once a plane is crossed upwards, no other may be.
What the box holds is compared by halves of the word (one edit leaves a half as it was) and then
letter by letter.

Spark deals words to cells. The upper tree of each length is fitted to a bounded sample and sent to
the tasks; a word is indexed in the cell it lies in and looked up in all cells its box meets. A cell
that the upper tree cannot make small enough, as of many words with equal counts, is cut into parts
and its look-ups into as many blocks. Each task builds the lower tree of one part and gives per word
only the number of near words and the best of them, never pairs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagetable.llm.common import whole_text
from pagetable.session import Stage

SHORTEST = 7
RATIO = 10
SAMPLE = 1 << 16  # words that the upper trees are fitted to
SAMPLED_LENGTH = 256  # longer words have no upper tree
CELL_BYTES = 1 << 19  # letters of a part's words
LEAF = 48
_LEAST_SAMPLE = 32  # sampled words that a cell of the upper tree keeps, which bounds their number

# Letters of the contract, all in Latin-1: a-z and U+00C0 to U+00FF. Other codes take no part.
_DIMENSIONS = 26 + 64
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[ord("a") : ord("z") + 1] = np.arange(26)
_DIMENSION[0xC0:] = 26 + np.arange(64)
_ODD = np.random.default_rng(7).integers(0, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def words(docs: DataFrame, shortest: int = SHORTEST, wrong_every: int | None = 31) -> DataFrame:
    """``word, n``: the words of at least ``shortest`` letters that occur twice or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where ``wrong_every`` divides the crc32 of
    ``<doc_id>:<word>``, the word loses the letter that the same number points to. A null text has
    no words, a null doc_id is written as nothing.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(whole_text(), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % shortest), F.lit(0))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    ).withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")))
    if wrong_every:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        cut = F.expr("concat(left(run, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
        rows = rows.withColumn("run", F.when(F.col("h") % wrong_every == 0, cut).otherwise(F.col("run")))
    counts = rows.filter(F.length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.filter("n > 1")


class Codes:
    """Words of one length: their letters, and how often each has every letter."""

    def __init__(self, words: list[bytes], length: int) -> None:
        self.n, self.length = len(words), length
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(self.n, length)
        kind = np.uint8 if length < 256 else np.int32
        self.counts = np.empty((self.n, _DIMENSIONS), kind)
        step = max(1, (1 << 20) // max(length, _DIMENSIONS))
        for at in range(0, self.n, step):
            some = _DIMENSION[self.letters[at : at + step]]
            some += (np.arange(len(some)) * _DIMENSIONS)[:, None]
            rows = min(step, self.n - at)
            self.counts[at : at + rows] = np.bincount(some.ravel(), minlength=rows * _DIMENSIONS).reshape(rows, -1)

    def half(self, start: int, size: int) -> np.ndarray:
        """A hash of ``size`` letters from ``start``, equal where these are."""
        total = np.zeros(self.n, np.uint64)
        for i in range(size):
            total += self.letters[:, start + i] * _ODD[i % len(_ODD)]
            if i % len(_ODD) == len(_ODD) - 1:
                total *= _ODD[0]
        return total


class Tree:
    """A k-d tree over letter counts. Inner nodes are ``(letter, bound, left, right)``, at most ``bound`` to the left."""

    def __init__(self, counts: np.ndarray, most: float, least: int = 1) -> None:
        self.leaves: list[np.ndarray] = []
        self._counts, self._most, self._least = counts, most, least
        self.root = self._grow(np.arange(len(counts)))
        del self._counts

    def _grow(self, rows: np.ndarray):
        plane = self._plane(rows) if len(rows) > self._most else None
        if plane is None:
            self.leaves.append(rows)
            return len(self.leaves) - 1
        letter, bound = plane
        left = self._counts[rows, letter] <= bound
        return letter, bound, self._grow(rows[left]), self._grow(rows[~left])

    def _plane(self, rows: np.ndarray):
        """A letter whose counts are spread widely, cut near the middle; none where all planes are lopsided."""
        some = self._counts[rows[:: max(1, len(rows) // 4096)]].astype(np.int32)
        middle = np.median(some, axis=0).astype(np.int32)
        planes = []
        for bound in (np.minimum(middle, some.max(axis=0) - 1), middle - 1):
            left = (some <= bound).mean(axis=0)
            planes += zip(np.minimum(left, 1 - left), some.var(axis=0), range(_DIMENSIONS), bound)
        # The widest of the letters that a plane halves well enough, else the plane that halves best.
        even, _, letter, bound = max(planes, key=lambda p: (min(p[0], 0.2), p[1], -p[2]))
        side = int((self._counts[rows, letter] <= bound).sum())
        side = min(side, len(rows) - side)
        return (int(letter), int(bound)) if side >= max(self._least, len(rows) // 50, 1) else None

    def cells(self, counts: np.ndarray) -> np.ndarray:
        """The leaf that each row lies in."""
        out = np.zeros(len(counts), np.int32)
        for leaf, rows in self.reach(counts, up=False, down=False):
            out[rows] = leaf
        return out

    def reach(self, counts: np.ndarray, up: bool, down: bool):
        """``leaf, rows`` for every leaf that the box of some rows meets.

        The box of a row goes one up in one letter where ``up``, and one down in another where ``down``.
        """
        taken = -1 if up else _DIMENSIONS, -1 if down else _DIMENSIONS
        n = len(counts)
        todo = [(self.root, np.arange(n), np.full(n, taken[0], np.int8), np.full(n, taken[1], np.int8))]
        while todo:
            node, rows, above, below = todo.pop()
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                yield node, rows
                continue
            letter, bound, left, right = node
            # Where a letter's change was used up on this very letter, its count is known to be the changed one.
            value = counts[rows, letter].astype(np.int32) + (above == letter) - (below == letter)
            fits, over = value <= bound, value == bound + 1
            # One up on the same letter may not be taken back, nor the other way round.
            descend = over & (below == -1) & (above != letter)
            stay = fits | descend
            todo.append((left, rows[stay], above[stay], np.where(descend, letter, below)[stay].astype(np.int8)))
            climb = (value == bound) & (above == -1) & (below != letter)
            go = ~fits | climb
            todo.append((right, rows[go], np.where(climb, letter, above)[go].astype(np.int8), below[go]))


def _near_pairs(index: Codes, tree: Tree, asked: Codes):
    """Rows of ``asked`` and of ``index`` that are one edit apart, in batches."""
    same = asked.length == index.length
    head = asked.length // 2
    tail = asked.length - head
    heads = asked.half(0, head), index.half(0, head)
    tails = asked.half(head, tail), index.half(index.length - tail, tail)
    step = max(1, (1 << 22) // index.length)
    for leaf, rows in tree.reach(asked.counts, up=True, down=same):
        inside = tree.leaves[leaf]
        block = max(1, (1 << 22) // max(1, len(inside)))
        for at in range(0, len(rows), block):
            some = rows[at : at + block, None]
            a, b = np.nonzero((heads[0][some] == heads[1][inside]) | (tails[0][some] == tails[1][inside]))
            a, b = some[a, 0], inside[b]
            for cut in range(0, len(a), step):
                left, right = a[cut : cut + step], b[cut : cut + step]
                x, y = asked.letters[left], index.letters[right]
                if same:
                    near = (x != y).sum(axis=1) == 1
                else:
                    before, behind = x == y[:, :-1], (x == y[:, 1:])[:, ::-1]
                    prefix = np.where(before.all(axis=1), asked.length, before.argmin(axis=1))
                    suffix = np.where(behind.all(axis=1), asked.length, behind.argmin(axis=1))
                    near = prefix + suffix >= asked.length
                yield left[near], right[near]


class _Best:
    """Number of near words and the best of them, per word."""

    def __init__(self, n: int) -> None:
        self.near = np.zeros(n, np.int64)
        self.best = np.full(n, -1, np.int64)

    def add(self, word: np.ndarray, other: np.ndarray, ranks: np.ndarray) -> None:
        """``ranks`` orders all words, the best first."""
        self.near += np.bincount(word, minlength=len(self.near))
        order = np.lexsort((ranks[other], word))
        word, other = word[order], other[order]
        first = np.append(True, word[1:] != word[:-1]) if len(word) else np.zeros(0, bool)
        word, other = word[first], other[first]
        known = self.best[word]
        better = (known < 0) | (ranks[other] < ranks[np.maximum(known, 0)])
        self.best[word[better]] = other[better]


_STATISTICS = "word string, n_near long, form_n long, form string"


def _search(table: pa.Table) -> pa.Table:
    """Near words within one part: its own words (role 0) against those looked up, as long (1) or one shorter (2)."""
    role = table["role"].to_numpy()
    table = table.take(np.argsort(role, kind="stable"))
    role = np.sort(role)
    texts = [w.encode("latin-1") for w in table["word"].to_pylist()]
    n = table["n"].to_numpy()
    bounds = np.searchsorted(role, [0, 1, 2, 3])
    length = int(table["length"][0].as_py())
    # Words by occurrences, then in the order of their letters; only pairs of different words are near.
    letters = np.empty(len(texts), np.int64)
    letters[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    ranks = np.empty(len(texts), np.int64)
    ranks[np.lexsort((letters, -n))] = np.arange(len(texts))
    best = _Best(len(texts))
    if bounds[1] and bounds[3] > bounds[1]:
        index = Codes(texts[: bounds[1]], length)
        tree = Tree(index.counts, LEAF)
        for kind in (1, 2):
            first, last = bounds[kind], bounds[kind + 1]
            for at in range(first, last, 1 << 16):
                upto = min(last, at + (1 << 16))
                for a, b in _near_pairs(index, tree, Codes(texts[at:upto], length - kind + 1)):
                    best.add(a + at, b, ranks)
                    if kind == 2:
                        best.add(b, a + at, ranks)
    found = np.flatnonzero(best.near)
    forms = best.best[found]
    names = table["word"]
    return pa.table({
        "word": names.take(found), "n_near": best.near[found], "form_n": n[forms], "form": names.take(forms),
    }).cast(pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())]))


class Plan:
    """The upper tree of each length and the parts of each of its cells, from a bounded sample."""

    def __init__(self, sample: list[tuple[str | None, int]], share: float, cell_bytes: int = CELL_BYTES) -> None:
        self._trees: dict[int, Tree] = {}
        self._parts: dict[tuple[int, int], int] = {}
        by_length: dict[int, list[bytes]] = {}
        for word, length in sample:
            if word is not None:
                by_length.setdefault(length, []).append(word.encode("latin-1"))
        for length, words in by_length.items():
            most = cell_bytes * share / length
            tree = Tree(Codes(words, length).counts, most, _LEAST_SAMPLE)
            self._trees[length] = tree
            for cell, rows in enumerate(tree.leaves):
                self._parts[length, cell] = max(1, round(len(rows) / most))
            tree.leaves = []
        long = Counter(length for word, length in sample if word is None)
        self._parts.update({(length, 0): max(1, round(n * length / share / cell_bytes)) for length, n in long.items()})

    def parts(self, length: int, cell: int) -> int:
        return self._parts.get((length, cell), 1)

    def cells(self, codes: Codes, length: int, up: bool, down: bool):
        """``cell, rows`` of the cells among words of ``length`` that the boxes of ``codes`` meet."""
        tree = self._trees.get(length)
        if tree is None:
            return [(0, np.arange(codes.n))]
        return tree.reach(codes.counts, up, down)


_DEALT = "length int, cell int, part int, block int, role int, word string, n long"


def _chunks(batches, least: int = 1 << 15):
    """Batches put together to larger ones."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _dealt(words: DataFrame, plan: Plan) -> DataFrame:
    """Every word where it is indexed (role 0) and where it is looked up (1: as long, 2: one shorter)."""

    def deal(batches):
        for chunk in _chunks(batches):
            texts = [w.encode("latin-1") for w in chunk["word"].to_pylist()]
            lengths = np.array([len(t) for t in texts])
            rows, places = [], []
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                codes = Codes([texts[i] for i in here], length)
                salt = (codes.half(0, length) >> np.uint64(17)).astype(np.int64)
                for role, to in ((0, length), (1, length), (2, length + 1)):
                    for cell, found in plan.cells(codes, to, role > 0, role == 1):
                        parts = plan.parts(to, cell)
                        own = salt[found] % parts
                        for other in range(parts):
                            place = np.empty((len(found), 5), np.int32)
                            place[:, 0], place[:, 1], place[:, 4] = to, cell, role
                            place[:, 2], place[:, 3] = (own, other) if role == 0 else (other, own)
                            rows.append(here[found])
                            places.append(place)
            row, place = np.concatenate(rows), np.concatenate(places)
            for at in range(0, len(row), 1 << 16):
                some = pa.array(row[at : at + (1 << 16)])
                columns = [pa.array(place[at : at + (1 << 16), i]) for i in range(5)]
                columns += [chunk[c].take(some).combine_chunks() for c in ("word", "n")]
                yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "part", "block", "role", "word", "n"])

    return words.mapInArrow(deal, _DEALT)


def near_words(words: DataFrame, sample: int = SAMPLE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``word, n_near, form_n, form`` of each of ``words`` (``word, n``, each word once) that has near words.

    ``form`` is the near word of largest ``n``, of several the first in code-point order.
    """
    total = max(words.count(), 1)
    share = min(1.0, sample / total)
    hashed = F.xxhash64(F.lit(1), "word").cast("double") / 2.0**64 + 0.5
    some = words.filter(hashed < share).select(
        F.when(F.length("word") <= SAMPLED_LENGTH, F.col("word")), F.length("word")
    )
    plan = Plan([tuple(r) for r in some.limit(2 * sample).collect()], share, cell_bytes)
    groups = _dealt(words, plan).groupBy("length", "cell", "part", "block")
    found = groups.applyInArrow(_search, _STATISTICS)
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    )
    return best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def _roots(forms: DataFrame, stage: Stage) -> DataFrame:
    """``form, root`` of every form: forms followed to the last.

    Each step multiplies the occurrences by ``RATIO`` at least, and a round doubles the steps, so there are at
    most five rounds.
    """
    links = forms.filter(F.col("form").isNotNull()).select(F.col("word").alias("at"), F.col("form").alias("next"))
    heads = links.select(F.col("next").alias("form")).distinct()
    first = heads.join(links, F.col("form") == F.col("at"), "left")
    known = stage.save(first.select("form", F.coalesce("next", "form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        onward = known.select(F.col("form").alias("root"), F.col("root").alias("far"))
        step = known.join(onward, "root").select("form", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
        step = stage.save(step, f"roots-{turn}")
        known = step.select("form", "root")
        if step.filter("moved").isEmpty():
            return known


def group_variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``counted`` (``word, n``, each word once).

    Two words are near if they differ by one inserted, deleted or replaced letter. The near word of
    largest ``n`` is the word's form if it occurs at least ``ratio`` times as often, else there is
    none; the root is where following forms ends. Words are of letters a-z and U+00C0 to U+00FF. An
    empty table gives no rows.
    """
    stage = Stage(counted.sparkSession, "spelling")
    counted = stage.save(counted.select("word", "n"), "words")
    near = near_words(counted)
    often = F.col("form_n") >= ratio * F.col("n")
    forms = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"),
    )
    forms = stage.save(forms, "forms")
    found = forms.join(_roots(forms, stage), "form", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`group_variants` over the :func:`words` of ``docs`` (``doc_id, text``)."""
    return group_variants(words(docs))
