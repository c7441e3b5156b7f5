"""Near duplicates and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetable.llm import dart_minhash as M
from pagetable.llm import recompress as R

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def edited(text, n):
    words = text.split()
    for i in RNG.sample(range(len(words)), n):
        words[i] = "new" + str(RNG.randint(0, 10**6))
    return " ".join(words)


BASE = prose(200)
LONG = prose(15000)
TEXTS = [
    None, "", " \t ", "one two", "one two", "one two three", BASE, BASE, edited(BASE, 2), edited(BASE, 40),
    BASE.upper(), BASE.replace(" ", "\n"), LONG, edited(LONG, 20), "spam " * 300, "spam " * 310,
    prose(100) + " " + BASE[:400], *[edited(BASE, 3) for _ in range(40)],
    *[prose(80) + " " + BASE + " " + prose(80) for _ in range(5)],
]


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < 5:
        return collections.Counter([tuple(words)] if words else [])
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(rows):
    """Least id of each row's component, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            total = sum((sets[i] | sets[j]).values())
            if (total and shared >= 0.8 * total) or (rows[i][1] or "") == (rows[j][1] or ""):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    members = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in members.items()}
    return [least[find(i)] for i in range(len(rows))]


def test_near_duplicates_equal_brute_force(documents, with_clashes):
    docs = documents(*TEXTS, (None, BASE), (None, "alone and without a number here"), (6, BASE))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, c) for (d, _), c in zip(rows, classes(rows))), key=repr)
    got = M.near_duplicates(with_clashes(docs)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want
    kept = M.representatives(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=repr) == sorted({c for _, c in want}, key=repr)
    assert M.near_duplicates(documents()).count() == 0
    assert M.representatives(documents()).count() == 0


def test_large_mixed_buckets_are_compared_in_blocks(documents, monkeypatch):
    """Copies that are far from each other, in buckets over every bound."""
    monkeypatch.setattr(M, "PAIRED", 2)
    monkeypatch.setattr(M, "BLOCK", 8)
    base = prose(120)
    docs = documents(*[edited(base, n % 12) for n in range(60)], prose(50))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()}
    assert [got[d] for d, _ in rows] == classes(rows)


def test_columns_hold_nothing_that_depends_on_the_hub(documents):
    """Links are compared as far as classes need, so none are counted."""
    base = prose(200)
    docs = documents(*[edited(base, 2) for _ in range(6)])
    got = M.near_duplicates(docs)
    assert got.columns == ["doc_id", "class_id", "keep"]
    assert sorted(map(tuple, got.collect())) == [(i, 0, i == 0) for i in range(6)]


def test_sketches_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    a = {int(x): int(rng.integers(1, 9)) for x in rng.integers(0, 2**62, 300)}
    b = {k: max(1, v - k % 3) for k, v in a.items() if k % 5}
    shared = sum(min(v, b.get(k, 0)) for k, v in a.items())
    weighted = shared / (sum(a.values()) + sum(b.values()) - shared)
    items = np.array([*a, *b], np.uint64)
    weights = np.array([*a.values(), *b.values()])
    row = np.repeat([0, 1], [len(a), len(b)])
    s = M.sketches(items, weights, row, 2, 4000)
    assert abs((s[0] == s[1]).mean() - weighted) < 0.03
    assert (M.sketches(items[row == 0], weights[row == 0], row[row == 0], 1, 4000)[0] == s[0]).all()


def without_repeats(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, []
    for doc_id, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - 19):
            seen.setdefault(tuple(words[i : i + 20]), (doc_id, i))
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - 19):
            if seen[tuple(words[i : i + 20])] != (doc_id, i):
                gone.update(range(i, i + 20))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_batch", ["1", "7", "512"])
def test_repeats_equal_brute_force(spark, documents, with_clashes, per_batch):
    passage = prose(60)
    texts = [
        *TEXTS, "tick tock " * 60, "tick tock " * 45 + "tick", passage + " " + passage, " ".join(passage.split()[3:30]),
        prose(19), prose(20), *[prose(30) + " " + passage + "\n" + prose(30) for _ in range(12)],
        " ".join(passage.split()[:20]), "a b " + " ".join(passage.split()[11:45]) + " c d", (None, passage), (7, BASE),
    ]
    docs = documents(*texts).repartition(3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = sorted(map(tuple, R.digests(with_clashes(docs)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == without_repeats(rows)
    assert R.digests(docs.filter(F.lit(False))).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    inside = rng.integers(0, 40, 60).astype(np.uint64)
    texts = [np.concatenate([rng.integers(0, 40, n).astype(np.uint64), inside, rng.integers(0, 40, n).astype(np.uint64)]) for n in (0, 3, 17)]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    anchor, _, row, start, count = R.groups(np.concatenate(texts), offsets)
    found = {}
    for a, r, s, n in zip(anchor, row, start, count):
        for i in range(s, s + n):
            window = tuple(texts[r][i : i + 20])
            assert found.setdefault(window, a) == a
    assert len(found) <= sum(len(t) - 19 for t in texts) - 2 * 41  # the passage's windows, once each


def test_rows_of_one_id_whose_short_hashes_are_equal(spark, documents):
    """Texts that any 32-bit hash takes for one another are still told apart: the counts of both are their own."""
    passage = prose(30)
    lines = [f"{passage} {prose(31)} x{i}" if i % 2 else f"{prose(61)} y{i}" for i in range(60000)]
    lines += [f"short z{i}" for i in range(60000)]
    table = spark.createDataFrame(list(enumerate(lines)), "i int, text string")
    clashing = table.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").collect()
    pairs = [t for r in clashing for t in r.t]
    assert pairs
    for owner in (None, 5):
        rows = [(owner, t) for t in pairs] + [(None if owner is None else 1, passage + " and more")] * 2
        got = sorted(map(tuple, R.digests(documents(*rows)).collect()), key=repr)
        assert got == without_repeats(rows)
