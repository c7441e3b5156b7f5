"""Collocations against brute force, with hot phrases, small chunks and small buckets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetable.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=100, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, a in found.items():
            for m in range(2, len(q)):
                inside |= {p for i in range(len(q) - m + 1) if found[p := q[i : i + m]] <= a}
        scored = []
        for p, a in found.items():
            if p in inside:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_like(rng, n):
    words = ["the", "of", "Un", "deux", "é", "a\x00b", "x\x0bq", "in", "spite", "new", "york", "city", "STAND", "-"]
    fixed = ["in spite of the", "new york city", "hot line stands here again", "hot line stands alone"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) if rng.random() < 0.9 else f"r{rng.randrange(10**6)}")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]))
        out.append(("".join(parts), rng.choice(["en", "en", "en", None, "fr", "x y"])))
    return out


ROWS = rows_like(random.Random(4), 400) + [
    (None, "en"), ("", None), (" \t. ,", "en"), ("solo", "only"), ("a b " * 60000, "long"), ("same line. " * 500, "en"),
    ("ab", "en"), ("cd ef", "fr"),
]


@pytest.mark.parametrize("common", [C.COMMON, 5])
@pytest.mark.parametrize("settings", [{}, {"hot": 3, "chunk_bytes": 20000, "bucket": 300}, {"hot": 40, "chunk_bytes": 5000}])
def test_equals_brute_force(spark, monkeypatch, settings, common):
    monkeypatch.setattr(C, "COMMON", common)
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in ROWS], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(map(tuple, C.collocations(docs, **settings).collect()))
    want = brute(ROWS)
    assert got == want and len({r[0] for r in want}) > 3 and any(len(r[2].split()) == 5 for r in want)


def test_least_and_top(spark):
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    got = sorted(map(tuple, C.collocations(docs, least=7, longest=4, top=5).collect()))
    assert got == brute(ROWS, 7, 4, 5)


def test_products_beyond_64_bits(spark):
    counts = {"p": 10**13 + 7, "q": 10**13 + 9, "s": 3 * 10**12, "p q": 10**13 + 3, "q s": 10**12 + 1, "p q s": 10**12}
    n = 10**14 + 1
    found = spark.createDataFrame([("en", p, a) for p, a in counts.items()], "lang string, phrase string, n long")
    got = C.rank_phrases(found, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    want = {
        "p q": 1000 * counts["p q"] * n // (counts["p"] * counts["q"]),
        "q s": 1000 * counts["q s"] * n // (counts["q"] * counts["s"]),
        "p q s": 1000 * 10**12 * n // (counts["p q"] * counts["s"]),
    }
    assert {r.phrase: r.score for r in got} == want


def test_no_phrases(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("a b c", "en")], "text string, lang string")
    assert C.collocations(docs).collect() == [] and C.collocations(docs.limit(0)).collect() == []


def test_prefix_counts():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 6, 3000)
    at = np.arange(3000)
    end = np.minimum(at + rng.integers(0, 7, 3000), 3000)
    want = Counter(tuple(codes[a : a + d]) for a, e in zip(at, end) for d in range(1, min(5, e - a) + 1))
    got = {tuple(codes[p : p + d]): n for d, p, n in C.equal_prefixes(codes, at, end, 4)}
    assert got == {p: n for p, n in want.items() if n >= 4}
