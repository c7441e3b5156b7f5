"""Words and their variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagetable.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, out = {}, []
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out.append((w, n, len(others)))
    rows = []
    for w, n, n_near in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, words.get(forms[w])))
    return sorted(rows, key=repr)


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows), key=repr)


def words_like(rng, n):
    """Words in families: a few letters, some accented, each changed by up to two edits."""
    out = []
    while len(out) < n:
        base = "".join(rng.choices("abcdeéÿz", k=rng.randint(7, 10)))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choices("abcdeéÿz", k=rng.randint(0, 1))
            if len(w) >= 7:
                out.append("".join(w))
    return out


def test_whole_query_equals_brute_force(spark, documents, with_clashes):
    rng = random.Random(3)
    vocabulary = sorted(set(words_like(rng, 400)))
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in vocabulary]
    rows = [(i % 5 if i % 7 else None, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 400)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "Bcdabcd, BCDABCD1bcdabcd-ÀCDABCD×"), (73, "x" * 5000 + " " + "x" * 5001), (73, "x" * 5000)]
    rows += [(74, ("a" * 300 + " ") * 2 + ("a" * 299 + "b ") * 3 + ("a" * 150 + "b" + "a" * 150 + " ") * 40)] * 2
    docs = documents(*rows)
    want = variants(counted(rows))
    assert got(S.spelling_variants(with_clashes(docs))) == want
    assert sum(r[1] is not None for r in want) > 10


@pytest.mark.parametrize("sample, cell_bytes", [(1 << 16, 4000), (700, 9000), (1, 1 << 19), (1 << 16, 300)])
def test_many_cells_and_parts_lose_nothing(spark, sample, cell_bytes):
    rng = random.Random(8)
    words = {w: rng.randint(2, 500) for w in words_like(rng, 2500)}
    # Many words with the same letters, which no plane tells apart.
    for _ in range(600):
        words["".join(rng.sample("abcdefg", 7))] = rng.randint(2, 9)
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: (r.n_near, r.form_n, r.form) for r in S.near_words(rows, sample, cell_bytes).collect()}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    want = {}
    for w in words:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            want[w] = (len(others), words[best], best)
    assert found == want


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefg", "abcdefh", "abcdeih", "abcdjih", "abckjih", "ablkjih"]
    rows = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    found = {r.word: r for r in S.group_variants(rows).collect()}
    assert all(found[w].root == chain[-1] for w in chain)
    assert [found[w].form for w in chain] == chain[1:] + [None]
    assert found[chain[1]].n_near == 2


def test_no_words(spark, documents):
    assert S.spelling_variants(documents(None, "", "short words only")).collect() == []
    assert S.spelling_variants(documents("x").limit(0)).collect() == []
