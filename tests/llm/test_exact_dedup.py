"""Exact copies against brute force, with and without collisions of the hash."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagetable.llm import exact_dedup as E

ROWS = [
    (3, "a b"), (1, "a  b"), (2, "a\t\nb"), (4, "a b "), (5, " a b"), (6, "a b"), (7, "A b"), (8, None), (9, ""),
    (None, "a b"), (None, "only without id"), (None, "only without id"), (10, "twice"), (10, "twice"), (10, "twice "),
    (11, "long " * 100000), (12, "long " * 100000), (13, "long " * 99999), (14, " "), (15, "\r\f\x0b"), (16, "a\x00b"),
    *[(100 + i, "hot") for i in range(200)], *[(400 + i, f"alone {i}") for i in range(50)],
]


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out, seen = [], set()
    for (doc_id, _), t in zip(rows, norm):
        ids = [i for (i, _), u in zip(rows, norm) if u == t]
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        kept = doc_id == keep and t not in seen
        if kept:
            seen.add(t)
        out.append((doc_id, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_equals_brute_force(documents, with_clashes):
    rows = random.Random(1).sample(ROWS, len(ROWS))
    assert got(E.exact_copies(with_clashes(documents(*rows)))) == brute(rows)


@pytest.mark.parametrize("values", [1, 5])
def test_bytes_tell_texts_of_one_hash_apart(documents, values):
    decided = E.decide(documents(*ROWS), ["doc_id"], lambda t: F.pmod(F.xxhash64(t), F.lit(values)).cast("string").cast("binary"))
    assert got(decided.select("record.doc_id", "*")) == brute(ROWS)


def test_rows_that_stay_are_whole(documents, with_clashes):
    docs = with_clashes(documents(*ROWS))
    assert {"record", "mark", "row", "norm"} <= set(docs.columns)
    kept = E.without_copies(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == sum(r[3] for r in brute(ROWS))


def test_empty_table(documents):
    assert got(E.exact_copies(documents("x").limit(0))) == []
