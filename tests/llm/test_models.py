"""Toxicity, language, personal data, licenses, decontamination and neighbours."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pagetable.llm import decontaminate, hnsw, langid, licenses, pii, toxicity

RNG = random.Random(9)


def prose(n, letters="abcdefghij"):
    return " ".join("".join(RNG.choices(letters, k=RNG.randint(2, 7))) for _ in range(n))


# --- Toxicity -----------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark, documents, with_clashes):
    bad = ["vilest", "vilely", "scumbag"]
    texts, toxic = [], []
    for i in range(240):
        words = prose(60).split()
        for _ in range((i % 3) * 3):
            words[RNG.randrange(60)] = RNG.choice(bad)
        toxic.append(int(any(w in bad for w in words)))
        texts.append(" ".join(words))
    docs = documents(*texts, None, "", "vilest " * 5000)
    labels = spark.createDataFrame(
        [(i, i % 2, t) for i, t in enumerate(toxic) if i % 4] + [(None, 1, 1), (3, None, None), (9999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(with_clashes(docs), model).collect()}
    held_out = [i for i in range(240) if i % 4 == 0]
    assert sum(got[i].toxic == bool(toxic[i]) for i in held_out) >= 0.95 * len(held_out)
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())
    assert not got[240].toxic and not got[241].toxic and got[242].toxic
    assert list(model.thresholds) == sorted(model.thresholds)
    assert toxicity.grade_documents(documents(), labels).count() == 0
    clean_only = toxicity.grade_documents(docs, labels.filter("toxic = 0"))
    assert clean_only.filter("toxic OR severity != 0").count() == 0


def test_ordinal_fit_finds_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    grades = np.searchsorted([-1.5, 0.5, 2.5], score)
    w, cuts = toxicity.fit_ordinal(x, grades, np.ones(2000), decay=0)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(cuts, [-1.5, 0.5, 2.5], atol=0.25)


# --- Languages ----------------------------------------------------------------------------


def test_languages_on_held_out_texts(spark, documents, with_clashes):
    lexicons = {"aa": prose(60, "abcdefg"), "bb": prose(60, "aehijklmn"), "cc": prose(60, "aeéàüñöß")}
    rows = []
    for i in range(300):
        lang = list(lexicons)[i % 3]
        rows.append((i, " ".join(RNG.choices(lexicons[lang].split(), k=30)), lang))
    rows += [(300, None, "aa"), (301, "12 !? 34", "aa"), (302, "", None), (None, lexicons["aa"], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict_languages(with_clashes(docs)).collect()
    truth = {i: lang for i, _, lang in rows}
    tested = [r for r in got if r.held_out and r.doc_id < 300]
    assert tested and all(r.lang_pred == truth[r.doc_id] for r in tested)
    assert {r.lang_pred for r in got if r.doc_id in (300, 301, 302)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert langid.predict_languages(docs.filter("false")).count() == 0
    nothing = langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


# --- Personal data ------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return (sum(each[::2]) + sum(sum(divmod(2 * d, 10)) for d in each[1::2])) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return [
        f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])
    ]


PII_TEXTS = [
    None, "", "a@b.c@d.e x@y@z.com _a@b.c_d@e.f a@b a@b. a.@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111x 4111111111111112", "+1 (234) 555-0199. +1+23456789 + 123 +12345678",
    "é😀 a@b.co 😀 +49 30 1234567", "1" * 30000, "a" * 30000 + "@", "1.1." * 5000, "x@y.zz " * 300, "1 2-3" * 40,
]


def test_base_spans_equal_plain_patterns(documents, with_clashes):
    rng = random.Random(4)
    soup = ["".join(rng.choices("a@.-+ (1)0429é", k=rng.randint(0, 60))) for _ in range(300)]
    docs = documents(*PII_TEXTS, *soup, (None, "x@y.zz"), (6, "again a@b.co"))
    texts = [r.text or "" for r in docs.select("text").collect()]
    none = pii.Trees((), (), (2.0, 2.0, 2.0))
    rows = pii.find(with_clashes(docs), none).collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        want = base_spans(text)
        assert row.spans == ",".join(want)
        assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(w.startswith(k + ":") for w in want) for k in PLAIN
        ]
    assert pii.find(documents()).count() == 0


def test_candidates_add_secrets_and_redaction_keeps_columns(documents, with_clashes):
    secret = lambda: "".join(RNG.choices("0123456789abcdef", k=40))
    texts = [f'{prose(20)} token = "{secret()}" {prose(5)} {"q" * 20}' for _ in range(120)]
    docs = documents(*texts, None, "mail a@b.co, then a@b.co.", "")
    trees = pii.fit(docs)
    rows = pii.find(docs, trees).collect()
    assert sum("secret" in r.spans for r in rows[:120]) >= 110
    clean = pii.redact(with_clashes(docs), trees)
    assert clean.columns == with_clashes(docs).columns
    got = [r.text for r in clean.collect()]
    assert all('token = "[SECRET]"' in t and t.endswith("q" * 20) for t in got[:120] if "SECRET" in t)
    assert got[120:] == [None, "mail [EMAIL], then [EMAIL].", ""]


def test_cued_phones_accounts_and_contacts_are_taken(documents):
    cued = [
        "tel. (555) 123-4567", "Phone number: 555-0199-123", "ssn 078-05-1120", "account no. 12345678",
        "call me at 555 867 5309", "mail: jo@localhost", "fax (020) - 7946 0958",
    ]
    plain = ["hotel 5551234567", "in 1234567 cases", "x@y stays"]
    docs = documents(*[f"{prose(5)} {x} {prose(5)}" for x in cued + plain])
    want = ["(555) 123-4567", "555-0199-123", "078-05-1120", "12345678", "555 867 5309", "jo@localhost", "(020) - 7946 0958"]
    none = pii.Trees((), (), (2.0, 2.0, 2.0))
    for row, x in zip(pii.redact(docs, none).orderBy("doc_id").collect(), cued + plain):
        found = [w for w in want if w in x]
        kind = "[CONTACT]" if "@" in x else "[NUMBER]"
        assert (x.replace(found[0], kind) if found else x) in row.text


def test_formats_are_learned_from_cues(documents):
    number = lambda: f"({RNG.randint(200, 999)}) {RNG.randint(200, 999)}-{RNG.randint(1000, 9999)}"
    texts = [f"{prose(5)} tel {number()} {prose(3)} {RNG.randint(10**7, 10**8 - 1)} {prose(3)}" for _ in range(200)]
    trees = pii.fit(documents(*texts))
    got = pii.find(documents(f"home {number()} or 87654321 then"), trees).collect()[0]
    assert got.spans == "number:5:19"


def test_trees_are_fitted_to_all_documents(spark, documents):
    number = lambda: f"({RNG.randint(200, 999)}) {RNG.randint(200, 999)}-{RNG.randint(1000, 9999)}"
    texts = [f"{prose(3)} {'tel' if i % 4 else 'room'} {number()} {prose(3)} {10**8 + i} {prose(3)}" for i in range(120)]
    docs = documents(*texts)
    plain = spark.range(80_000).select(F.concat(F.lit("no candidate x"), "id").alias("text"))
    trees = pii.fit(docs)
    assert trees.leaves and pii.fit(docs.select("text").union(plain)) == trees


# --- Licenses -----------------------------------------------------------------------------


def test_license_places(documents, with_clashes):
    texts = [
        None, "", "Under the MIT License. under the  mit-license under the mit", "APACHE LICENSE, VERSION 2.0",
        "CC BY-NC 4.0 cc by nc", "under under the mit license license", "é under thé mit license", "mit " * 20000,
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "x " * 9 + "cc-by-sa",
        "permission is hereby granted free of charge to any person obtaining a copy. The software is provided as is",
    ]
    docs = documents(*texts, (None, "cc by nc"))
    rows = [r for r in licenses.scan(with_clashes(docs)).collect()]
    base = {t.label: t.passage.split() for t in licenses.BASE}
    for row, text in zip(rows, [*texts, "cc by nc"]):
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, k) for i in range(len(words)) for k, p in base.items() if words[i : i + len(p)] == p]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        starts = [i for i, _ in places]
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({k for _, k in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1
    assert [r.labels for r in rows[8:11]] == ["", "cc-by-sa", "mit"]
    assert licenses.scan(documents()).count() == 0


# --- Decontamination ----------------------------------------------------------------------


def test_templates_find_copies_with_other_numbers_and_names(spark, documents, with_clashes):
    item = "A train leaves Boston at 60 km per hour and arrives in Denver after 14 hours of travel so how far is it"
    changed = item.replace("Boston", "Lisbon").replace("Denver", "Madrid").replace("60", "75").replace("14", "9")
    mixed = changed.replace("Madrid", "Lisbon")
    other = prose(40)
    benchmark = spark.createDataFrame(
        [(1, item), (2, other), (3, None), (4, "too short"), (5, ""), (1, item)], "item_id long, text string"
    )
    docs = documents(
        prose(30) + ". " + item + " " + prose(30), "so " + changed, "so " + mixed, None, "", prose(500),
        " ".join(other.split()[:9]), other.upper(), item + "\n" + changed, (None, item), (0, prose(9)),
    )
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(with_clashes(docs), with_clashes(benchmark)).collect()}
    assert set(got) == {(0, 1), (1, 1), (7, 2), (8, 1), (None, 1)}
    assert got[1, 1].reparameterised and not got[0, 1].reparameterised and not got[8, 1].reparameterised
    kept = decontaminate.clean(with_clashes(docs), benchmark)
    assert kept.columns == with_clashes(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.matches(docs, benchmark.filter("false")).count() == 0
    assert decontaminate.matches(documents(), benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.filter("false")).count() == docs.count()


def leaks(spark, documents, items, *texts):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.matches(documents(*texts), benchmark).collect()}


def test_copies_are_found_in_other_places_and_other_case(spark, documents):
    short = "What is the boiling point of water"
    apples = "Tom has 5 apples. Ann has 3 more apples than Tom. How many apples does Ann have"
    renamed = apples.replace("Tom", "Sue").replace("Ann", "Bob").replace("5", "8").replace("3", "4")
    tea = "the tea that was thrown into the harbour of Boston came from China by ship"
    got = leaks(
        spark, documents, [short, apples, tea], "Q: " + short, "they ask, " + short.lower() + "?", short.upper(),
        "Q: " + renamed, renamed, apples.upper(), apples.lower(), tea.lower(), tea.title(), "Water is What a point is",
    )
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (8, 2)}
    assert {k for k, r in got.items() if r.reparameterised} == {(3, 1), (4, 1)}


def test_a_conflict_of_slots_drops_no_more_than_its_windows(spark, documents):
    start, end = prose(30), prose(30)
    item = f"{start} and 5 of them {end} but 5 stay"
    sums = "if you have 3 red balls and then find 5 blue balls how many balls are in the bag"
    got = leaks(
        spark, documents, [item, sums], item[:-6] + "6 stay", sums.replace("3", "5"), item,
        f"{start} and 7 of them {end} but 6 stay", sums.replace("3", "9").replace("5", "4"),
    )
    assert set(got) == {(0, 0), (1, 1), (2, 0), (3, 0), (4, 1)}
    assert got[3, 0].longest >= 60 and got[0, 0].longest >= 60 and got[2, 0].coverage == 1
    assert got[1, 1].reparameterised and got[4, 1].reparameterised and not got[2, 0].reparameterised


def test_items_of_few_words_or_many_placeholders_are_found_as_they_stand(spark, documents):
    items = [
        "Compute 12 + 7 - 3 + 45 + 6", "War And Peace By Leo Tolstoy", "Zanzibar", "name three colours",
        "Jan 12 30 Feb 14 28 Mar 15 31 Apr 18 30 May 21 31 Jun 24 30",
    ]
    got = leaks(
        spark, documents, items, *[f"{prose(8)}, {x} {prose(8)}" for x in items], items[0].replace("12", "13"),
        "War and peace by Leo Tolstoy", "zanzibar, ZANZIBAR", "name four colours", items[4].replace("1", "2"),
    )
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (7, 2)}


def test_texts_without_an_id_or_under_one_are_judged_alone(spark, documents):
    item, other = prose(8) + " " + prose(8), "Tom gave 4 pears to Ann on the way to town this morning"
    tale = other.replace("Tom", "Sue")
    benchmark = spark.createDataFrame([(1, item), (1, other)], "item_id long, text string")
    docs = documents(
        (None, item), (None, prose(30)), (None, None), (None, item), (None, "so " + tale),
        *[(3, tale.replace("Ann", n).replace("4", str(len(n)))) for n in ("Bob", "Eve", "Max", "Philip")], (4, prose(20)),
    )
    got = decontaminate.matches(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 13), (0, 16), (3, 13), (3, 13), (3, 13), (3, 13)]
    kept = decontaminate.clean(docs, benchmark).select("doc_id", "text").collect()
    texts = [r.text for r in docs.collect()]
    assert sorted(kept, key=repr) == sorted([(None, texts[1]), (None, None), (4, texts[-1])], key=repr)


def test_words_of_a_text_cost_no_call_each():
    def plain(text):
        """Words, kinds, and whether they open a sentence, one token after the other."""
        out, before = [], decontaminate.STOP
        for t in regex.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]", text):
            if t in ".!?\n":
                kind = decontaminate.STOP
            elif t[0].isdigit():
                kind = decontaminate.NUMBER
            elif t.lower() in decontaminate.UNITS:
                kind = decontaminate.UNIT if before == decontaminate.NUMBER else decontaminate.LITERAL
            else:
                kind = decontaminate.NAME if len(t) > 1 and t[0].isupper() and t[1:].islower() else decontaminate.LITERAL
            if kind != decontaminate.STOP:
                out.append((t.lower(), kind, before == decontaminate.STOP))
            before = kind
        return out

    texts = [
        "", "It took 3.5 km, 1,000.5 Hours or 2. days. Hours! km", "1..2 .5 5. 1.,2 a1.5b ٣,٤ x²y ①", "\0A\0", "ǅabc İstanbul ΟΔΟΣ ΟΔΟς σΣ 5 K 5 \u212a",
        "d'Été_Tom's ELLE Mc McAdam ßA 日本\u0301語\nª", "A" * 70000 + " " + "é" * 70000, " 12 kg", "kg.Tom",
    ]
    spelled, kinds, hashes, opens, offsets = decontaminate.canonical(texts)
    want = [plain(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in want]
    words = spelled(0, len(kinds))
    assert list(zip(words, kinds.tolist(), opens.tolist())) == [w for ws in want for w in ws]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))

    calls, text = Counter(), " ".join("w" + chr(97 + i % 26) * (i // 26 + 1) for i in range(2000))
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        decontaminate.canonical([text])
    finally:
        sys.setprofile(None)
    assert calls["call"] < 200


# --- Neighbours ---------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [128, 4096])
def test_neighbours_against_brute_force(spark, with_clashes, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 2
    vectors = [(i, (centres[i % 8] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(900)]
    vectors += [(i, vectors[0][1]) for i in range(900, 1000)]  # one vector a hundred times
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [float("inf")] + [1.0] * 15),
           (2400, [None] + [1.0] * 15), (2500, []), (None, vectors[1][1]), (2600, [1.0, 2.0]), (5, vectors[5][1])]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(with_clashes(rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    matrix = np.array([v for _, v in vectors], float)
    found = 0
    for q in range(0, 1000, 100):
        far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
        want = sorted((d, i) for i, d in enumerate(far) if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(d - far[v]) < 1e-12 for _, d, v in mine)
        assert [(d, v) for _, d, v in mine] == sorted((d, v) for _, d, v in mine)
        found += len({v for _, v in want} & {v for _, _, v in mine})
    assert set(got) == set(range(0, 1000, 100)) and found >= 95
    assert hnsw.nearest(rows.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
