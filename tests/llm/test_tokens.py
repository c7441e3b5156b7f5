"""Byte-pair encoding and token files against the tokenizers library."""

import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetable.llm import bpe, token_files
from pagetable.llm.common import Memory

TEXTS = [
    None, "", " ", "  two  spaces ", "the cat's don't'll 12,345.6 ½Ⅷ", "a\n\nb \t c\x85d\xa0e\x1c f",
    "<|endoftext|>x<|endoftext|>", "中文　字 é́ñ 😀‍", "x" * 30000, "ab " * 5000, "the cat's don't'll 12,345.6 ½Ⅷ",
]


@pytest.fixture(scope="module")
def library(vocabulary):
    tool = Tokenizer.from_file(vocabulary)
    return lambda t: tool.encode(t or "", add_special_tokens=False).ids, tool


def test_encode_equals_the_library(library, vocabulary):
    ids_of, tool = library
    known = bpe.vocabulary(vocabulary)
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "'s", "é", "1", "!", "..", "<|endoftext|>", "中", "\x1c", " th", "er", "ing"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(3000)]
    for text in texts:
        packed = known.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids_of(text)
        assert known.decode(packed).decode() == text


def test_every_token_encodes_to_itself_or_as_the_library_does(library, vocabulary):
    known = bpe.vocabulary(vocabulary)
    for token in range(0, 50000, 7):
        data = known.tokens[token]
        found = known.encode_bytes(data)
        assert b"".join(known.tokens[t] for t in found) == data


def test_decode_replaces_what_is_no_text(spark, vocabulary):
    half = bpe.vocabulary(vocabulary).encode("𓀀")[:4]
    rows = spark.createDataFrame([(bytearray(half),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(rows, vocabulary).collect()] == ["�", ""]


def test_digests(spark, documents, with_clashes, library, vocabulary):
    docs = documents(*TEXTS, (None, "x"), (3, "again"))
    for frame in (docs, with_clashes(docs)):
        got = sorted(map(tuple, bpe.digests(frame, vocabulary).collect()), key=repr)
        want = []
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = np.array(library[0](text), "<u4").tobytes()
            want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert bpe.digests(documents(), vocabulary).count() == 0


def test_token_files(spark, documents, with_clashes, library, vocabulary, tmp_path):
    docs = documents(*TEXTS, (None, "y"), (None, "x"), (3, "again")).repartition(3)
    for frame in (docs, with_clashes(docs)):
        got = [tuple(r) for r in token_files.store_and_read(frame, vocabulary).collect()]
        start, want = 0, []
        order = lambda r: (r[0] is not None, r[0], r[1] or "")
        for doc_id, text in sorted(docs.select("doc_id", "text").collect(), key=order):
            ids = np.array([*library[0](text), 0], "<u4")
            want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.store_and_read(documents(), vocabulary).count() == 0


def test_files_give_sequences_without_a_copy(documents, library, vocabulary, tmp_path):
    docs = documents(*["word " * n for n in (10, 700, 3000)])
    files = token_files.write(docs, vocabulary, str(tmp_path / "t"), sequence=64).orderBy("start").collect()
    stream, shown = [], []
    for f in files:
        file = token_files.TokenFile(f.file)
        n = -(-f.n_tokens // 64)
        for i in range(n):
            view = file.ids(i)
            assert view.base is not None and not view.flags.owndata and len(view) == 64
            shown += file.mask(i).tolist()
            stream += view[file.mask(i)].tolist()
    want = [x for (t,) in docs.select("text").collect() for x in [*library[0](t), 0]]
    assert stream == want and sum(shown) == len(want)
    assert pa.types.is_fixed_size_list(token_files.file_schema(pa.uint16()).field("ids").type)
    assert docs.filter(F.lit(False)).count() == 0


def test_texts_are_cut_as_the_library_splits_them(library, vocabulary):
    rng = random.Random(4)
    parts = [*"\t\n\v\f\r \x85\xa0\u1680\u180e\u2003\u2028\u3000\x1c\x00\ufeff", *" \n" * 20, *"abTsR019.,;!'-", "é", "×", "’", "日", "\u0301", "'ll", "ab"]
    texts = ["", " ", "\n", "a", *["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)], "so <|endoftext|> it"]
    encoder = token_files._Encoder(vocabulary)
    for some in (pa.array(texts), pa.array(["　", *texts]).slice(1), pa.array(texts, pa.large_string()), pa.array([""]), pa.array([], pa.string())):
        ids, sizes = encoder.encode(some)
        want = [library[0](t) for t in some.to_pylist()]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_known_words_cost_no_call_each(library, vocabulary):
    words = ["w" + chr(97 + i % 26) * (i // 26 + 1) for i in range(2000)]
    encoder, text = token_files._Encoder(vocabulary), ", ".join(words) + "."
    encoder.encode(pa.array([" ".join(words), "x, y."]))
    calls, texts = Counter(), pa.array([text, text])
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        ids, _ = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert ids.tolist() == 2 * library[0](text)
    assert calls["call"] < 200


def test_memories_are_not_compared_by_what_they_hold():
    some, other = Memory(), Memory()
    some.keep("a", 1, 1)
    other.keep("a", 1, 1)
    assert some == some and some != other and len({some, other}) == 2
