"""Exact byte-pair encoding in linear time, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token that starts at each byte.
The encoder walks left to right, taking the longest token that may stand next to the one before
it; where none may, it takes the last token back and tries that one's next shorter prefix token.
Two tokens may stand side by side when byte-pair merging of their joined bytes would give just
these two, which follows from the merge table alone. Each position is given up at most once, so the
work is linear in the text however long its runs are.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from pagetable.llm.common import MEMORY_BYTES, Memory, sole

# The white space of the byte-level split, and the split itself.
SPACES = "\t\n\v\f\r \x85\xa0  -     　"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MARKS = frozenset(".,;:!?")
_ODD = frozenset("\x1c\x1d\x1e\x1f") | {c for c in map(chr, range(0x3001)) if c.isspace()}
_SURE_CUT = regex.compile(r"(?<=[^{0}]) (?=[^{0}])".format("".join(sorted(_ODD))))
PIECES = regex.compile(SPLIT.replace(r"\s\p", rf"{SPACES}\p").replace(r"\S", rf"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))


def byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file: merges, added tokens, automaton and offset table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids, merges = byte_of_letter(), spec["model"]["vocab"], spec["model"]["merges"]
        raw = {t: bytes(letters[c] for c in t) for t in ids}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*ids.values(), *self.added.values()]) + 1
        self.tokens = [b""] * n
        for t, i in ids.items():
            self.tokens[i] = raw[t]
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        self.offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        # Rank of a token: the number of the merge that makes it; single bytes come before all.
        self._rank = [-1] * n
        self._halves: list[tuple[int, int] | None] = [None] * n
        self._joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self._joined[pair] = whole
            if self._halves[whole] is None:
                self._halves[whole], self._rank[whole] = pair, rank
        self._tree = ahocorasick.Automaton()
        for i in ids.values():
            self._tree.add_word(self.tokens[i].decode("latin-1"), i)
        self._tree.make_automaton()
        by_bytes = {b: i for i, b in enumerate(self.tokens) if i not in self.added.values()}
        self._shorter = [
            next((by_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in by_bytes), -1)
            for b in self.tokens
        ]
        self._beside = Memory()
        self._pieces = Memory(MEMORY_BYTES // 4)
        self._units = Memory(2 * MEMORY_BYTES)
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")

    def awake(self) -> Vocabulary:
        """To be called by a task: what other operators remembered in this worker goes."""
        sole("encoding", self._beside, self._pieces, self._units)
        return self

    def may_adjoin(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly these two tokens.

        Undoes merges from the latest on the side of the seam it lies. Had the two parts that then
        face each other a merge of their own that comes first, merging would have crossed the seam.
        """
        known = self._beside.get((left, right))
        if known is not None:
            return known
        key, rank, limit = (left, right), self._rank, len(self._rank) + 1
        answer = True
        while True:
            whole = self._joined.get((left, right))
            if whole is not None and rank[whole] < limit:
                answer = False
                break
            # Among equal ranks (the same token on both sides) the left one is merged first.
            if rank[left] > rank[right]:
                limit = rank[left]
                left = self._halves[left][1]
            elif rank[right] >= 0:
                limit = rank[right] + 1
                right = self._halves[right][0]
            else:
                break
        self._beside.keep(key, answer, 0)
        return answer

    def encode_bytes(self, data: bytes) -> list[int]:
        """Token ids of bytes that are one piece."""
        n, shown, search = len(data), data.decode("latin-1"), self._tree.iter_long
        tokens, shorter, beside = self.tokens, self._shorter, self._beside
        greedy = [token for _, token in search(shown)]
        fits = 1
        for pair in zip(greedy, greedy[1:]):
            if not (beside[pair] if pair in beside else self.may_adjoin(*pair)):
                break
            fits += 1
        if fits >= len(greedy):
            return greedy
        # The walk begins like the search; it leaves it at the first two that may not adjoin.
        found, token = greedy[:fits], greedy[fits]
        at = sum(len(tokens[t]) for t in found)
        longest = [-1] * n  # found where the walk comes by; every byte is a token
        open_ = bytearray(b"\1") * (n + 1)
        while token >= 0:
            end = at + len(tokens[token])
            if open_[end] and (
                not found
                or (beside[pair] if (pair := (found[-1], token)) in beside else self.may_adjoin(*pair))
            ):
                found.append(token)
                at, token = end, -1
                if end < n:
                    token = longest[end]
                    if token < 0:
                        token = longest[end] = next(search(shown, end))[1]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = found.pop()
                at -= len(tokens[token])
        return found

    def _packed(self, piece: str) -> bytes:
        return array("I", self.encode_bytes(piece.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self._pieces
        ids = known.get(piece)
        if ids is None:
            ids = self._packed(piece)
            known.keep(piece, ids, 2 * len(piece) + len(ids))
        return ids

    def _split(self, part: str) -> bytes:
        return b"".join(map(self._piece, PIECES.findall(part)))

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit and the space before it. Words with at most a mark behind, which are most
        units, need no regular expression."""
        if unit.isalpha():
            return self._packed(" " + unit)
        word, mark = unit[:-1], unit[-1:]
        if mark in _MARKS and word.isalpha():
            return (self._units.get(word) or self._packed(" " + word)) + self._piece(mark)
        return self._split(" " + unit)

    def _learn(self, unit: str) -> bytes:
        ids = self._unit(unit)
        self._units.keep(unit, ids, 2 * len(unit) + len(ids))
        return ids

    def _plain(self, text: str) -> list[bytes]:
        """Ids of the parts of a text without added tokens.

        A single space between two characters that are no white space always starts a piece. Where
        the text has only such spaces it is cut at each of them; a part that white space begins or
        ends, never known, tells where it has others.
        """
        first, *rest = text.split(" ")
        out = list(map(self._units.get, rest))
        for i, ids in enumerate(out):
            if ids is None:
                unit = rest[i]
                if not unit or unit[0] in _ODD or unit[-1] in _ODD:
                    first, *rest = _SURE_CUT.split(text)
                    return [self._split(first), *map(self._learn, rest)]
                out[i] = self._learn(unit)
        if rest and (not first or first[-1] in _ODD):
            first, *rest = _SURE_CUT.split(text)
            return [self._split(first), *map(self._learn, rest)]
        return [self._split(first), *out]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        out, at = [], 0
        for m in self._added.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += self._plain(text[at:] if at else text)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, gathered from the offset table in one step."""
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(lengths) - lengths
        return self.blob[np.repeat(starts - before, lengths) + np.arange(lengths.sum())].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the token ids of a text, packed as little-endian unsigned 32-bit numbers.

    A null text has no ids (an empty value). Rows stay where they are: nothing is shuffled, and a
    task holds one Arrow batch at a time. ``path`` must be readable on every executor.
    """

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        known = vocabulary(path).awake()
        return texts.map(known.encode)

    return docs.withColumn(ids, encoded(F.coalesce(F.col(column), F.lit(""))))


def decode(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds ``column``: the text of packed ids; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def decoded(packed: pd.Series) -> pd.Series:
        known = vocabulary(path).awake()
        return packed.map(lambda b: known.decode(b).decode("utf-8", "replace"))

    return docs.withColumn(column, decoded(F.coalesce(F.col(ids), F.lit(b""))))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of an encode and decode.

    Null texts count as empty; null or repeated doc_ids give one row per input row.
    """
    coded = decode(encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
