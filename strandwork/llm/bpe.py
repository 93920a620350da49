"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut by the pre-tokenizer's pattern and each piece is encoded by itself.
The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton over
the vocabulary gives the tokens of two bytes or more that end at each position, longest first; the longest
that would stand beside the token before it in a BPE result is the last one of that
prefix, and the ids are traced back from the end.  Two tokens are compatible if no
merge across their border comes first at any moment of their making; answers are
memoised.  Each match is looked at once, so the time is linear in the piece, and the
result is the one that merging by rank gives, as a prefix has only one such last token.

Words that recur are remembered with their ids in two generations: when the younger is
full it becomes the older one, and what is asked for again is taken along.  The memory is
given back at the end of each task.

Defined cases: a null text is empty; empty texts have no ids; rows that repeat are
encoded each by itself; null doc_ids stay null; an empty table gives no rows; further columns, clashing
names included, are ignored.  Lone surrogates, which valid UTF-8 never holds, become "?".
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import plain, ship

#: Words, and pieces, whose ids one generation of the memory holds in a Python worker.
MEMO = 120_000
#: Pairs of tokens whose compatibility is remembered.
MEMO_PAIRS = 300_000
#: Words longer than this are not remembered.
MEMO_CHARS = 64
#: Fixed value: the pattern under which a space between two other characters that aren't white begins a piece.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that end words.
MARKS = ".,;:!?"
#: White characters besides space and line break, and spaces beside white ones.
_ODD = re.compile(r"[^\S \n]|  | \n|\n |^ | $")
_START, _NEVER = -1, 1 << 62


class Encoder:
    """Encodes bytes by a rank table {token bytes: id}; every byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.length = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        self.automaton = ahocorasick.Automaton()
        self.single = [ranks[bytes([c])] for c in range(256)]
        for t, i in ranks.items():
            if len(t) > 1:
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self._edges: dict[int, list[tuple[bytes, int]]] = {}
        self._compatible: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte, or where no merges lead to it."""
        text = self.tokens[token]
        pieces = [text[k : k + 1] for k in range(len(text))]
        while len(pieces) > 2:
            rank, k = min((self.ranks.get(x + y, token), k) for k, (x, y) in enumerate(zip(pieces, pieces[1:])))
            if rank >= token:
                return None
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        return (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) edge of a token while it is made, last first, and the rank of the merge that ends it."""
        key = 2 * token + side
        found = self._edges.get(key)
        if found is None:
            found, end, at = [], _NEVER, token
            while True:
                found.append((self.tokens[at], end))
                halves = self.parts(at)
                if halves is None:
                    break
                end, at = at, halves[side]
            self._edges[key] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` (or the start) and ``right`` as neighbours."""
        key = left << 24 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= MEMO_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        b = self.edge(right, 0)
        if len(b) == 1 and len(b[0][0]) > 1:  # no merges lead to it
            return False
        if left == _START:
            return True
        a = self.edge(left, 1)
        i = j = 0
        while True:  # all pairs that stand beside each other at some moment, the last ones first
            across = self.ranks.get(a[i][0] + b[j][0])
            # Of equal merges the left one comes first.
            if across is not None and across < a[i][1] and across <= b[j][1]:
                return False
            made_a = a[i + 1][1] if i + 1 < len(a) else -1
            made_b = b[j + 1][1] if j + 1 < len(b) else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.backtrack(piece)

    def backtrack(self, piece: bytes) -> list[int]:
        """Ids of a piece: the last token of each prefix, the longest match that stands beside the one before it, traced back from the end."""
        known, size = self._compatible, len(piece)
        last, found = [_START, *map(self.single.__getitem__, piece)], -1  # where no longer token fits, the byte does
        for end, (i, n) in self.automaton.iter(piece.decode("latin-1")):
            if end != found:
                before = last[end + 1 - n]
                ok = known.get(before << 24 | i)
                if self.compatible(before, i) if ok is None else ok:
                    last[end + 1], found = i, end
        ids, length = [], self.length
        while size:
            ids.append(last[size])
            size -= length[last[size]]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Memory:
    """A bounded map in two generations."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Tokenizer:
    """Pattern and encoder with a bounded memory: text to ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.encoder = Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
        self.find = regex.compile(pattern).findall
        self.spaced = pattern == SPACED
        self.lengths = np.array(self.encoder.length, np.int32)
        self.pieces, self.words = Memory(MEMO), Memory(MEMO)

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece, as unsigned 32-bit integers."""
        return array("I", self.encoder.encode(piece.encode("utf-8", "replace"))).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._ids(piece)
            if len(piece) <= MEMO_CHARS:
                self.pieces.put(piece, ids)
        return ids

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it; letters are one piece, and a mark after letters is another."""
        ids = self.words.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._ids(" " + word)
            elif word[-1] in MARKS and word[:-1].isalpha():
                return self.word(word[:-1]) + self.piece(word[-1])
            else:
                ids = self.whole(" " + word)
            if len(word) <= MEMO_CHARS:
                self.words.put(word, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.spaced and not _odd(text):
            first, *rest = text.split(" ")
            young = self.words.young.get
            out = self.whole(first) + b"".join([young(w) or self.word(w) for w in rest])
        else:
            out = self.whole(text)
        return np.frombuffer(out, "<u4")

    def forget(self) -> None:
        self.pieces.clear()
        self.words.clear()


def _odd(text: str) -> bool:
    """Whether a space of the text may stand beside another white character."""
    if text.isascii() and not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
    return _ODD.search(text) is not None


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker; the file is read on the executors, where the vocabulary is installed."""
    return Tokenizer(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row (doc_id, n_tokens, ids, decoded) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            ids = [t.encode(x.as_py() or "") for x in b.column(1)]
            decoded = [t.encoder.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )
        t.forget()

    ship(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode``, with digests in place of ids and bytes: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(t.encoder.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    ship(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
