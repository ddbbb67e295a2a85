"""Byte-pair encoding by backtracking, and decoding by an offset table.

Each pre-token is cut greedily: an Aho-Corasick automaton over the vocabulary
gives the tokens that start at every position; the longest one is taken if it is
compatible with the token before it, else the next shorter one, else the step
before is undone. A position that has failed once is never tried again, so the
work is linear in the length. Two neighbours are compatible if merging by rank
would have left their border alone, which a walk down their merge trees decides;
the answers make the pair-compatibility table.

Ids equal those of the library's rank-by-rank merging (``tests/llm``).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.word_tokens import _Memo
from tidewright.llm.workspace import hold

#: Positions whose matches are held at a time.
WINDOW = 1 << 15
# Fixed value: the byte-level splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Bytes that Latin-1 prints stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str, words: int = 300_000, pairs: int = 1_000_000) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        vocabulary: dict[str, int] = model["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocabulary.items():
            table[i] = as_bytes(token)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.offsets, self.bytes = _blob(table)
        self.decimal_offsets, self.decimals = _blob([b"%d," % i for i in range(size)])
        self.length = [len(x) for x in table]
        self.longest = max(self.length)
        # Rank of a token: -1 for single bytes, else the place of the merge that makes it.
        self.rank, self.halves, self.merged = [-1] * size, [(i, i) for i in range(size)], {}
        for k, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = k, (left, right)
            self.merged[left, right] = k
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.values():
            self.automaton.add_word(table[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        self._fits = _Memo(lambda pair: self._compatible(*pair), pairs)
        self._words = _Memo(self._word, words)

    def _compatible(self, a: int, b: int) -> bool:
        """Would merging by rank keep the border between tokens ``a`` and ``b``?

        Going back in time, the token made last is cut first. A merge across the
        border that comes before the cut it would need to wait for wins.
        """
        limit = len(self.merged)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]

    def _word(self, word: str) -> bytes:
        return np.array(self.cut(word.encode()), "<u4").tobytes()

    def starting(self, data: bytes, n: int) -> list[list[int]]:
        """Tokens that start at each of the first ``n`` positions, short ones first."""
        length, found = self.length, [[] for _ in range(len(data))]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            found[end + 1 - length[token]].append(token)
        return found[:n] if n < len(found) else found

    def cut(self, data: bytes) -> list[int] | array:
        """Ids of one pre-token. A long one has the matches of one window held and costs some eight bytes a byte."""
        n, length, fits = len(data), self.length, self._fits
        if n <= WINDOW:
            starting, out, tried = self.starting(data, n), [], [0] * (n + 1)
        else:
            starting, out, tried = _Windows(self, data), array("I"), array("H", bytes(2 * (n + 1)))
        # ``tried``: how many of the position's tokens, from the longest, have been used up.
        dead = bytearray(n + 1)
        at = 0
        while at < n:
            options, last = starting[at], out[-1] if out else -1
            for k in range(tried[at], len(options)):
                token = options[-1 - k]
                if not dead[at + length[token]] and (last < 0 or fits[last, token]):
                    tried[at] = k + 1
                    out.append(token)
                    at += length[token]
                    tried[at] = 0
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary cannot spell this text")
                dead[at] = 1
                at -= length[out.pop()]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it are single ids."""
        words = self._words
        if not self.marks or not self.marks.search(text):
            return np.frombuffer(b"".join(map(words.__getitem__, self.pieces.findall(text))), "<u4")
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*map(words.__getitem__, self.pieces.findall(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return np.frombuffer(b"".join([*out, *map(words.__getitem__, self.pieces.findall(text[at:]))]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return _gather(ids, self.offsets, self.bytes).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return _gather(ids, self.decimal_offsets, self.decimals)[:-1]


class _Windows:
    """Tokens that start at each position of a long pre-token, found a window at a time."""

    def __init__(self, bpe: ByteBpe, data: bytes) -> None:
        self.bpe, self.data, self.base, self.held = bpe, data, -1, []

    def __getitem__(self, at: int) -> list[int]:
        base = at // WINDOW * WINDOW
        if base != self.base:
            end = base + WINDOW
            self.base, self.held = base, self.bpe.starting(self.data[base : end + self.bpe.longest], min(end, len(self.data)) - base)
        return self.held[at - base]


def _blob(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.frombuffer(b"".join(parts), np.uint8)


def _gather(ids: np.ndarray, offsets: np.ndarray, blob: np.ndarray, rows: int = 1 << 18) -> bytes:
    out = []
    for at in range(0, len(ids), rows):
        own = ids[at : at + rows].astype(np.int64)
        start = offsets[own]
        n = offsets[own + 1] - start
        ends = n.cumsum()
        out.append(blob[np.arange(ends[-1]) + np.repeat(start - ends + n, n)].tobytes())
    return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def byte_bpe(path: str) -> ByteBpe:
    """The Python worker's encoder for a vocabulary."""
    hold("byte bpe", _encoder.cache_clear)
    return _encoder(path)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Defined cases: a null text counts as empty (no ids); repeated rows give
    equal rows; an empty table gives an empty result; other columns are ignored.
    Very long texts, also ones of a single pre-token, need memory in proportion
    to their length (some twenty bytes a byte).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = byte_bpe(vocabulary), hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    out.append((len(ids), sha(bpe.decimal(ids)).hexdigest(), sha(bpe.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
