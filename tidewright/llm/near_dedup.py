r"""Near-duplicate detection by improved consistent weighted sampling.

1. ``sketch``: one pass over the texts. A document becomes the sorted set of its
   five-word shingles (48-bit hashes) with their counts; each task also counts,
   over all its documents, in how many documents a shingle occurs, in a
   count-min table of fixed size. The tables add up to one for the corpus.
2. ``signatures``: shingles weigh ``tf * idf``. Improved consistent weighted
   sampling draws one (shingle, level) pair a hash function with probability
   proportional to the weights and alike for alike documents; two draws make a
   band. Passages that many documents share weigh little, so they rarely fill a
   band.
3. ``links``: within a band's bucket every document is compared with one leader
   (the bucket's first or last row, in turn by band): never all pairs of a
   bucket. Those that do not match their leader are dealt out again by a longer
   key, where other leaders await them.
4. ``visits`` and ``close_pairs``: alike documents form cells; a prefix-filter join
   over all texts finds, for every document, the other cells that can hold a link
   of it. Each document is compared with its cells' leaders, and what two documents
   have in and beside a leader bounds their similarity, so few pairs remain to be
   compared, and no link is lost.
5. ``components`` of the links are the classes.

A pair is linked when its weighted Jaccard similarity over shingles reaches the
threshold; a second rule links it at the same plain similarity, so that weights
never hide a plain near copy. Weights depend on the share of documents that hold
a shingle, not on their number: see :class:`Weights`.

Words are runs of ``[^\x20\x09-\x0D]``. Defined cases: a document of one to four
words has no shingle and is linked only to equal word sequences; a null or empty
text is alone in its class; rows that repeat a doc_id are judged text by text; an
empty table gives an empty result; other columns are ignored by :func:`classes`
and kept by :func:`deduplicate`; a null doc_id takes part, and its row always stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.word_tokens import _Memo, texts
from tidewright.llm.workspace import Scratch, hold, shuffles_removed, written

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 2
#: Count-min table: rows, cells a row, pieces a row travels in.
DEPTH, WIDTH, PIECES = 2, 1 << 21, 16
#: Tables that one group adds.
FAN = 64
#: Up to so many shingles are kept in a row, to count common ones in place; more change cost only.
CARRIED = 64
#: The share of documents, as one in so many, below which shingles weigh alike.
RARE = 2000
#: Share of a text by which its prefix is longer than one common shingle needs, so that several must be common.
SPARE = 0.12
FINE = 32_767
#: Slots of the filter that keeps sets without a candidate pair out of a shuffle.
SLOTS = 1 << 25
SKETCH = "row long, doc_id long, key string, ids binary, counts binary, piece int, cells binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _word_hashes() -> _Memo:
    return _Memo(xxhash.xxh3_64_intdigest, 200_000)


def shingles(words: list[bytes]) -> np.ndarray:
    """48-bit hashes of all runs of five words, in text order."""
    if len(words) < WORDS:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    h = w[:n].copy()
    for k in range(1, WORDS):
        h *= _A
        h ^= h >> np.uint64(31)
        h += w[k : k + n]
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _A
    return h >> np.uint64(16)


def pack(ids: np.ndarray) -> bytes:
    """A sorted set of 48-bit numbers as six planes of bytes of their differences, of which the upper compress well."""
    return np.diff(ids.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(planes, np.uint8).reshape(6, -1).T
    return np.cumsum(out.view("<u8")[:, 0], dtype=np.uint64)


def _cells(ids: np.ndarray) -> list[np.ndarray]:
    wide = ids.astype(np.uint64)
    return [(((wide * m) >> np.uint64(20)) & np.uint64(WIDTH - 1)).astype(np.int64) for m in (_A, _B)]


def _key(words: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def sketch(docs: DataFrame) -> DataFrame:
    """A row per document, and rows with pieces of each task's count-min table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near sketch", _word_hashes.cache_clear)
        row, table = TaskContext.get().partitionId() << 40, np.zeros((DEPTH, WIDTH), np.int32)

        def made(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in SKETCH.split(", ")])

        for doc_ids, found in texts(batches):
            out, sets = [], []
            for doc, text in zip(doc_ids, found):
                words = text.split()
                ids, counts = np.unique(shingles(words), return_counts=True)
                key = _key(words) if words else None
                packed = counts.astype("<u4").tobytes() if len(ids) and counts.max() > 1 else None
                out.append((row, doc, key, pack(ids), packed, None, None))
                sets.append(ids)
                row += 1
            for k, cells in enumerate(_cells(np.concatenate(sets))):
                np.add.at(table[k], cells, np.int32(1))
            yield made(out)
        if table.any():
            pieces = table.reshape(DEPTH * PIECES, -1)
            task = TaskContext.get().partitionId()
            yield made([(None, task, None, None, None, k, zlib.compress(x.astype("<i4").tobytes(), 1)) for k, x in enumerate(pieces)])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


class Weights:
    """Weights of shingles: count times inverse document frequency.

    The frequency is the smaller cell of the count-min table, which counts every
    document. It exceeds the true one by the documents' mean number of shingles
    over ``WIDTH`` in expectation, as a share of all documents and so alike at
    every corpus size. Shingles in fewer than one document in ``RARE`` weigh like
    one in ``RARE``, which covers that excess up to ``WIDTH / RARE`` (about 1000)
    shingles a document.
    """

    def __init__(self, documents: int, table: Broadcast) -> None:
        self.documents, self.table = documents, table
        self.most = np.float32(min(max(documents, 1), RARE))

    def seen(self, ids: np.ndarray) -> np.ndarray:
        (a, b), table = _cells(ids), self.table.value
        return np.maximum(np.minimum(table[0][a], table[1][b]), 1)

    def rarity(self, ids: np.ndarray) -> np.ndarray:
        """One in how many documents holds a shingle, ``most`` at most."""
        return np.minimum(np.float32(self.documents) / self.seen(ids).astype(np.float32), self.most)

    def __call__(self, ids: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        idf = np.log1p(self.rarity(ids))
        return idf if counts is None else idf * counts.astype(np.float32)


def weights(sketched: DataFrame) -> Weights:
    """Sum of the tasks' tables; the result has a fixed size, and no group adds more than ``FAN`` tables."""

    def add(pieces):
        import pandas as pd

        total = np.zeros(WIDTH // PIECES, np.int64)
        for cells in pieces["cells"]:
            total += np.frombuffer(zlib.decompress(cells), "<i4")
        most = np.minimum(total, np.iinfo(np.int32).max).astype("<i4")
        return pd.DataFrame({"piece": [pieces["piece"].iloc[0]], "task": [pieces["task"].iloc[0]], "cells": [zlib.compress(most.tobytes(), 1)]})

    # A task's number is in doc_id of its rows of pieces.
    tables = sketched.filter("piece is not null").select("piece", F.col("doc_id").alias("task"), "cells")
    most = tables.agg(F.max("task")).first()[0] or 0
    while most:
        most //= FAN
        tables = tables.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("piece", "task").applyInPandas(add, "piece int, task long, cells binary")
    table = np.zeros((DEPTH * PIECES, WIDTH // PIECES), np.int32)
    with shuffles_removed(sketched.sparkSession):
        summed = tables.collect()
    for r in summed:
        table[r["piece"]] = np.frombuffer(zlib.decompress(r["cells"]), "<i4")
    return Weights(sketched.filter("row is not null").count(), sketched.sparkSession.sparkContext.broadcast(table.reshape(DEPTH, WIDTH)))


class Sampler:
    """Improved consistent weighted sampling with hashed random numbers.

    The Gamma(2, 1) and uniform variates of a (shingle, function) pair come from
    16 bits each of one hash, by tables of quantiles.
    """

    def __init__(self, functions: int = BANDS * ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        grid = np.linspace(0, 40, 400_001)
        at = (np.arange(65_536) + 0.5) / 65_536
        gamma = np.interp(at, 1 - (1 + grid) * np.exp(-grid), grid)
        self.r, self.inverse = gamma.astype(np.float32), (1 / gamma).astype(np.float32)
        self.log_c, self.beta = np.log(gamma).astype(np.float32), at.astype(np.float32)

    def __call__(self, ids: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (as 64-bit hashes) of the sets that begin at ``starts``: an array (sets, functions)."""
        wide, logs = ids.astype(np.uint64) + np.uint64(1), np.log(weight)
        sizes = np.diff(np.append(starts, len(ids)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        low = np.uint64(0xFFFF)
        for k, odd in enumerate(self.odd):
            x = wide * odd
            x ^= x >> np.uint64(32)
            x *= _B
            x ^= x >> np.uint64(29)
            first = (x >> np.uint64(48)).astype(np.int64)
            r, beta = self.r.take(first), self.beta.take((x & low).astype(np.int64))
            level = np.floor(logs * self.inverse.take(first) + beta)
            a = self.log_c.take(((x >> np.uint64(32)) & low).astype(np.int64)) - r * (level - beta + np.float32(1))
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == least[owner])
            own = owner[hits]
            chosen = hits[np.flatnonzero(np.diff(own, prepend=-1))]
            out[:, k] = wide[chosen] * _A ^ level[chosen].astype(np.int64).astype(np.uint64)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, unlike for unlike bands."""
    out = np.empty((len(samples), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(samples), band + 1, np.uint64)
        for k in range(ROWS):
            h = (h ^ samples[:, band * ROWS + k]) * _A
            h ^= h >> np.uint64(32)
            h *= _B
        out[:, band] = h ^ (h >> np.uint64(29))
    return out.view(np.int64)


def signatures(sketched: DataFrame, weigh: Weights) -> DataFrame:
    """row, key and the band keys; null keys for documents without shingles and for repeats within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near")
        sample, seen = Sampler(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, keys, sets, counts = (c.to_pylist() for c in part.columns)
                place, ids, weight = [], [], []
                for k, (key, own, n) in enumerate(zip(keys, sets, counts)):
                    if own and key not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        place.append(k)
                        ids.append(unpack(own))
                        weight.append(weigh(ids[-1], n and np.frombuffer(n, "<u4")))
                found: list = [None] * len(rows)
                if place:
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
                    for k, x in zip(place, band_keys(sample(np.concatenate(ids), np.concatenate(weight), starts)).tolist()):
                        found[k] = x
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["row", "key", "bands"])

    return sketched.filter("row is not null").select("row", "key", "ids", "counts").mapInArrow(run, "row long, key string, bands array<long>")


def similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    return both / max(float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - both, 1e-30), len(i) / max(len(a) + len(b) - len(i), 1)


def _bitmap(rows: DataFrame) -> Broadcast:
    """Bits of the slots that occur in column ``slot``, of a fixed size."""
    # The bitmap functions count from 1: slot s is bit s % 32768 of bucket s // 32768 + 1.
    with shuffles_removed(rows.sparkSession):
        maps = rows.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    bits = np.zeros((SLOTS // 32_768, 4096), np.uint8)
    for r in maps:
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def _sets(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, ids and counts of the rows that occur in ``pairs``, and of some others.

    A bitmap of fixed size drops most other rows before any shuffle; the joins
    that follow decide.
    """
    keep, narrow = _slotted(sketched, pairs)
    return narrow.mapInArrow(lambda batches: map(keep, batches), "row long, ids binary, counts binary")


def _slotted(sketched: DataFrame, pairs: DataFrame):
    """A filter of batches by the bitmap of ``pairs``, and the sets it is for."""
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS))
    shared = _bitmap(pairs.select("row").union(pairs.select(F.col("leader").alias("row"))).select(slot.alias("slot")))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, bits = batch.column(3).to_numpy(), shared.value
        return batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)).select([0, 1, 2])

    return keep, sketched.filter("row is not null and octet_length(ids) > 0").select("row", "ids", "counts", slot.alias("slot"))


def parity(ids: np.ndarray) -> bytes:
    """Odd sketch: a bit for each slot that an odd number of shingles falls in; as many slots as shingles, up to a power of two."""
    slots = 1 << max(6, int(len(ids)).bit_length())
    return np.packbits((np.bincount((ids & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """Lower bound of the shingles that one of two sets has and the other lacks: slots of unlike parity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def likely(sketched: DataFrame, pairs: DataFrame, weigh: Weights, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (row, leader and more) that odd sketches of their rare shingles do not rule out; no link is lost.

    Linked sets differ in ``(1 - threshold) / (1 + threshold)`` of both sizes, or
    of both weights, at most, and each shingle that weighs most differs whole.
    """
    keep, narrow = _slotted(sketched, pairs)
    columns = pairs.columns
    most, share = float(np.log1p(weigh.most)), (1 - threshold) / (1 + threshold)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near")
        for batch in map(keep, batches):
            out = []
            for row, own, n in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(own)
                rare = ids[weigh.rarity(ids) >= weigh.most]
                out.append((row, len(ids), float(weigh(ids, n and np.frombuffer(n, "<u4")).sum(dtype=np.float64)), parity(rare)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["row", "n", "w", "odd"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([apart_at_least(a, b) for a, b in zip(batch.column("odd_a").to_pylist(), batch.column("odd_b").to_pylist())], float)
            sizes, heavy = (batch.column(f"{x}_a").to_numpy() + batch.column(f"{x}_b").to_numpy() for x in "nw")
            yield batch.filter(pa.array((apart <= share * sizes + 1e-6) | (apart * most <= share * heavy * (1 + 1e-6)))).select(columns)

    measured = written(narrow.mapInArrow(measure, "row long, n int, w double, odd binary"), "near-odd")
    one, two = (measured.select(F.col("row").alias(key), *[F.col(x).alias(f"{x}_{end}") for x in ("n", "w", "odd")]) for key, end in (("row", "a"), ("leader", "b")))
    return pairs.join(one, "row").join(two, "leader").select(*pairs.columns, "n_a", "n_b", "w_a", "w_b", "odd_a", "odd_b").mapInArrow(test, pairs.schema)


def _compared(sketched: DataFrame, pairs: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` over ``pairs`` (row, leader and more) with the sets of both."""
    # Written once: both joins read it, and no task runs two Python stages at a time.
    sets = written(_sets(sketched, pairs), "near-sets", compression="zstd")
    own = sets.select("row", F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"))
    lead = sets.select(F.col("row").alias("leader"), F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"))
    return pairs.join(own, "row").join(lead, "leader").select(*pairs.columns, "ids_a", "counts_a", "ids_b", "counts_b").mapInArrow(compare, schema)


def verify(sketched: DataFrame, pairs: DataFrame, weigh: Weights) -> DataFrame:
    """row, leader, likeness: the larger of the two similarities."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near")
        numbers = lambda n: n and np.frombuffer(n, "<u4")
        for batch in batches:
            found = []
            for a, n, b, m in zip(*(batch.column(k) for k in range(2, 6))):
                a, n, b, m = a.as_py(), n.as_py(), b.as_py(), m.as_py()
                x, y = unpack(a), unpack(b)
                found.append(max(similarity(x, y, weigh(x, numbers(n)), weigh(y, numbers(m)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["row", "leader", "likeness"])

    return _compared(sketched, pairs.select("row", "leader"), compare, "row long, leader long, likeness double")


def profiles(sketched: DataFrame, pairs: DataFrame, weigh: Weights) -> DataFrame:
    """What each row of ``pairs`` (row, leader, cell, home, alone) has in and beside its leader.

    ``i`` of its ``n`` shingles, and ``wi`` of its weight ``w``, are shingles of
    the leader; ``tokens`` and ``weights`` are its others (none where ``alone``).
    The leader has ``m`` more shingles: ``missing``, or null for over ``CARRIED``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near")
        numbers = lambda n: n and np.frombuffer(n, "<u4")
        for batch in batches:
            found, ends, tokens, shares, missing = [], [0], [], [], []
            for alone, a, n, b, m in zip(*(batch.column(k) for k in range(4, 9))):
                a, n, b, m = a.as_py(), n.as_py(), b.as_py(), m.as_py()
                x, y = unpack(a), unpack(b)
                w = weigh(x, numbers(n))
                both = np.isin(x, y, assume_unique=True)
                lacks = y[~np.isin(y, x, assume_unique=True)].astype(np.int64)
                found.append((max(similarity(x, y, w, weigh(y, numbers(m)))), len(x), int(both.sum()), float(w.sum(dtype=np.float64)), float(w[both].sum(dtype=np.float64)), len(lacks)))
                missing.append(lacks if len(lacks) <= CARRIED else None)
                beside = np.zeros(0, np.int64) if alone.as_py() else np.flatnonzero(~both)
                ends.append(ends[-1] + len(beside))
                tokens.append(x[beside].astype(np.int64))
                shares.append(w[beside])
            if found:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), t)) for x, t in ((tokens, pa.int64()), (shares, pa.float32()))]
                plain = [pa.array(c, t) for c, t in zip(zip(*found), (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()))]
                names = ["row", "leader", "cell", "home", "alone", "likeness", "n", "i", "w", "wi", "m", "tokens", "weights", "missing"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *plain, *lists, pa.array(missing, pa.list_(pa.int64()))], names=names)

    schema = "row long, leader long, cell long, home boolean, alone boolean, likeness double, n int, i int, w double, wi double, m int, tokens array<long>, weights array<float>, missing array<long>"
    return _compared(sketched, pairs.select("row", "leader", "cell", "home", "alone"), compare, schema)


def prefixes(sketched: DataFrame, weigh: Weights, threshold: float) -> DataFrame:
    """row, n, weight and the rarest shingles: those that a linked pair's first common shingles can be.

    Shingles stand in one order for all documents, rarest first. Of what a linked
    pair has in common, the first ``SPARE`` of the smaller text (by number or by
    weight) stands in the prefixes of both. ``rests`` is the
    share of the weight from a shingle on, in parts of ``FINE`` and rounded up;
    ``beyond`` is the share past the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near")
        for batch in batches:
            sizes, totals, beyond, ends, tokens, rests = [], [], [], [0], [], []
            for own, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = unpack(own)
                order = np.lexsort((ids, weigh.seen(ids)))
                rest = np.cumsum(weigh(ids, n and np.frombuffer(n, "<u4"))[order][::-1], dtype=np.float64)[::-1]
                most = np.arange(len(ids), 0, -1) >= (threshold - SPARE) * len(ids) - 1e-6
                k = int(np.count_nonzero(most | (rest >= (threshold - SPARE) * rest[0] * (1 - 1e-6))))
                sizes.append(len(ids))
                totals.append(rest[0])
                beyond.append(rest[k] / rest[0] if k < len(ids) else 0.0)
                ends.append(ends[-1] + k)
                tokens.append(ids[order[:k]].astype(np.int64))
                rests.append(np.minimum(np.ceil(FINE * (rest[:k] / rest[0]) + 1e-6), FINE).astype(np.int16))
            if sizes:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (tokens, rests)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(totals, pa.float64()), *lists, pa.array(beyond, pa.float64())], names=["row", "n", "weight", "tokens", "rests", "beyond"])

    narrow = sketched.filter("row is not null and octet_length(ids) > 0").select("row", "ids", "counts")
    return narrow.mapInArrow(run, "row long, n int, weight double, tokens array<long>, rests array<smallint>, beyond double")


def visits(sketched: DataFrame, homes: DataFrame, weigh: Weights, threshold: float) -> DataFrame:
    """row, cell: every other cell that may hold a text linked to the row, by a prefix-filter join without loss.

    ``homes``: row, cell and size (of the cell) of every text. A linked pair has a
    first common shingle; what either side holds from there on is at least what
    the pair must share, ``threshold / (1 + threshold)`` of both sizes (or of both
    weights). A cell's texts are one posting a shingle, with the most that any of
    them holds and the least that any of them is, and of two cells the smaller
    one's texts visit the larger. Shingles of one cell only are dropped first.
    """
    known = written(prefixes(sketched, weigh, threshold).join(homes.select("row", "cell", "size"), "row"), "near-prefixes", compression="zstd")
    mixed = known.select(F.explode("tokens").alias("token"), "cell").groupBy("token").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    # Tokens that share a slot with a mixed one stay too; the join drops them.
    shared = _bitmap(mixed.filter("low < high").select(F.col("token").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            tokens, sizes = batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy()
            whole_n = batch.column(1).to_numpy()
            starts, own = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            at = tokens & (SLOTS - 1)
            mixed_here = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            rests = batch.column(4).flatten().to_numpy().astype(float)
            # Rests are rounded up by 1 at most, so a shingle's share is the difference to the next rest and 1 at most.
            later = np.append(rests[1:], 0.0)
            later[(starts + sizes - 1)[sizes > 0]] = np.floor(FINE * batch.column(7).to_numpy()[sizes > 0])
            number = np.bincount(own, weights=mixed_here, minlength=len(sizes))
            held_weight = np.bincount(own, weights=mixed_here * (rests - later + 1), minlength=len(sizes)) / FINE
            least = SPARE * threshold
            able = (number >= least * whole_n - 1e-6) | (held_weight >= least * (1 - 1e-6))
            # A linked pair has the threshold's share of both texts from its first common shingle on; later entries only counted.
            left = whole_n[own] - (np.arange(len(own)) - starts[own])
            live = (left >= threshold * whole_n[own] - 1e-6) | (rests >= threshold * FINE * (1 - 1e-6))
            held = np.flatnonzero(mixed_here & able[own] & live)
            owner = own[held]
            row, n, weight, cell, size = (batch.column(k).to_numpy()[owner] for k in (0, 1, 2, 5, 6))
            rest = rests[held] / FINE * weight
            cols = (tokens[held], row, cell, size, n, (n - (held - starts[owner])).astype(np.int32), weight.astype(np.float32), rest.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "row", "cell", "size", "n", "left", "weight", "rest"])

    flat = known.select("row", "n", "weight", "tokens", "rests", "cell", "size", "beyond").mapInArrow(keep, "token long, row long, cell long, size long, n int, left int, weight float, rest float")
    flat = written(flat, "near-rare")
    least, most = (lambda x: F.min(x).alias(f"{x}_b")), (lambda x: F.max(x).alias(f"{x}_b"))
    hosts = flat.groupBy("token", F.col("cell").alias("cell_b"), F.col("size").alias("size_b")).agg(most("left"), least("n"), most("rest"), least("weight"))
    share = threshold / (1 + threshold)
    enough = F.least("left", "left_b") >= share * (F.col("n") + F.col("n_b")) - 1e-6
    heavy = F.least("rest", "rest_b") >= share * (F.col("weight") + F.col("weight_b")) * (1 - 1e-6)
    smaller = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("cell") < F.col("cell_b")))
    return flat.join(hosts, "token").filter(smaller & (enough | heavy)).select("row", F.col("cell_b").alias("cell")).distinct()


def close_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """row, leader: every pair of unlike labels that shares a cell and can be linked.

    ``members``: profiles of the cells' own texts and visitors, with labels. What
    two texts share is what both have of the cell's leader, known from what they
    lack of it, and the shingles beside it that both have. Pairs with a common
    shingle beside the leader meet at the first one (rows with more than
    ``CARRIED`` such shingles meet at each); pairs without one can only be linked
    if both have the threshold's share in the leader. Rows that lack more than
    ``CARRIED`` shingles count as having what they can have.
    """
    share = threshold / (1 + threshold)
    beside = members.select("cell", "row", "label", "home", F.explode(F.arrays_zip("tokens", "weights")).alias("x"))
    beside = beside.select("cell", "row", "label", "home", F.col("x.tokens").alias("token"), F.col("x.weights").alias("weight"))
    mixed = beside.groupBy("cell", "token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("home").alias("any_home"))
    mixed = written(mixed.filter("low < high and any_home").select("cell", "token"), "near-beside")
    own = beside.join(mixed, ["cell", "token"]).groupBy("cell", "row").agg(F.sort_array(F.collect_list("token")).alias("held"), F.sum("weight").alias("we"))
    numbers = ("row", "label", "home", "n", "i", "w", "wi", "m", "missing")
    held = own.join(members.select("cell", *numbers), ["cell", "row"])
    held = held.select("cell", *numbers, "we", F.size("held").alias("e"), F.when(F.size("held") <= CARRIED, F.col("held")).alias("carried"), F.explode("held").alias("token"))
    held = written(held, "near-held")
    other = held.filter("home").select("cell", "token", *[F.col(x).alias(f"{x}_b") for x in (*numbers, "we", "e", "carried")])
    once = (F.col("label") != F.col("label_b")) & (~F.col("home") | (F.col("row") < F.col("row_b")))
    at_most, sizes = F.least("i", "i_b"), share * (F.col("n") + F.col("n_b")) - 1e-6
    inside = F.coalesce(F.col("i") - F.col("m_b") + F.size(F.array_intersect("missing", "missing_b")), at_most)
    weights = share * (F.col("w") + F.col("w_b")) * (1 - 1e-6)
    weighty = F.least("wi", "wi_b") + F.least("we", "we_b") >= weights
    common = F.array_intersect("carried", "carried_b")
    meets = F.col("carried").isNull() | F.col("carried_b").isNull() | ((F.col("token") == F.array_min(common)) & (weighty | (inside + F.size(common) >= sizes)))
    first = held.join(other, ["cell", "token"]).filter(once & (weighty | (at_most + F.least("e", "e_b") >= sizes)) & meets).select("row", F.col("row_b").alias("leader"))

    fit = members.filter((F.col("i") >= threshold * F.col("n") - 1e-6) | (F.col("wi") >= threshold * F.col("w") * (1 - 1e-6))).select("cell", *numbers)
    main = members.filter("row = leader").select("cell", F.col("label").alias("main"))
    odd = fit.join(main, "cell").filter("label <> main")
    rest = fit.select("cell", *[F.col(x).alias(f"{x}_b") for x in numbers])
    bound = ((at_most >= sizes) & (inside >= sizes)) | (F.least("wi", "wi_b") >= weights)
    second = odd.join(rest, "cell").filter((F.col("label") != F.col("label_b")) & (F.col("home") | F.col("home_b")) & bound).select("row", F.col("row_b").alias("leader"))
    return first.union(second).select(F.least("row", "leader").alias("row"), F.greatest("row", "leader").alias("leader")).distinct()


def links(sketched: DataFrame, signed: DataFrame, weigh: Weights, threshold: float = THRESHOLD, levels: int = 2) -> DataFrame:
    """Verified (row, leader) links between documents of different texts, enough to connect every class.

    ``signed``: one row per text, with its band keys.

    Rounds of leaders find most links. Texts at ``2 * threshold - 1`` or more
    from a leader form cells, each led by the text with most company in its buckets,
    as texts in the middle of their like have.
    :func:`visits` names the texts of other cells that a cell may hold links to,
    and :func:`profiles` compares members and visitors with the cell's leader
    once. What is still apart after that and can be linked at all, by
    :func:`close_pairs`, is compared pair by pair. Bands decide cost only: a pair
    that reaches the threshold is compared, or already in one component.
    """
    tested: list[DataFrame] = []

    def all_tested() -> DataFrame:
        out = tested[0]
        for more in tested[1:]:
            out = out.unionByName(more)
        return out

    def test(pairs: DataFrame) -> None:
        if tested:
            pairs = pairs.join(all_tested().select("row", "leader"), ["row", "leader"], "left_anti")
        with Scratch(sketched.sparkSession) as scratch:  # the compared sets go at once
            tested.append(written(verify(sketched, written(pairs, "near-pairs"), weigh), "near-tested"))
            scratch.keep(tested[-1])

    members = signed.filter("bands is not null").select("row", F.posexplode("bands").alias("band", "key"))
    company = None
    for level in range(levels):
        buckets = members.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).filter("low <> high")
        leader = F.when(F.col("band") % 2 == 0, F.col("low")).otherwise(F.col("high"))
        met = written(members.join(buckets, "key").select("row", "band", "key", leader.alias("leader"), "n"), "near-led")
        company = met.groupBy("row").agg(F.sum("n").alias("company")) if company is None else company
        led = met.filter("row <> leader")
        test(led.select("row", "leader").distinct())
        left = led.join(all_tested().filter(F.col("likeness") < threshold).select("row", "leader"), ["row", "leader"]).select("row", "band", "key")
        if level + 1 == levels or left.isEmpty():
            break
        # The key grows by 1 band, then by 3 more.
        more = [F.get("bands", F.pmod(F.col("band") + k, F.lit(BANDS))) for k in range(2**level, 2 ** (level + 1) + level)]
        members = left.join(signed.select("row", "bands"), "row").select("row", "band", F.xxhash64("key", *more).alias("key"))

    everyone = signed.filter("bands is not null").select("row")
    near = written(all_tested().filter(F.col("likeness") >= 2 * threshold - 1), "near-near")
    cells = everyone.join(components(near.select("row", "leader")), "row", "left").select("row", F.coalesce("label", "row").alias("cell"))
    cells = written(cells.join(company, "row", "left"), "near-cells")
    leaders = cells.groupBy("cell").agg(F.max_by("row", F.struct("company", "row")).alias("leader"), F.count("*").alias("size"))
    homes = written(cells.join(leaders, "cell").select("row", "cell", "leader", "size"), "near-homes")
    guests = visits(sketched, homes, weigh, threshold).join(homes.filter("row = leader").select("cell", "leader", "size"), "cell")
    guests = written(guests.select("row", "leader", "cell", F.lit(False).alias("home"), (F.col("size") == 1).alias("alone")), "near-guests")
    own = homes.filter("size > 1").select("row", "leader", "cell", F.lit(True).alias("home"), F.lit(False).alias("alone"))
    with Scratch(sketched.sparkSession) as scratch:
        pairs = own.union(guests.filter("not alone")).union(likely(sketched, guests.filter("alone"), weigh, threshold))
        profiled = written(profiles(sketched, written(pairs, "near-visits"), weigh), "near-profiles")
        scratch.keep(profiled)
    tested.append(profiled.filter("row <> leader").select("row", "leader", "likeness"))

    def linked() -> DataFrame:
        return all_tested().filter(F.col("likeness") >= threshold).select("row", "leader")

    labels = components(linked())
    shared = profiled.filter("not alone").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    test(close_pairs(written(shared, "near-members"), threshold))
    return linked()


def components(edges: DataFrame) -> DataFrame:
    """row, label: the least row of its component, by min-label steps with pointer jumping.

    Every step is written, so lost executors cost one step at most; the number
    of steps is logarithmic in a component's diameter, not in its size.
    """
    both = written(edges.select(F.col("row").alias("a"), F.col("leader").alias("b")).union(edges.select("leader", "row")).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("row").alias("b"), "label"), "b").groupBy(F.col("a").alias("row")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "row").select("row", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("row").alias("via"), F.col("label").alias("root"))
        step = written(lower.join(jump, "via").select("row", "old", F.least("via", "root").alias("label")), "near-labels")
        if step.filter("label <> old").isEmpty():
            return labels
        labels = step.select("row", "label")


def _verdicts(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key (of the words), class_id, class_size and kept of every row."""
    with Scratch(docs.sparkSession) as scratch:
        sketched = written(sketch(docs), "near-sketch", compression="zstd")
        weigh = weights(sketched)
        signed = written(signatures(sketched, weigh), "near-signatures")
        names = signed.filter("key is not null").groupBy("key").agg(F.min("row").alias("text_row"), F.max("bands").alias("bands"))
        names = written(names, "near-texts")
        edges = links(sketched, names.select(F.col("text_row").alias("row"), "bands"), weigh, threshold)
        labels = components(edges).select(F.col("row").alias("text_row"), "label")
        named = names.select("key", "text_row").join(labels, "text_row", "left").select("key", F.coalesce("label", "text_row").alias("label"))
        rows = sketched.filter("row is not null").select("row", "doc_id", "key").join(named, "key", "left")
        rows = written(rows.select("doc_id", "key", F.coalesce("label", "row").alias("label")), "near-rows")
        scratch.keep(rows)
    sizes = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(sizes, "label").select("doc_id", "key", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), class_size, kept (doc_id = class_id) of every row."""
    return _verdicts(docs, threshold).drop("key")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    while name in docs.columns:
        name += "_"
    return name


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, with their columns.

    A row goes by its doc_id and its words, so another text under the same doc_id
    stays; rows alike in both share one verdict.
    """

    @F.arrow_udf("string")
    def key_of(text: pa.Array) -> pa.Array:
        words = (x and x.split() for x in text.cast(pa.binary()).to_pylist())
        return pa.array([_key(x) if x else None for x in words], pa.string())

    key, gone_id, gone_key = (_free(docs, f"_tw_{x}") for x in ("key", "gone_id", "gone_key"))
    gone = _verdicts(docs, threshold).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    keyed = docs.withColumn(key, key_of("text"))
    return keyed.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
