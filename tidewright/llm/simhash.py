r"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

1. ``fingerprints``: one pass over the texts. Texts in lower case (A-Z only) are
   cut in words ``[^\x20\x09-\x0D]+``; each run of three words, joined by blanks, is
   hashed to 64 bits, and a fingerprint bit is 1 if it is set in over half the
   hashes.
2. Equal fingerprints are one from here on.
3. ``links``: 64 bits make four blocks, and fingerprints at two differing bits
   have two blocks in common at least. So each fingerprint goes to six buckets,
   one per pair of blocks, and is compared with the others of its bucket. A
   bucket of more than ``LIMIT`` fingerprints is not compared but dealt out anew:
   the bits that it leaves open make four blocks again. After three levels only
   eight bits are open, so no bucket holds more than 256 fingerprints, whatever
   the corpus: no pair is lost and none is emitted twice over. Of a bucket, links
   to the least fingerprint of each of its components leave, not all pairs.
4. ``components`` of the links; a row's ``component_id`` is the least doc_id of
   its component.

Buckets with more than a thousandth of a level's rows (so a thousand at most) are
found by counting beforehand and pass to the next level without a shuffle.

Defined cases: a text of one or two words is one shingle; a null, empty or blank
text has fingerprint zero and is linked like any other; rows that repeat a doc_id
each keep a row; a null doc_id takes part and never names a component with
another doc_id in it; very long texts are hashed in parts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.near_dedup import components
from tidewright.llm.word_tokens import texts
from tidewright.llm.workspace import Scratch, hold, written

WORDS, SEED, DISTANCE = 3, 42, 2
#: Blocks a level cuts the open bits in; so many less DISTANCE are common.
BLOCKS, LEVELS = 4, 3
#: A bucket with more fingerprints is dealt out anew; at most 256, what eight open bits allow.
LIMIT = 256
#: The share of a level's rows, as one in so many, above which a bucket is known beforehand.
SHARE = 1000
#: Shingles hashed at a time.
PART = 1 << 15
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def fingerprint(text: bytes) -> int:
    """Fingerprint of one text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - WORDS + 1, 1)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        stop = min(at + PART, n)
        begin = starts[at:stop].tolist()
        end = (starts[np.minimum(np.arange(at, stop) + WORDS, len(words))] - 1).tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end)), "<u8", stop - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash")
        for ids, found in texts(batches):
            prints = np.array([fingerprint(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints)], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def finer(mask: int) -> list[int]:
    """The masks of the next level: ``mask`` with all but DISTANCE of the blocks of its open bits."""
    open_bits = [k for k in range(64) if not mask >> k & 1]
    cuts = [round(len(open_bits) * k / BLOCKS) for k in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in open_bits[a:z]) for a, z in zip(cuts, cuts[1:])]
    return [mask | sum(chosen) for chosen in combinations(blocks, BLOCKS - DISTANCE)]


def masks() -> list[list[int]]:
    """The masks of each level."""
    out, now = [], [0]
    for _ in range(LEVELS):
        now = [x for m in now for x in finer(m)]
        out.append(now)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def roots(prints: np.ndarray) -> np.ndarray:
    """The least fingerprint of each one's component, within a bucket of bounded size."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= DISTANCE
    label = np.arange(len(prints))
    while True:
        least = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (least == label).all():
            return prints[label]
        label = least[least]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that come one after another; members of buckets over LIMIT leave unlinked, with their mask.

    Rows (mask, value, print) are sorted by mask, value and print. A task holds a
    batch and LIMIT members at most.
    """

    def out(prints, others, masks) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (prints, others, masks)], names=["print", "root", "mask"])

    held: list[int] = []
    key, over = None, False

    def closed() -> list[tuple]:
        if over or len(held) < 2:
            return []
        own = np.array(held, np.int64)
        least = roots(own.view(np.uint64)).view(np.int64)
        apart = least != own
        return list(zip(own[apart].tolist(), least[apart].tolist()))

    for batch in batches:
        mask, value, prints = (batch.column(k).to_numpy() for k in range(3))
        if not len(prints):
            continue
        starts = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
        ends, links, again = np.append(starts[1:], len(prints)), [], []
        # Runs inside the batch with one member need no step; first and last may go on elsewhere.
        wanted = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(prints)))
        for k in wanted.tolist():
            a, z = int(starts[k]), int(ends[k])
            if (mask[a], value[a]) != key:
                links += closed()
                key, held, over = (mask[a], value[a]), [], False
            for at in range(a, z, LIMIT):
                own = prints[at : min(at + LIMIT, z)].tolist()
                if not over and len(held) + len(own) > LIMIT:
                    over = True
                    again += [(x, int(mask[a])) for x in held]
                    held = []
                if over:
                    again += [(x, int(mask[a])) for x in own]
                else:
                    held = held + own
        if links:
            yield out([x for x, _ in links], [y for _, y in links], [None] * len(links))
        if again:
            yield out([x for x, _ in again], [None] * len(again), [m for _, m in again])
    if links := closed():
        yield out([x for x, _ in links], [y for _, y in links], [None] * len(links))


def links(prints: DataFrame, share: int = SHARE) -> DataFrame:
    """row, leader: links (of at most DISTANCE bits or by a chain of such) that connect every component of ``prints`` (print, distinct)."""
    spark, found = prints.sparkSession, None
    todo = prints.select("print", F.lit(0).cast("long").alias("mask"))
    parents = [0]
    for level, now in enumerate(masks()):
        step = spark.createDataFrame([(_signed(m), [_signed(x) for x in finer(m)]) for m in parents], "mask long, finer array<long>")
        members = todo.join(F.broadcast(step), "mask").select("print", F.explode("finer").alias("mask"))  # 36 rows at most
        members = members.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("value"), "print")
        last = level + 1 == LEVELS
        waiting = None
        if not last:
            counts = written(members.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-counts")
            total = counts.agg(F.sum("n")).first()[0] or 0
            # Buckets with over a share of all rows: ``share`` of them at most.
            hot = F.broadcast(counts.filter(F.col("n") > max(LIMIT, total // share)).select("mask", "value"))
            waiting = members.join(hot, ["mask", "value"], "left_semi").select("print", "mask")
            members = members.join(hot, ["mask", "value"], "left_anti")
        dealt = members.repartition("mask", "value").sortWithinPartitions("mask", "value", "print")
        part = written(dealt.mapInArrow(compare, "print long, root long, mask long"), "simhash-links")
        linked = part.filter("root is not null").select(F.col("print").alias("row"), F.col("root").alias("leader"))
        found = linked if found is None else found.union(linked)
        if last:
            break
        # A fingerprint may wait in several buckets; deeper masks of unlike parents can be alike, so rows are made distinct.
        todo = written(part.filter("root is null").select("print", "mask").union(waiting).distinct(), "simhash-todo")
        if todo.isEmpty():
            break
        parents = now
    return found.distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows = written(fingerprints(docs), "simhash-rows")
        prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-prints")
        total = prints.agg(F.sum("n")).first()[0] or 0
        edges = written(links(prints.select("print")), "simhash-edges")
        labels = components(edges).select(F.col("row").alias("print"), "label")
        named = prints.join(labels, "print", "left").select("print", "least", "n", F.coalesce("label", "print").alias("label"))
        named = written(named, "simhash-named")
        least = named.groupBy("label").agg(F.min("least").alias("component_id"))
        found = written(named.join(least, "label").select("print", "n", "component_id"), "simhash-components")
        scratch.keep(rows, found)
    # Fingerprints of over a thousandth of the rows (a thousand at most) are looked up in place, the others by a shuffle.
    many = F.col("n") > total // SHARE
    hot = F.broadcast(found.filter(many).select("print", "component_id"))
    at_once = rows.join(hot, "print")
    others = rows.join(hot, "print", "left_anti").join(found.filter(~many).select("print", "component_id"), "print")
    return at_once.unionByName(others).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
