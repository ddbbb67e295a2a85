r"""Exact deduplication with an extendible-hash index on shared files.

Three tables under one shared folder make the index:

* ``heap``: every row of the input with its key (a 64-bit hash of the normalised
  text), a row number, and the row number of its *entry*, the first row of the
  same task with the same normalised bytes. Copies within a task share an entry,
  so a text that a third of all rows repeat is one entry a task.
* the directory: a row for each bucket, with the leading key bits it holds and its
  owner. A bucket over its bytes doubles the directory below it until it fits or
  holds one key only. Tasks decide this, each for one overfull bucket; the
  directory has a row for some MB of text and stays a table.
* ``pages``: entries by bucket. An owner task has the buckets of one key range in
  key order, chains entries of equal keys and compares their bytes; entries of
  equal bytes get the same variant number.

Texts are equal when identical after deleting every character of
``[\x20\x09-\x0D]``. Of equal texts the one with the most code points stays,
then the smallest doc_id, then the first row.

Defined cases: a null text counts as empty, and empty texts are equal; of
repeated rows exactly one stays; a null doc_id comes after all others; an empty
table gives an empty result; other columns are ignored by :func:`groups` and
kept by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.workspace import Scratch, hold, written

SPACES = b" \t\n\x0b\x0c\r"
HEAP = (("_tw_row", T.LongType()), ("_tw_entry", T.LongType()), ("_tw_key", T.LongType()), ("_tw_chars", T.LongType()), ("_tw_bytes", T.LongType()), ("_tw_sha", T.StringType()))
#: Bits by which an overfull part of the directory grows at a time, and the entries that never split a bucket.
STEP, FEW = 6, 16
#: The most leading bits that a bucket is told by.
MOST = 48


def heap(docs: DataFrame, key_bits: int = 64, held_bytes: int = 64 << 20) -> DataFrame:
    """The input's rows with their keys; tasks keep ``held_bytes`` of texts at most to find their own copies."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in HEAP)])
    place = docs.columns.index("text")
    drop = 64 - key_bits

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("exact")
        row, held, seen = TaskContext.get().partitionId() << 40, 0, {}
        for batch in batches:
            texts = batch.column(place)
            out: list[tuple] = []
            for text in texts.cast(pa.binary()).to_pylist():
                norm = (text or b"").translate(None, SPACES)
                key = xxhash.xxh3_64_intdigest(norm) >> drop << drop
                chain = seen.setdefault(key, [])
                entry = next((e for e, other in chain if other == norm), None)
                if entry is None:
                    if held > held_bytes:
                        seen, held = {}, 0
                        chain = seen.setdefault(key, [])
                    entry = row
                    chain.append((entry, norm))
                    held += len(norm) + 200
                out.append((row, entry, key - (1 << 64) if key >> 63 else key, len(norm), hashlib.sha256(norm).hexdigest()))
                row += 1
            rows, entries, keys, sizes, digests = zip(*out) if out else ((),) * 5
            chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.int64()), pa.array(entries, pa.int64()), pa.array(keys, pa.int64()), chars, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=[*batch.schema.names, *(n for n, _ in HEAP)],
            )

    return docs.mapInArrow(keyed, schema)


def _prefix(bits: int) -> F.Column:
    return F.shiftrightunsigned("_tw_key", 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """depth and prefix (of so many leading key bits) of every bucket that holds entries.

    ``entries``: _tw_key and _tw_bytes. In each round the directory doubles
    ``STEP`` times below overfull buckets: entries are counted by prefix, and the
    counts add up to those of every bucket between. A bucket fits if it has
    ``capacity`` bytes, one key, or ``FEW`` entries at most, so long texts do not
    deepen the directory beyond the row count's logarithm; the largest ones that
    fit are the round's buckets.
    """
    found, full, depth = None, None, 0
    while True:
        deeper = min(depth + STEP, MOST)
        counts = entries.groupBy(_prefix(deeper).alias("prefix")).agg(F.sum("_tw_bytes").alias("n"), F.count("*").alias("entries"), (F.min("_tw_key") == F.max("_tw_key")).alias("single"))
        if full is not None:
            over = full.select(F.col("prefix").alias("over"))
            counts = counts.join(over, F.shiftright("prefix", deeper - depth) == F.col("over"), "left_semi")
        spread = counts.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deeper)))).withColumn("prefix", F.expr(f"shiftright(prefix, {deeper} - depth)"))
        buckets = spread.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"), ((F.count("*") == 1) & F.bool_and("single")).alias("single"))
        fits = (F.col("n") <= capacity) | (F.col("entries") <= FEW) | F.col("single") | (F.col("depth") == MOST)
        buckets = written(buckets.select("depth", "prefix", fits.alias("fits")), "dedup-directory")
        above = buckets.filter("fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        inner = buckets.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left_anti")
        leaves = inner.filter("fits").select("depth", "prefix")
        found = leaves if found is None else found.union(leaves)
        full, depth = inner.filter(~F.col("fits") & (F.col("depth") == deeper)), deeper
        if deeper == MOST or full.isEmpty():
            return found


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of entries that come in key order, by comparing bytes along each chain."""
    current, chain = None, []
    for batch in batches:
        buckets, keys, entries = (batch.column(i).to_pylist() for i in range(3))
        variants = []
        for key, text in zip(keys, batch.column(3).cast(pa.binary()).to_pylist()):
            norm = (text or b"").translate(None, SPACES)
            if key != current:
                current, chain = key, []
            variant = next((k for k, other in enumerate(chain) if other == norm), len(chain))
            if variant == len(chain):
                chain.append(norm)
            variants.append(variant)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array(keys, pa.int64()), pa.array(entries, pa.int64()), pa.array(variants, pa.int32())],
            names=["_tw_bucket", "_tw_key", "_tw_entry", "_tw_variant"],
        )


def index(docs: DataFrame, key_bits: int = 64, bucket_bytes: int = 32 << 20, owner_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """The heap and the pages of the index over ``docs``, both written.

    A bucket holds ``bucket_bytes`` of normalised text at most and an owner task
    about ``owner_bytes``, whatever the corpus size; small corpora get as many
    owners as the session has cores.
    """
    spark = docs.sparkSession
    rows = written(heap(docs, key_bits), "dedup-heap", compression="zstd")
    entries = rows.filter("_tw_entry = _tw_row")
    narrow = entries.select("_tw_key", "_tw_bytes")
    total = narrow.agg(F.sum("_tw_bytes")).first()[0] or 0
    owners = max(-(-total // owner_bytes), spark.sparkContext.defaultParallelism)
    leaves = directory(narrow, max(min(bucket_bytes, total // (4 * owners)), 1))
    # Buckets are numbered by their first key, so they stand in key order and an owner's buckets are one key range.
    first = F.expr(f"shiftleft(prefix, {MOST} - depth)")
    owner = F.least(F.floor(first / float(1 << MOST) * owners), F.lit(owners - 1)).cast("int")
    places = written(leaves.select(F.struct("depth", "prefix").alias("_tw_at"), (first * 64 + F.col("depth")).alias("_tw_bucket"), owner.alias("_tw_owner")), "dedup-places")
    depths = sorted(r[0] for r in places.select("_tw_at.depth").distinct().collect())  # MOST numbers at most
    if places.count() <= 1 << 20:  # 40 bytes a row
        places = F.broadcast(places)
    # An entry lies in one bucket of one of the depths.
    at = [F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths] or [F.lit(None).cast("struct<depth:int,prefix:bigint>")]
    routed = entries.withColumn("_tw_at", F.explode(F.array(*at))).join(places, "_tw_at").select("_tw_owner", "_tw_bucket", "_tw_key", "_tw_entry", "text")
    owned = routed.repartitionById(owners, "_tw_owner").sortWithinPartitions("_tw_bucket", "_tw_key").select("_tw_bucket", "_tw_key", "_tw_entry", "text")
    pages = owned.mapInArrow(_chained, "_tw_bucket long, _tw_key long, _tw_entry long, _tw_variant int")
    return rows, written(pages, "dedup-pages")


def _verdicts(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (row, doc_id, class) and classes (the row that stays, the size)."""
    own = ["_tw_key", "_tw_variant"]
    members = rows.select("doc_id", "_tw_row", "_tw_entry", "_tw_chars", "_tw_sha").join(pages.select("_tw_entry", *own), "_tw_entry")
    members = written(members.drop("_tw_entry"), "dedup-members")
    order = F.struct((-F.col("_tw_chars")).alias("chars"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_tw_row").alias("row"))
    classes = members.groupBy(*own).agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return members, classes.select(*own, F.col("best.id").alias("keep_id"), F.col("best.row").alias("_tw_keep"), "group_size")


def groups(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    with Scratch(docs.sparkSession) as scratch:
        members, classes = _verdicts(*index(docs.select("doc_id", "text"), key_bits))
        scratch.keep(members)
    joined = members.join(classes, ["_tw_key", "_tw_variant"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("_tw_row") == F.col("_tw_keep")).alias("kept"), F.col("_tw_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("own"))
    with Scratch(docs.sparkSession) as scratch:
        rows, pages = index(inner, key_bits)
        _, classes = _verdicts(rows, pages)
        kept = rows.join(classes.select(F.col("_tw_keep").alias("_tw_row")), "_tw_row", "left_semi")
        # The heap holds every row, so what stays is written and the heap goes.
        out = written(kept.select("doc_id", "text", "own"), "dedup-kept", compression="zstd")
        scratch.keep(out)
    return out.select(*[F.col("own")[c].alias(c) if c in others else F.col(c) for c in docs.columns])
