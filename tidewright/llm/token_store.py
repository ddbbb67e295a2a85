"""Token ids in ORC files, in ascending doc_id order.

Documents are dealt out by doc_id range, sorted and encoded, and each range is
one ORC file: ids are integer lists (run-length encoded by the format), stripes
can be read in parallel, row indexes and Bloom filters on doc_id let a lookup
skip stripes and row groups. A row knows its place within its file; a file's
place follows from the files' totals, one number a file. Both ways, Python workers
get batches of about 2 MB, so their memory and that of the JVM's buffers does not
follow the length of texts, but for a single long one.

Defined cases: a null text counts as empty and holds the end id alone; repeated
doc_ids stay side by side in one file (their order is free); a null doc_id comes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.word_tokens import END, texts, word_encoder
from tidewright.llm.workspace import small_batches, written

SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"
NAMES = ["part", "doc_id", "start_in_part", "n_tokens", "ids"]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, stripe_bytes: int = 16 << 20, row_group: int = 1000) -> None:
    """Encode every text, append id 1 and write the ORC files."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for ids, found in texts(batches):
            data = [x + END for x in encode.many(found)]
            n = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
            ends = n.cumsum()
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()),
                pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(ids, pa.int64()), pa.array(at + ends - n), pa.array(n), lists], names=NAMES
            )
            at += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": str(row_group),
        "orc.stripe.size": str(stripe_bytes),
        "compression": "zstd",
    }
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(encoded, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, the filter being pushed to stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    rows = read_tokens(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = dict(zip((r["part"] for r in totals), accumulate((r["n"] for r in totals), initial=0)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            data = memoryview(lists.flatten().to_numpy(zero_copy_only=False).view("<u4")).cast("B")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = n.cumsum()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
            base = np.array([before[p] for p in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(batch.column(2).to_numpy() + base), pa.array(n), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    with small_batches(spark):
        return written(rows.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-digests")
