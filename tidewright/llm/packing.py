"""Best-fit packing of documents into fixed-length training sequences.

Vector best-fit: a bin (sequence) has residual capacity in tokens, documents and
attention cost (the sum of squared piece lengths). By default a sequence holds as
many documents as tokens and the cost of one full-length piece, which no set of
pieces exceeds that fits its tokens: both then weigh in the choice of a bin and
never open one. Pieces go in order of
decreasing length to the bin that meets every constraint and scores best, by the
weighted norm of what would remain (``norm``) or the weighted dot product of
demand and residual (``dot``); a new bin opens only when none fits.

A piece's demand follows from its length alone, so bins are chosen for whole
runs of equal pieces: the driver sees the number of pieces of each length (at
most ``tokens`` numbers, whatever the corpus size), keeps runs of identical bins
and writes down which ranks of a length fill which run of bins. The corpus is
read once; each task counts its own ranks, and ranks become global by adding the
counts of earlier tasks.

Defined cases: a null text counts as empty and is one piece holding the end id;
a piece never crosses documents; only documents longer than a sequence are cut;
equal lengths are placed by rank, so repeated rows each get their own place; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.word_tokens import END, texts, word_encoder
from tidewright.llm.workspace import written


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold; None is what its tokens alone allow, infinity is no limit."""

    tokens: int = 4096
    documents: float | None = None
    cost: float | None = None

    def vector(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        return np.array([self.tokens, documents, float(self.tokens) ** 2 if self.cost is None else self.cost], dtype=float)


@dataclass(frozen=True)
class Plan:
    """Rows of a placement: pieces of ``length`` with ranks from ``rank`` on fill bins from ``bin`` on, ``copies`` in each, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each (length, rank)."""
        keys = (self.length << 44) + self.rank
        row = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        past = rank - self.rank[row]
        return self.bin[row] + past // self.copies[row], self.offset[row] + past % self.copies[row] * length


def best_fit(counts: Mapping[int, int], capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> Plan:
    """Place ``counts[length]`` pieces of each length; see the module's text."""
    most, w = capacity.vector(), np.array(weights)
    limited = np.isfinite(most)
    scale = np.where(limited, w / np.where(limited, most, 1.0), 0.0)
    free = np.zeros((1024, 3))  # residuals of runs of identical bins
    first, many = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    runs = bins = 0
    rows: list[tuple[int, int, int, int, int]] = []

    def add(residual: np.ndarray, start: int, count: int) -> None:
        nonlocal free, first, many, runs
        if residual[0] <= 0 or residual[1] < 1 or count == 0:
            return
        gone = np.flatnonzero(many[:runs] == 0)
        if len(gone):
            k = gone[0]
        else:
            if runs == len(many):
                free, first, many = (np.concatenate([x, np.zeros_like(x)]) for x in (free, first, many))
            k, runs = runs, runs + 1
        free[k], first[k], many[k] = residual, start, count

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > most).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            fits = np.flatnonzero((free[:runs] >= need).all(axis=1) & (many[:runs] > 0))
            layer = left
            if len(fits):
                residual = np.where(limited, free[fits], 0.0)
                demand = np.where(limited, need, 0.0) * scale
                if score == "dot":
                    liking = residual * scale @ demand
                    order = np.argsort(-liking, kind="stable")[:2]
                    k = fits[order[0]]
                    # Each piece makes its bin less liked: a bin takes pieces until another one is liked better.
                    if many[k] > 1:
                        layer = 1
                    elif len(order) > 1 and demand @ demand > 0:
                        layer = int((liking[order[0]] - liking[order[1]]) / (demand @ demand)) + 1
                else:
                    # Each piece makes its bin liked better, so it takes all that fit.
                    k = fits[np.argmin(((residual * scale - demand) ** 2).sum(axis=1))]
                room, start, available, old = free[k].copy(), int(first[k]), int(many[k]), True
            else:
                room, start, available, old = most.copy(), bins, left, False
            copies = int(min(np.floor(room[limited] / need[limited]).min(), left, layer))
            used = min(available, left // copies)
            rows.append((length, rank, start, copies, int(capacity.tokens - room[0])))
            if old:
                first[k], many[k] = start + used, available - used
            else:
                bins += used
            add(room - need * copies, start, used)
            left, rank = left - used * copies, rank + used * copies
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(table[:, i]) for i in range(5)), bins)


def pieces(docs: DataFrame, vocabulary: str, tokens: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = word_encoder(vocabulary), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for ids, found in texts(batches):
            out = []
            for doc, data in zip(ids, encode.many(found)):
                data += END
                for k, at in enumerate(range(0, len(data), 4 * tokens)):
                    own = data[at : at + 4 * tokens]
                    length = len(own) // 4
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((doc, k, at // 4, length, zlib.crc32(own), rank))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array([task] * len(out), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, vocabulary, capacity.tokens), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(total, capacity, weights, score)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at, offset = plan.place(length, rank) if batch.num_rows else (length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(at, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
