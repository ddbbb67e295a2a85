"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is
encoded from its words and byte trigrams (signed sums in hashed slots) and from
its shape (shares of byte classes, line ends, repeated and distinct words, word
lengths), gated attention weighs the passages, and the weighted representation is
scored. Only documents have labels; which passages matter is learnt. Training
runs on the driver over a sample of at most ``sample`` labelled documents, chosen
by hash; a document of more than ``BAG`` passages trains with means of
neighbouring ones, so the sample is bounded in bytes too. Scoring reads every
passage, in one pass without a shuffle.

Defined cases: a null or empty text is one empty passage; labels that are null,
or that belong to no document, are not used; without any labels, or with labels of
one kind only, every score is that share of good ones (0.5 without any); repeated
rows score alike; an empty table gives an empty result; other columns are never
read for a score and are kept by :func:`scored`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.word_tokens import _Memo
from tidewright.llm.workspace import hold

PASSAGE = 64
SAMPLE = 4000
ACCEPT = 0.3
#: Hashed slots of words and of byte trigrams, and the passages that a training bag has at most.
SLOTS, BAG = 64, 64
SHAPE = ("capitals", "symbols", "bars", "marks", "digits", "accents", "stops", "lines", "word_length", "distinct", "repeated", "length")


def _byte_kinds() -> np.ndarray:
    """A class for each byte: other, space, lower, upper, digit, symbol, bar, mark, stop, accented letter, later byte, line end."""
    kinds = np.zeros(256, np.uint8)
    for kind, members in enumerate((b" \t\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"#*$%&<>@^~=_\\", b"|", b"!?", b".,;:", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)), b"\n"), 1):
        kinds[list(members)] = kind
    return kinds


KINDS, N_KINDS = _byte_kinds(), 12
FEATURES = len(SHAPE) + 2 * SLOTS


@lru_cache(maxsize=1)
def _word_slots() -> _Memo:
    """Slot and sign of a word: the sign is the number's lowest bit."""
    return _Memo(lambda word: xxhash.xxh3_64_intdigest(word.lower()) % (2 * SLOTS), 200_000)


def passages(text: bytes) -> np.ndarray:
    """Features of each passage of one text."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES))
    n = -(-len(words) // PASSAGE)
    kinds = KINDS[np.frombuffer(text, np.uint8)]
    blank = (kinds == 1) | (kinds == 11)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    cuts = begins[::PASSAGE]
    owner = np.zeros(len(kinds), np.int64)
    owner[cuts[1:]] = 1
    owner = owner.cumsum()
    c = np.bincount(owner * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    letters, chars = np.maximum(c[:, 2] + c[:, 3] + c[:, 9], 1), np.maximum(c.sum(axis=1) - c[:, 10] - c[:, 1] - c[:, 11], 1)
    size = np.full(n, PASSAGE)
    size[-1] = len(words) - PASSAGE * (n - 1)
    same = np.fromiter(map(eq, words[1:], words), bool, len(words) - 1)
    repeated = np.bincount(np.arange(1, len(words)) // PASSAGE, weights=same, minlength=n)
    distinct = np.array([len(set(words[k : k + PASSAGE])) for k in range(0, len(words), PASSAGE)])
    shape = [c[:, 3] / letters, c[:, 5] / chars, c[:, 6] / size, c[:, 7] / chars, c[:, 4] / chars, c[:, 9] / letters, c[:, 8] / size, c[:, 11] / size, chars / size / 8, distinct / size, repeated / size, np.log1p(size) / 4]
    slots = np.fromiter(map(_word_slots().__getitem__, words), np.int64, len(words))
    said = _signed(np.arange(len(words)) // PASSAGE, slots, n) / np.sqrt(size)[:, None]
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams = (raw[:-2] * 65_536 + raw[1:-1] * 256 + raw[2:]) * np.uint32(2_654_435_761) >> np.uint32(25)
    spelt = _signed(owner[:-2], grams.astype(np.int64), n) / np.sqrt(chars)[:, None]
    return np.column_stack([*shape, said, spelt])


def _signed(owner: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """Signed counts of ``SLOTS`` slots for each of ``n`` owners; slots are numbers below ``2 * SLOTS``."""
    counts = np.bincount(owner * (2 * SLOTS) + slots, minlength=n * 2 * SLOTS).reshape(n, SLOTS, 2)
    return counts[:, :, 0] - counts[:, :, 1]


@dataclass
class Model:
    """Encoder, gated attention and score of a bag of passages."""

    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the bags that begin at ``starts``."""
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return _forward(self.weights, (x - self.center) / self.scale, starts)[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> tuple:
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["encode"] + w["encode_0"])
    t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    logits = (t * s) @ w["attend"]
    a = np.exp(logits - np.maximum.reduceat(logits, starts)[owner])
    a /= np.add.reduceat(a, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ w["score"] + w["score_0"]), owner, h, t, s, a, z


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the bags that begin at ``starts``, and its gradient."""
    p, owner, h, t, s, a, z = _forward(w, x, starts)
    loss = -float(np.mean(np.log(np.where(y > 0.5, p, 1 - p) + 1e-12)))
    d = (p - y) / len(y)
    dz = d[:, None] * w["score"]
    da = (dz[owner] * h).sum(axis=1)
    dl = a * (da - np.add.reduceat(a * da, starts)[owner])
    dt, ds = dl[:, None] * w["attend"] * s * (1 - t**2), dl[:, None] * w["attend"] * t * s * (1 - s)
    dh = (a[:, None] * dz[owner] + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - h**2)
    return loss, {"encode": x.T @ dh, "encode_0": dh.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ ds, "attend": (t * s).T @ dl, "score": z.T @ d, "score_0": d.sum()}


def _initial(features: int, hidden: int, gate: int, share: float, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda a, *b: rng.normal(0, a**-0.5, (a, *b))
    return {"encode": draw(features, hidden), "encode_0": np.zeros(hidden), "tanh": draw(hidden, gate), "gate": draw(hidden, gate), "attend": draw(gate), "score": draw(hidden), "score_0": np.array(np.log(share / (1 - share)))}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 600, batch: int = 256, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Model:
    """Learn from whole bags by Adam on the cross entropy of batches of bags, with a falling rate."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate(bags)
    center, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    bags = [np.clip((b - center) / scale, -20, 20) for b in bags]
    rng = np.random.default_rng(seed)
    w = _initial(x.shape[1], hidden, gate, y.mean(), seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(y)):
            order = np.concatenate([order, rng.permutation(len(y))])
        own, order = order[:batch], order[batch:]
        starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])[:-1]]).astype(np.int64)
        _, grad = gradients(w, np.concatenate([bags[i] for i in own]), starts, y[own])
        pace = rate * (1 - 0.9 * step / steps)
        for k in w:
            g = grad[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(center, scale, w)


def bag(text: bytes) -> np.ndarray:
    """Passages of a training text, means of neighbouring ones where there are more than ``BAG``."""
    whole = passages(text)
    if len(whole) <= BAG:
        return whole
    starts = np.arange(BAG) * len(whole) // BAG
    return np.add.reduceat(whole, starts, axis=0) / np.diff(np.append(starts, len(whole)))[:, None]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` pairs of numbers.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(x or b"").astype("<f4").tobytes() for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    rows = sorted(joined.mapInArrow(encode, "doc_id long, quality int, bag binary").collect())
    return fit([np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES).astype(float) for r in rows], np.array([r["quality"] for r in rows]))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1, higher is better)."""
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality", _word_slots.cache_clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [passages(x or b"") for x in part.column(place).cast(pa.binary()).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
                x = np.concatenate(bags).astype("<f4").astype(float)
                scores = model.score(np.clip(x, model.center - 20 * model.scale, model.center + 20 * model.scale), starts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    own = docs.select("doc_id", "text")
    rows = scored(own, train(own, labels, sample))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels, sample), name).filter(F.col(name) >= ACCEPT).select(*docs.columns)
