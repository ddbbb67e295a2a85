r"""Fill-in-the-middle documents by ropes.

A text becomes a rope: leaves of some thousand code points cache how many units
and code points they hold, inner nodes the sums. Two splits at unit ranks cut it
in prefix, middle and suffix; the rearranged subtrees are joined with sentinels,
so only the leaves at the two cuts are copied. :func:`restore` makes a rope of
the output, splits it at the sentinels and joins the parts in their old order.

Units are code points, or the matches of a pattern from left to right, such as
words with the blanks behind them; what no match covers joins the unit before it
(or the first). Cuts and forms come from a hash of seed and doc_id, so a row's
output depends on nothing but the row.

Forms: ``plain`` (the text alone), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle). Empty texts and texts that hold a sentinel stay plain.

Defined cases: a null text counts as empty; a null doc_id hashes like an empty
one; rows that repeat a doc_id get the same ranks, applied to their own text;
a text of one unit has two empty parts; bytes that are no UTF-8 count as one code
point each and come back as they were; very long texts need memory in proportion
to their own length; an empty table gives an empty result. Other columns stay;
those called like an added one (``fim_form``, ``fim_units``,
``fim_prefix_chars``, ``fim_middle_chars``) are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 2048
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = "fim_form string, fim_units long, fim_prefix_chars long, fim_middle_chars long"


class Rope:
    """An immutable rope: a leaf with ``text`` (and the ends of its units), or two subtrees."""

    __slots__ = ("left", "right", "text", "ends", "units", "chars")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.left, self.right, self.text, self.ends = left, right, text, ends
        if left is None:
            self.chars = len(text)
            self.units = self.chars if ends is None else len(ends)
        else:
            self.chars, self.units = left.chars + right.chars, left.units + right.units

    def leaves(self) -> Iterator[str]:
        """The leaves' texts in order."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope()


def join(*parts: Rope) -> Rope:
    """The parts one after another, as a tree over them of least height."""
    held = [x for x in parts if x.chars]
    while len(held) > 1:
        held = [Rope(left=held[k], right=held[k + 1]) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
    return held[0] if held else EMPTY


def rope(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """``text`` in leaves of about ``leaf`` code points, each of whole units."""
    if unit is None:
        return join(*[Rope(text[k : k + leaf]) for k in range(0, len(text), leaf)])
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    ends = [*starts[1:], len(text)] if text else []
    parts, at, first = [], 0, 0
    while first < len(ends):
        # The last unit that ends within the leaf, one unit at least.
        last = max(bisect_left(ends, at + leaf + 1, lo=first), first + 1)
        parts.append(Rope(text[at : ends[last - 1]], [x - at for x in ends[first:last]]))
        at, first = ends[last - 1], last
    return join(*parts)


def split(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units and the rest; shares all subtrees beside the cut."""
    if rank <= 0:
        return EMPTY, node
    if rank >= node.units:
        return node, EMPTY
    if node.left is None:
        if node.ends is None:
            return Rope(node.text[:rank]), Rope(node.text[rank:])
        at = node.ends[rank - 1]
        return Rope(node.text[:at], node.ends[:rank]), Rope(node.text[at:], [x - at for x in node.ends[rank:]])
    if rank < node.left.units:
        a, b = split(node.left, rank)
        return a, join(b, node.right)
    a, b = split(node.right, rank - node.left.units)
    return join(node.left, a), b


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


class Former:
    """Cuts and rearranges single texts."""

    def __init__(self, unit: str | None = None, fim: int = 90, spm: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> None:
        for a in sentinels:
            for b in sentinels:
                if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
        if len(set(sentinels)) < 3:
            raise ValueError("sentinels must differ")
        self.unit = re.compile(unit, re.S) if unit else None
        self.fim, self.spm, self.seed, self.sentinels = fim, spm, seed, sentinels

    def __call__(self, doc_id: int | None, text: str) -> tuple[str, str, int, int | None, int | None]:
        """Output, form, units, and the code points of prefix and middle."""
        whole = rope(text, self.unit)
        n = whole.units
        h = draws(doc_id, self.seed)
        if not text or h[2] % 100 >= self.fim or any(s in text for s in self.sentinels):
            return text, "plain", n, None, None
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        start, suffix = split(whole, high)
        prefix, middle = split(start, low)
        p, s, m = map(Rope, self.sentinels)
        form = "spm" if h[3] % 100 < self.spm else "psm"
        out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
        return str(out), form, n, prefix.chars, middle.chars

    def restore(self, output: str, form: str) -> str:
        """The text that ``output`` was made of."""
        if form == "plain":
            return output
        p, s, m = self.sentinels
        first, second = (s, p) if form == "spm" else (p, s)
        two = output.find(second, len(first))
        three = output.find(m, two + len(second))
        if not output.startswith(first) or two < 0 or three < 0:
            raise ValueError(f"no output of form {form}")
        rest, middle = split(rope(output), three)
        one, other = split(rest, two)
        one, other, middle = (split(x, len(mark))[1] for x, mark in ((one, first), (other, second), (middle, m)))
        return str(join(other, middle, one) if form == "spm" else join(one, middle, other))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts: ``rows`` rows or about ``size`` bytes at most, but one row at least."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        ends = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int((ends[at : at + rows] - before <= size).sum()))
            yield batch.slice(at, n), [(x or b"").decode("utf-8", "surrogateescape") for x in data.slice(at, n).to_pylist()]
            at += n


def _strings(values: list[str]) -> pa.Array:
    return pa.array([x.encode("utf-8", "surrogateescape") for x in values], pa.binary()).view(pa.string())


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    held = dict(zip(batch.schema.names, batch.columns)) | columns
    return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def _schema(docs: DataFrame, added: str = "") -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return f"{own}, {added}" if added else own


def transform(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and more) with outputs as ``text`` and the four added columns; options of :class:`Former`."""
    Former(**options)  # wrong options fail here
    names = [x.split()[0] for x in ADDED.split(", ")]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(**options)
        for batch, found in _slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            output, *rest = zip(*map(former, ids, found))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield _with(batch, {"text": _strings(output)} | {k: pa.array(x, t) for k, x, t in zip(names, rest, types)})

    return docs.mapInArrow(run, _schema(docs, ADDED))


def restore(formed: DataFrame, **options) -> DataFrame:
    """``formed`` (text, fim_form and more) with the old texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(**options)
        for batch, found in _slices(batches):
            forms = batch.column(batch.schema.get_field_index("fim_form")).to_pylist()
            yield _with(batch, {"text": _strings(list(map(former.restore, found, forms)))})

    return formed.mapInArrow(run, _schema(formed))


def digests(docs: DataFrame) -> DataFrame:
    """Form, sizes and digests of each row's output and of the text restored from it."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    formed = transform(docs.select("doc_id", "text")).withColumn("output_sha256", sha)
    return restore(formed).select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        "output_sha256",
        sha.alias("restored_sha256"),
    )
