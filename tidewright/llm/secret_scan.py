r"""Secret scan with an incremental blob ledger (built-in functions only).

Texts are blobs named by their SHA-256. The ledger is a table of batches; each
row says which rule versions a blob was scanned with and what they found. A scan
groups documents by blob (partially before the shuffle, so a blob with many
copies is one row a task), skips every blob and rule-version pair that the
ledger has, scans the rest once, appends them, and joins the findings back to
every document that holds the blob.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.
Defined cases: a null text counts as empty; an empty text has no findings; a
null doc_id stays null; repeated rows give equal rows; overlapping spans of
different kinds are all kept and are masked together; other columns are ignored
by :meth:`BlobLedger.scan` and kept by :func:`mask`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.workspace import new_folder

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("version", T.StringType())])
BATCH = T.StructType([T.StructField("blob", T.StringType()), T.StructField("versions", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])


@dataclass(frozen=True)
class Rule:
    """A pattern without zero-width matches; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The base kinds, in their order. Runs under the least length are left out of the pattern where
# that cannot move another match (a shorter maximal run has no longer run inside).
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Kinds beyond the base ones.
EXTRA = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


CHUNK, SEGMENT = 64, 1024


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, ``step`` over all numbers before it, from 0 on.

    Chunks are summed up first, so the work grows little faster than the array.
    """

    def chained(start: Column, own: Column) -> Column:
        whole = F.aggregate(own, F.array(start), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))
        return F.slice(whole, F.lit(1), F.size(own))

    def by_chunk(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), step))
        return F.flatten(F.zip_with(chunks, chained(F.lit(0), sums), lambda c, start: chained(start, c)))

    cut = bound(numbers, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), lambda k: F.slice(x, k + 1, F.lit(CHUNK))))
    return F.when(F.size(numbers) > 0, bound(cut, by_chunk)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of spans of one rule.

    The pieces between matches and the matches themselves, in turn, add up to
    the text, so running sums of their lengths are the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = F.zip_with(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x)),
        F.zip_with(whole, checked, lambda a, b: F.struct(F.char_length(a).alias("n"), F.char_length(b).alias("g"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")),
    )

    def placed(found: Column) -> Column:
        starts = before(F.transform(found, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(found, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["n"].alias("n"), x["g"].alias("g")))
        kept = F.filter(spans, lambda x: x["n"].isNotNull() & (x["g"] >= rule.least))
        return F.transform(kept, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), (x["start"] + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))

    none = F.array().cast(T.ArrayType(SPAN))
    return F.when(text.rlike(rule.pattern), bound(lengths, placed).cast(T.ArrayType(SPAN))).otherwise(none)


class BlobLedger:
    """Scan results by content, kept under ``path``; a new folder if none is given."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = BASE + EXTRA) -> None:
        self.spark, self.rules = spark, rules
        self.path = path or new_folder(spark, "blob-ledger")
        self.batches: list[str] = self._found()

    def _found(self) -> list[str]:
        jvm, root = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(s.getPath().toString() for s in fs.listStatus(root) if done(s.getPath())) if fs.exists(root) else []

    def entries(self) -> DataFrame:
        """All batches: blob, versions, spans."""
        reader = self.spark.read.schema(BATCH)
        return reader.parquet(*self.batches) if self.batches else self.spark.createDataFrame([], BATCH)

    def update(self, docs: DataFrame) -> None:
        """Scan the unseen blob and rule-version pairs of ``docs`` and append them."""
        versions = F.array(*[F.lit(r.version) for r in self.rules])
        text = F.coalesce(F.col("text"), F.lit(""))
        blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        if self.batches:
            seen = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
            blobs = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("versions"))
            blobs = blobs.filter(F.size("versions") > 0)
        else:
            blobs = blobs.withColumn("versions", versions)
        none = F.array().cast(T.ArrayType(SPAN))
        spans = [F.when(F.array_contains("versions", r.version), matches(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(self.rules)]
        target = f"{self.path}/batch-{len(self.batches):06d}-{uuid.uuid4().hex[:8]}"
        blobs.select("blob", "versions", F.concat(*spans).cast(T.ArrayType(SPAN)).alias("spans")).write.parquet(target)
        self.batches.append(target)

    def findings(self) -> DataFrame:
        """blob and its spans under the current rules, only for blobs with any."""
        ranks = {r.version: k for k, r in enumerate(self.rules)}
        current = F.array(*[F.lit(v) for v in ranks])
        rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
        own = F.transform(
            F.filter("spans", lambda s: F.array_contains(current, s["version"])),
            lambda s: F.struct(s["start"].alias("start"), F.try_element_at(rank, s["version"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["version"].alias("version")),
        )
        rows = self.entries().filter(F.size("spans") > 0).select("blob", own.alias("spans"))
        # Writers that scan one blob at a time record the same spans; they count once.
        return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))

    def scan(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keys`` (a path, say, and a version of it) and the sorted spans of every row of ``docs``."""
        self.update(docs)
        paths = docs.select(*keys, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
        none = F.array().cast(T.ArrayType(SPAN))
        return paths.join(self.findings(), "blob", "left").select(*keys, F.coalesce("spans", none).alias("spans"))


def grown(docs: DataFrame, path: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scan with the base rules, then with all: the second pass scans what the ledger lacks, the added rules' pairs."""
    first = BlobLedger(docs.sparkSession, path, BASE)
    first.update(docs)
    return BlobLedger(docs.sparkSession, first.path).scan(docs, keys)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what :meth:`BlobLedger.scan` returns."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` (sorted by start) replaced by ``mark``.

    Pieces are cut from segments of the text, not from its start each time.
    """

    def cut(segments: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / SEGMENT).cast("int"), F.floor((end - 1) / SEGMENT).cast("int")
        own = F.array_join(F.slice(segments, first + 1, last - first + 1), "")
        return F.when(end > start, F.substr(own, start % SEGMENT + 1, end - start)).otherwise("")

    def replaced(segments: Column) -> Column:
        reach = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(spans, reach, lambda s, r: F.struct(r.alias("a"), s["start"].alias("b")))
        fresh = F.filter(pieces, lambda x: x["b"] >= x["a"])
        head = F.array_join(F.transform(fresh, lambda x: F.concat(cut(segments, x["a"], x["b"]), F.lit(mark))), "")
        return F.concat(head, cut(segments, F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text)))

    return F.when(F.size(spans) > 0, bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0)), replaced)).otherwise(text)


def mask(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """``docs`` with the secrets of every text masked; texts without any are unchanged.

    ``n_chars``, where present, follows the new text.
    """
    ledger.update(docs)
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = ledger.findings().select(F.col("blob").alias("key"), "spans")
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), blob.alias("blob")).join(found, F.col("blob") == F.col("key"), "left")
    hit, text = F.col("spans").isNotNull(), F.col("own")["text"]
    joined = joined.select("own", hit.alias("hit"), F.when(hit, masked(text, F.col("spans"))).otherwise(text).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own")["n_chars"])
    return joined.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])
