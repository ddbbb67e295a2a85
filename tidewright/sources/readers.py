"""Scans. Schemas are given, not inferred; columns are pruned by what a plan selects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators.contracts import require_columns


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def need(spark: SparkSession, path: str, rebuild: str) -> str:
    """``path``, or an error that says how to make it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; rebuild it with: {rebuild}")
    return path


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """CSV, gzip by extension; ``columns`` are required and selected.

    With a header, columns are found by name; without one, by place.
    """
    if not header:
        df = spark.read.csv(path, schema=schema, header=False, enforceSchema=True)
    else:
        text = spark.read.csv(path, header=True)
        kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        require_columns(text, list(columns))
        df = text.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in text.columns])
    return df.select(*columns) if columns else df


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, columns).select(*columns) if columns else df


def shared(df: DataFrame) -> DataFrame:
    """A scan that several plans read: kept in memory and on executors' disks until ``unpersist``.

    Its lineage stays, so a lost executor costs a recomputation of what it held.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def members(table: DataFrame, at: str) -> DataFrame:
    """Symbols active at a date; the filter reaches the scan."""
    return table.filter(F.col("active") & (F.col("date") == F.lit(at).cast("date"))).select("symbol").distinct()


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def tree(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv", nanos: str | None = None) -> DataFrame:
    """All files below a folder, with their path; nanosecond times also as timestamps."""
    df = spark.read.schema(schema).options(header=True, recursiveFileLookup=True, pathGlobFilter=pattern).csv(path).withColumn("source_file", F.col("_metadata.file_path"))
    return df.withColumn("ts", F.timestamp_micros(F.floor(F.col(nanos) / 1000))) if nanos else df


def session_path(root: str, symbol: str, date: str, schema: str) -> str:
    return f"{root}/symbol={symbol}/date={date}/{schema}"


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Decoded exchange records that an extractor landed as Parquet, of a known schema."""
    want = spark.createDataFrame([], schema).schema
    df = require_columns(spark.read.parquet(path), [f.name for f in want])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in want])


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def appended(table: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``more`` whose keys it lacks; doing it again changes nothing."""
    new = more.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return union([table, new.select(*more.columns)])


def prints(raw: DataFrame) -> DataFrame:
    """Raw trades (ts, price in 1e-9, size, side) as prints with exchange seconds and sign."""
    return raw.select("symbol", F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("date"), X.exchange_second(F.col("ts")).alias("sec"), X.price(F.col("price"), 1e-9).alias("price"), F.col("size").cast("double").alias("size"), X.aggressor_sign(F.col("side")).alias("sign"), "sequence")
