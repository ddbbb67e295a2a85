"""Sinks: tables, manifests, and rebuild-and-compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.contracts import differences, require


def rounded(x: Column, digits: int = 6) -> Column:
    """A double at so many significant digits, as text formats would print it."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).cast("double"))


def table(df: DataFrame, path: str, kind: str = "parquet", digits: int | None = None, replace: bool = False, partitions: Sequence[str] = ()) -> None:
    """Write a table. An existing one is left alone unless ``replace``."""
    if digits:
        df = df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite" if replace else "ignore")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.option("header", True).format(kind).save(path)


def report(df: DataFrame, path: str, order: Sequence[str]) -> str:
    """A small report as one byte-exact CSV text, in the given order; returns the text."""
    rows = df.orderBy(*order).collect()
    cell = lambda v: "" if v is None else repr(v) if isinstance(v, float) else str(v)
    text = "\n".join([",".join(df.columns), *(",".join(cell(v) for v in r) for r in rows)]) + "\n"
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return text


def manifest(spark: SparkSession, paths: Sequence[str], block: int = 4 << 20) -> DataFrame:
    """Path, bytes and SHA-256 of every input file; a task holds one block of a file, whatever the file's size. Scans pass empty files over."""
    import hashlib

    import pandas as pd

    # Only names and sizes are read here; the content column is pruned.
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"))

    def digest(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch["path"]:
                store, place = fs.FileSystem.from_uri(path)
                sha = hashlib.sha256()
                with store.open_input_stream(place) as stream:
                    while part := stream.read(block):
                        sha.update(part)
                out.append(sha.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["bytes"], "sha256": out})

    # A file's content is one task's work, so files are dealt out one by one.
    tasks = spark.sparkContext.defaultParallelism
    return files.repartition(4 * tasks, "path").mapInPandas(digest, "path string, bytes long, sha256 string")


def check(made: DataFrame, kept: DataFrame, keys: Sequence[str], relative: float = 1e-8, absolute: float = 1e-10) -> None:
    """Raise if a rebuilt table differs from the kept one."""
    require(differences(made, kept, keys, relative, absolute), "the rebuilt table differs")
