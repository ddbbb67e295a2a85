"""Data contracts: each returns the violating rows, ``require`` raises on any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a contract; the message previews the rows."""


def require(violations: DataFrame, what: str) -> None:
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` without a row in ``right``."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def outside(df: DataFrame, domain: Column) -> DataFrame:
    """Rows for which ``domain`` is not true."""
    return df.filter(~F.coalesce(domain, F.lit(False)))


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], covered: bool = True) -> DataFrame:
    """Left join to unique keys; with ``covered`` a row without a match is an error."""
    require(repeated(right, keys), f"keys {list(keys)} are not unique")
    if covered:
        require(uncovered(left, right, keys), f"keys {list(keys)} are not covered")
    return left.join(right, list(keys), "left")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of unique keys with a column that says where a row is from."""
    a, b = left.withColumn("_in_left", F.lit(True)), right.withColumn("_in_right", F.lit(True))
    where = F.when(F.col("_in_left") & F.col("_in_right"), "both").when(F.col("_in_left"), "left_only").otherwise("right_only")
    return a.join(b, list(keys), "full_outer").withColumn("match", where).drop("_in_left", "_in_right")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; empty if equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def differences(made: DataFrame, kept: DataFrame, keys: Sequence[str], relative: float = 1e-8, absolute: float = 1e-10) -> DataFrame:
    """Cells that differ between a rebuilt and a kept table: exact but for floating point."""
    values = [c for c in made.columns if c not in keys]
    joined = made.alias("a").join(kept.alias("b"), list(keys), "full_outer")
    rows = []
    for c in values:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        kind = made.schema[c].dataType.typeName()
        same = x.eqNullSafe(y)
        if kind in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= absolute + relative * F.abs(y), F.lit(False))
        rows.append(F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("made"), y.cast("string").alias("kept"))))
    return joined.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("d")).select(*keys, "d.*")


def conserved(parts: DataFrame, whole: DataFrame, keys: Sequence[str], part: str, total: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose parts do not add up to their total."""
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("parts"))
    return sums.join(whole.select(*keys, total), list(keys), "full_outer").filter(~F.coalesce(F.abs(F.col("parts") - F.col(total)) <= tolerance * F.greatest(F.abs(F.col(total)), F.lit(1.0)), F.lit(False)))
