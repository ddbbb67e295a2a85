"""Quantile bins, ranks and tie-safe deciles as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import folder


def cumulative(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of ``order`` with their count ``_n``, the rows ``_before`` them and ``_all`` rows, within ``by``.

    Counts are sorted by range over all tasks, and each task's counts are offset by
    those of the tasks before it; so no group meets in one task. The sorted counts
    are written, as both readers must see the same ranges.
    """
    spark, keys = df.sparkSession, [*by, *order]
    path = folder(spark, "ranks")
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    counted.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    group = list(by) or [F.lit(0)]
    # One row a task and group.
    part = placed.groupBy(*by, "_p").agg(F.sum("_n").alias("_part"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_p", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_offset"), F.sum("_part").over(Window.partitionBy(*group)).alias("_all"))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(part, [*by, "_p"])
    return rows.select(*keys, "_n", (F.col("_offset") + F.col("_inside")).alias("_before"), "_all")


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with each row's place ``_row`` (from 0) among the ``_rows`` rows of its group, whose ``order`` must tell rows apart.

    Rows are dealt out by range and written; a task numbers its own part of a
    group, offset by the parts before it, so no group meets in one task.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "places")
    df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n"))  # one row a task and group
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select(*by, "_p", before.alias("_offset"), F.sum("_n").over(whole).alias("_rows"))
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(part, [*by, "_p"]).withColumn("_row", F.col("_offset") + F.col("_inside")).drop("_inside", "_offset", "_p")


#: Cells an octave of a value in the first pass over it, and parts that the second cuts a cell in.
OCTAVE, PARTS = 64, 4096
_TINY, _HUGE = 2.0**-40, 2.0**980


def _octave(v: Column) -> Column:
    """Cell of a double: its octave's part, monotone in the value; some 130,000 cells hold all doubles."""
    size = F.floor(OCTAVE * F.log2(F.greatest(F.abs(v) / _TINY, F.lit(1.0)))).cast("long")
    ends = F.lit(OCTAVE * 2048).cast("long")
    return F.when(F.isnan(v), ends + 1).when(F.abs(v) > _HUGE, F.when(v > 0, ends).otherwise(-ends)).when(v < 0, -size).otherwise(size)


def located(df: DataFrame, value: Column, ranks: Callable[[Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """The distinct values that hold the rows of given ranks (from 0), with their count ``_n``, the rows ``_before`` them and ``_all`` rows.

    ``ranks`` makes an array of ranks of the number of a group's rows. Three passes
    over ``df`` count cells, each a part of the one before: octaves' parts, some
    thousand parts of each of those that hold a rank, then the values of the parts
    that do. Only counts are shuffled, cells without a rank go before the next pass,
    and nothing is written or collected. NaN is greater than all else.
    """
    keys, group = list(by), list(by) or [F.lit(0)]
    small = (lambda t: t) if by else F.broadcast  # without groups: a row or two a rank
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null").withColumn("_c", _octave(F.col("_v")))

    def holding(cells: DataFrame, within: Sequence, order: str) -> DataFrame:
        w = Window.partitionBy(*within)
        before = F.coalesce(F.sum("_n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
        placed = cells.withColumn("_before", before)
        return placed.filter(F.exists(ranks(F.col("_all")), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))

    ends = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = rows.groupBy(*keys, "_c").agg(*ends).withColumn("_before", F.lit(0)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    first = holding(first, group, "_c").select(*keys, "_c", "_lo", "_hi", "_before", "_all")
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.when((F.col("_hi") > F.col("_lo")) & (F.abs("_c") < OCTAVE * 2048), F.least(F.floor(PARTS * share), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("long")
    within = rows.join(small(first), [*keys, "_c"]).withColumn("_d", part)
    second = holding(within.groupBy(*keys, "_c", "_d", "_before", "_all").agg(F.count("*").alias("_n")), [*keys, "_c"], "_d")
    third = within.drop("_before", "_all").join(small(second.drop("_n")), [*keys, "_c", "_d"])
    values = third.groupBy(*keys, "_c", "_d", "_before", "_all", "_v").agg(F.count("*").alias("_n"))
    return holding(values, [*keys, "_c", "_d"], "_v").select(*keys, "_v", "_n", "_before", "_all")


def edges(df: DataFrame, value: Column, bins: int, by: Sequence[str] = (), name: str = "edges") -> DataFrame:
    """Distinct exact quantile edges of ``bins`` equal-count bins, one row a group."""
    cuts, columns = [F.lit(float(x)) for x in np.linspace(0, 1, bins + 1)], []
    ends = lambda n: [f(x * (n - 1)).cast("long") for x in cuts for f in (F.floor, F.ceil)]
    ranked = located(df, value, lambda n: F.array(*ends(n)), by)
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_v")))
    for j, k in enumerate(ends(F.col("_all"))):
        columns.append(at(k).alias(f"_v{j}"))
    found = ranked.groupBy(*by).agg(F.max("_all").alias("_all"), *columns)

    def edge(j: int) -> Column:
        place, lo, hi = cuts[j] * (F.col("_all") - 1), F.col(f"_v{2 * j}"), F.col(f"_v{2 * j + 1}")
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    return found.select(*by, F.array_distinct(F.array(*[edge(j) for j in range(bins + 1)])).alias(name))


def right_closed(value: Column, edge: Column) -> Column:
    """Bin (e_i, e_i+1], the least value in the first bin."""
    return F.greatest(F.size(F.filter(edge, lambda e: e < value)) - 1, F.lit(0))


def left_closed(value: Column, edge: Column) -> Column:
    """Bin [e_i, e_i+1), the last bin closed."""
    return F.least(F.greatest(F.size(F.filter(edge, lambda e: e <= value)) - 1, F.lit(0)), F.size(edge) - 2)


def with_edges(df: DataFrame, value: Column, bins: int, by: Sequence[str] = (), name: str = "edges") -> DataFrame:
    """``df`` with its group's edges; the groups' edges are one small row each."""
    found = edges(df, value, bins, by, name)
    return df.join(found, list(by)) if by else df.crossJoin(F.broadcast(found))  # one row


def qcut_means(df: DataFrame, x: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean of x and y and the count in right-closed equal-count bins of x."""
    binned = with_edges(df, F.col(x), bins, by).withColumn("bin", right_closed(F.col(x), F.col("edges")))
    return binned.groupBy(*by, "bin").agg(F.avg(x).alias(f"mean_{x}"), F.avg(y).alias(f"mean_{y}"), F.count("*").alias("n"))


def log_bins(df: DataFrame, size: str, values: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins of log size: means, count, spread of the first value.

    Rows with a size that is not positive or with any missing value are left out
    together. Logs and edges are compared at 12 decimals, so that interpolation
    in the last place cannot move a tied row across an edge.
    """
    whole = F.col(size) > 0
    for v in values:
        whole = whole & F.col(v).isNotNull() & ~F.isnan(v)
    logged = df.filter(whole).withColumn("log_size", F.round(F.ln(size), 12))
    edged = with_edges(logged, F.col("log_size"), bins, by).withColumn("edges", F.array_distinct(F.transform("edges", lambda e: F.round(e, 12))))
    binned = edged.withColumn("bin", left_closed(F.col("log_size"), F.col("edges")))
    means = [F.avg(v).alias(v) for v in values]
    return binned.groupBy(*by, "bin").agg(F.avg(size).alias(size), F.count("*").alias("n"), *means, F.stddev_samp(values[0]).alias("cost_sd"))


def deciles(df: DataFrame, value: str, key: Column, by: Sequence[str] = (), groups: int = 10) -> DataFrame:
    """``df`` with a ``decile`` by the middle rank of whole tie groups of ``key``, a double.

    A decile starts at the tie group that holds its first rank, or behind it,
    so the tie groups at those ranks decide every row's decile.
    """
    keyed = df.withColumn("_key", key.cast("double")).filter("_key is not null")
    starts = lambda n: F.array(*[F.least(F.floor(n * F.lit(g) / groups), n - 1) for g in range(1, groups)])
    ranked = located(keyed, F.col("_key"), starts, by)
    # The decile of the tie group itself; keys between two such groups belong to the last start before them.
    own = F.floor((2 * F.col("_before") + F.col("_n")) * groups / (2 * F.col("_all"))).cast("long")
    behind = F.floor((2 * (F.col("_before") + F.col("_n")) + 1) * groups / (2 * F.col("_all"))).cast("long")
    marks = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), own.alias("own"), behind.alias("behind")))).alias("_marks"))
    marked = keyed.join(marks, list(by)) if by else keyed.crossJoin(F.broadcast(marks))  # one row a group
    step = lambda found, m: F.when(m["v"] < F.col("_key"), m["behind"]).when(m["v"] == F.col("_key"), m["own"]).otherwise(found)
    return marked.withColumn("decile", F.aggregate("_marks", F.lit(0).cast("long"), step)).drop("_key", "_marks")


def calibration(df: DataFrame, realised: str, predicted: str, key: Column, by: Sequence[str] = (), groups: int = 10) -> DataFrame:
    """Mean predicted and realised, standard error, count and ratio per decile."""
    table = deciles(df.filter(F.col(realised).isNotNull() & F.col(predicted).isNotNull()), predicted, key, by, groups)
    out = table.groupBy(*by, "decile").agg(
        F.avg(predicted).alias("predicted"),
        F.avg(realised).alias("realised"),
        (F.stddev_samp(realised) / F.sqrt(F.count("*"))).alias("realised_se"),
        F.count("*").alias("n"),
    )
    return out.withColumn("ratio", F.col("realised") / F.nullif(F.col("predicted"), F.lit(0.0)))


def terciles(df: DataFrame, value: str, tie: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with low, mid or high by row number; ``tie`` tells equal values apart. ``df`` is read twice and must give the same values."""
    ranked = cumulative(df.select(*by, value, tie), [value, tie], by)
    share = (F.col("_before") + F.col("_n")) / F.col("_all")
    ranked = ranked.withColumn(name, F.when(share <= 1 / 3, "low").when(share <= 2 / 3, "mid").otherwise("high"))
    return df.join(ranked.select(*by, value, tie, name), [*by, value, tie])
