"""One-sided order runs: gaps and islands over fills and over directional bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators.bars import SESSION, directional


def fill_runs(messages: DataFrame, keys: Sequence[str] = SESSION, fill: int = 4) -> DataFrame:
    """Maximal runs of same-signed fills in message order.

    Other messages do not break a run. ``mid_start`` is the mid of the message
    row before the run's first fill (of the first row, if there is none before).
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    carried = F.last("mid", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    m = messages.withColumn("mid", carried).withColumn("mid_before", F.coalesce(F.lag("mid").over(order), F.col("mid")))
    m = m.filter(F.col("event_type") == fill).withColumn("sign", X.from_resting(F.col("direction")).cast("double"))
    changed = F.coalesce((F.col("sign") != F.lag("sign").over(order)).cast("int"), F.lit(1))
    m = m.withColumn("run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*keys, "run").agg(
        F.min_by("sign", "seq").alias("sign"),
        F.sum("size").cast("double").alias("shares"),
        F.count("*").alias("n_fills"),
        F.min_by("time", "seq").alias("t_start"),
        F.max_by("time", "seq").alias("t_end"),
        F.min_by("mid_before", "seq").alias("mid_start"),
        F.max_by("mid", "seq").alias("mid_end"),
    )


def bin_runs(bins: DataFrame, keys: Sequence[str] = SESSION, width: int = 30) -> DataFrame:
    """Maximal runs of directional bins of one sign; a missing bin ends a run."""
    order = Window.partitionBy(*keys).orderBy("bin")
    changed = (F.col("direction") != F.coalesce(F.lag("direction").over(order), F.lit(0))) | (F.col("bin") - F.coalesce(F.lag("bin").over(order), F.col("bin") - width) != width)
    marked = bins.withColumn("run", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("direction <> 0").groupBy(*keys, "run").agg(
        F.first("direction").alias("sign"),
        F.sum("signed").alias("net"),
        F.sum("volume").alias("gross"),
        F.count("*").alias("n_bins"),
        F.min("bin").alias("bin_start"),
        F.min_by("mid_first", "bin").alias("mid_start"),
        F.max_by("mid_last", "bin").alias("mid_end"),
    )


def bin_metaorders(bars: DataFrame, volumes: DataFrame, keys: Sequence[str] = SESSION, width: int = 30, dominance: float = 0.3, duration: int = 60, size: float = 1e-4) -> DataFrame:
    """Bin runs that last and weigh enough, with participation and log impact.

    ``volumes``: the keys and ``session_volume``.
    """
    runs = bin_runs(directional(bars, keys, width, dominance), keys, width).join(volumes, list(keys))
    runs = runs.withColumn("duration_seconds", F.col("n_bins") * width).withColumn("Q", F.abs("net"))
    runs = runs.withColumn("participation", X.ratio(F.col("Q"), F.col("session_volume")))
    runs = runs.filter((F.col("duration_seconds") >= duration) & (F.col("participation") >= size) & (F.col("mid_start") > 0) & (F.col("mid_end") > 0))
    return runs.withColumn("impact", X.impact_log(F.col("sign"), F.col("mid_start"), F.col("mid_end")))
