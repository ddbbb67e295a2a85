"""Cross-section: strata and draws, consolidated scales, normaliser variants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.functions.binning import cumulative, terciles
from tidewright.operators.contracts import many_to_one, require
from tidewright.sources.scratch import folder


def strata(stats: DataFrame) -> DataFrame:
    """Nine cells: tercile of relative tick by tercile of dollar volume, by rank.

    The values are written first. Ranks are joined back by value, and a sum of
    doubles made again may differ in its last digit, which would lose its row.
    """
    path = folder(stats.sparkSession, "strata")
    stats.filter((F.col("relative_tick") > 0) & (F.col("dollar_volume") > 0)).write.parquet(path)
    s = stats.sparkSession.read.parquet(path)
    s = terciles(terciles(s, "relative_tick", "symbol", "tick_tercile"), "dollar_volume", "symbol", "volume_tercile")
    return s.withColumn("cell", F.concat(F.col("tick_tercile"), F.lit("_tick__"), F.col("volume_tercile"), F.lit("_volume")))


def cell_counts(cells: DataFrame, names: int = 12) -> DataFrame:
    n = F.count("*")
    return cells.groupBy("cell").agg(n.alias("available"), F.least(n, F.lit(names)).alias("drawn"))


def draw(cells: DataFrame, names: int = 12, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Names drawn per cell and the cells that are short.

    One generator runs over the cells in label order and draws places among each
    cell's symbols in order; the driver sees the cells' sizes only.
    """
    rng, chosen, short = np.random.default_rng(seed), [], []
    for r in cells.groupBy("cell").agg(F.countDistinct("symbol").alias("n")).orderBy("cell").collect():
        take = min(names, r["n"])
        chosen += [(r["cell"], int(k)) for k in rng.choice(r["n"], size=take, replace=False)]
        if take < names:
            short.append(r["cell"])
    picked = cells.sparkSession.createDataFrame(chosen, "cell string, _place long")
    placed = cumulative(cells.select("cell", "symbol").distinct(), ["symbol"], ["cell"]).withColumnRenamed("_before", "_place")
    return cells.join(placed.join(picked, ["cell", "_place"]).select("cell", "symbol"), ["cell", "symbol"], "left_semi"), short


def daily_stats(daily: DataFrame, least: int = 15) -> DataFrame:
    """Mean close, volume, dollar volume and relative range per symbol with enough days."""
    return daily.groupBy("symbol").agg(
        F.count("*").alias("days"),
        F.avg("close").alias("close"),
        F.avg("volume").alias("volume"),
        F.avg(F.col("close") * F.col("volume")).alias("dollar_volume"),
        F.avg(X.ratio(F.col("high") - F.col("low"), F.col("close")) * 1e4).alias("range_bp"),
    ).filter(F.col("days") >= least).withColumn("relative_tick", X.ratio(F.lit(0.01), F.col("close")))


def regressors(stats: DataFrame) -> DataFrame:
    """Logarithms of relative tick and dollar volume, and the daily range in ticks of 0.01."""
    ticks = F.col("range_bp") / 1e4 * X.ratio(F.col("close"), F.lit(0.01))
    return stats.withColumn("log_relative_tick", X.log(F.col("relative_tick"))).withColumn("log_dollar_volume", X.log(F.col("dollar_volume"))).withColumn("range_ticks", ticks)


def roles(stats: DataFrame, drawn: DataFrame, named: Sequence[str] = ()) -> DataFrame:
    """``role`` of each symbol: stratified where it was drawn, else named where it is on the short list; others go."""
    hit = drawn.select("symbol").distinct().withColumn("_drawn", F.lit(True))
    role = F.when(F.col("_drawn"), "stratified").when(F.col("symbol").isin(list(named)), "named")
    return stats.join(hit, "symbol", "left").withColumn("role", role).filter("role is not null").drop("_drawn")


def first_of_sessions(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row a session of values that are constant within it, with the number of rows."""
    return rows.groupBy(*keys).agg(*[F.any_value(v).alias(v) for v in values], F.count("*").alias("n"))


def consolidated(daily: DataFrame) -> DataFrame:
    """Volume, absolute price (negative marks a quote midpoint) and dollar volume."""
    return daily.withColumn("price_crsp", F.abs("price")).withColumn("price_is_midpoint", F.col("price") < 0).withColumn("volume_crsp", X.number(F.col("volume"))).withColumn("dollar_volume_crsp", F.abs("price") * F.col("volume"))


def compare_volumes(a: DataFrame, b: DataFrame, left: str, right: str, low: float = 0.9, high: float = 1.1) -> tuple[DataFrame, DataFrame]:
    """Ratio of two volumes per symbol (median and tails) and the days outside the limits."""
    both = a.join(b, ["symbol", "date"]).filter((F.col(left) > 0) & (F.col(right) > 0)).withColumn("ratio", F.col(left) / F.col(right))
    per = both.groupBy("symbol").agg(F.count("*").alias("n_days"), F.percentile("ratio", F.lit(0.5)).alias("median"), F.percentile("ratio", F.lit(0.05)).alias("p05"), F.percentile("ratio", F.lit(0.95)).alias("p95"))
    return per, both.filter(~F.col("ratio").between(low, high))


def variants(orders: DataFrame, volumes: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """The same orders under four pairs of volume and volatility, as long rows.

    Every order must have consolidated scales, positive and finite.
    """
    joined = many_to_one(orders, volumes, keys)
    require(joined.filter(~F.coalesce((F.col("volume_crsp") > 0) & (F.col("sigma_crsp") > 0), F.lit(False))), "consolidated scales must be positive")
    venue_q, all_q = F.col("participation"), F.col("Q") / F.col("volume_crsp")
    pairs = [("venue", venue_q, "sigma_d"), ("consolidated_volume", all_q, "sigma_d"), ("consolidated_sigma", venue_q, "sigma_crsp"), ("consolidated_both", all_q, "sigma_crsp")]
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), q.alias("size"), (F.col("impact") / F.col(s)).alias("y")) for n, q, s in pairs]))
    return joined.select(*orders.columns, one.alias("v")).select(*orders.columns, "v.*")


def panels(df: DataFrame, by: str, aggregates: Sequence) -> DataFrame:
    """The pooled panel and one per group in one pass (grouping sets)."""
    return df.groupingSets([[df[by]], []], df[by]).agg(F.grouping(by).alias("_pooled"), *aggregates).withColumn("panel", F.when(F.col("_pooled") == 1, "pooled").otherwise(F.col(by).cast("string"))).drop("_pooled", by)
