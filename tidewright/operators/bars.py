"""Time bars, tallies and intraday shapes.

Every function takes the session keys and an explicit order; none relies on row
order. Bars need one shuffle by session and bin, which partial sums precede.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X

SESSION = ("symbol", "dt")


def from_messages(messages: DataFrame, keys: Sequence[str] = SESSION, milliseconds: int = 1000, fill: int = 4) -> DataFrame:
    """Bars of order messages: signed and unsigned fill volume and the last mid.

    A bin exists if it has any message; the mid is carried over bins without one.
    ``direction`` is the resting side.
    """
    m = messages.filter(X.in_regular_hours(F.col("time"))).withColumn("sec", X.bin_start(F.col("time"), milliseconds))
    filled = F.col("event_type") == fill
    bars = m.groupBy(*keys, "sec").agg(
        F.sum(F.when(filled, X.from_resting(F.col("direction")) * F.col("size")).otherwise(0)).cast("double").alias("signed_vol"),
        F.sum(F.when(filled, F.col("size")).otherwise(0)).cast("double").alias("volume"),
        F.max_by("mid", F.when(F.col("mid").isNotNull(), F.col("seq"))).alias("mid"),
    )
    before = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("mid", F.last("mid", ignorenulls=True).over(before))


def from_prints(prints: DataFrame, keys: Sequence[str] = SESSION, width: int = 1) -> DataFrame:
    """Bars of trade prints: volume, signed volume and the last price by (sec, seq)."""
    start = F.floor(F.col("sec") / width) * width
    return prints.withColumn("bar", start.cast("long")).groupBy(*keys, "bar").agg(
        F.sum("size").alias("volume"),
        F.sum(F.col("size") * F.col("sign")).alias("signed_vol"),
        F.max_by("price", F.struct("sec", "seq")).alias("mid"),
    ).withColumnRenamed("bar", "sec")


def directional(bars: DataFrame, keys: Sequence[str] = SESSION, width: int = 30, dominance: float = 0.3) -> DataFrame:
    """Wider bins of bars with first and last mid and a direction (0 if not dominated)."""
    bins = bars.withColumn("bin", (F.floor(F.col("sec") / width) * width).cast("long")).groupBy(*keys, "bin").agg(
        F.sum("signed_vol").alias("signed"),
        F.sum("volume").alias("volume"),
        F.min_by("mid", "sec").alias("mid_first"),
        F.max_by("mid", "sec").alias("mid_last"),
        F.count("*").alias("n"),
    )
    share = X.ratio(F.abs("signed"), F.col("volume"))
    return bins.withColumn("dominance", share).withColumn(
        "direction", F.when((share >= dominance) & (F.col("signed") != 0), F.signum("signed").cast("int")).otherwise(0)
    )


def tally(fills: DataFrame, trades: DataFrame, hidden: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Displayed, hidden and total volume; a trade with a fill of its sequence counts once."""
    alone = trades.join(fills.select(*keys, "sequence"), [*keys, "sequence"], "left_anti")
    parts = (
        fills.select(*keys, F.col("size").alias("displayed"), F.lit(0).alias("hidden"), F.lit(0).alias("unmatched"))
        .unionByName(alone.select(*keys, F.lit(0).alias("displayed"), F.lit(0).alias("hidden"), F.col("size").alias("unmatched")))
        .unionByName(hidden.select(*keys, F.lit(0).alias("displayed"), F.col("size").alias("hidden"), F.lit(0).alias("unmatched")))
    )
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("displayed", "hidden", "unmatched")])
    return sums.withColumn("total", F.col("displayed") + F.col("unmatched"))


def day_volumes(prints: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Regular-hours and full-day volume in one pass."""
    regular = X.in_regular_hours(F.col("sec"))
    return prints.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(regular, F.col("size"))), F.lit(0.0)).alias("rth_volume"), F.sum("size").alias("day_volume")
    )


def closes(prints: DataFrame, keys: Sequence[str] = SESSION, width: int = 300, origin: int = X.OPEN) -> DataFrame:
    """Last price of each bin that has one, and its log return over the bin before it."""
    bins = prints.withColumn("bin", X.grid(F.col("sec"), width, origin)).groupBy(*keys, "bin").agg(F.max_by("price", F.struct("sec", "seq")).alias("close"))
    return bins.withColumn("ret", X.log_return(F.col("close"), Window.partitionBy(*keys).orderBy("bin")))


def realised_volatility(prints: DataFrame, keys: Sequence[str] = SESSION, width: int = 300, bins: int = 78, least: int = 10) -> DataFrame:
    """Sample spread of bin returns, scaled to a session; NULL under ``least`` bins."""
    out = closes(prints, keys, width).groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("sd"))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("sd") * F.sqrt(F.lit(float(bins)))).alias("sigma"))


def shape_from_prints(prints: DataFrame, keys: Sequence[str] = SESSION, width: int = 300, bucket: int = X.HALF_HOUR, least: int = 3, least_bins: int = 10) -> DataFrame:
    """Spread of returns in each bucket over the session's; buckets of 13 half hours."""
    per = closes(prints, keys, width).withColumn("bucket", F.floor(F.col("bin") * width / bucket).cast("long"))
    whole = per.groupBy(*keys).agg(F.count("*").alias("bins"), F.stddev_samp("ret").alias("whole"))
    part = per.filter("ret is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("part"))
    joined = part.join(whole, list(keys)).filter((F.col("bins") >= least_bins) & (F.col("n") >= least) & F.col("bucket").between(0, 12))
    return joined.select(*keys, "bucket", "n", X.ratio(F.col("part"), F.col("whole")).alias("ratio"))


def shape_from_mids(bars: DataFrame, keys: Sequence[str] = SESSION, bucket: int = X.HALF_HOUR) -> DataFrame:
    """Sample spread of returns per bucket over the population spread of the session."""
    r = bars.withColumn("ret", X.log_return(F.col("mid"), Window.partitionBy(*keys).orderBy("sec"))).withColumn("bucket", X.grid(F.col("sec"), bucket))
    whole = r.groupBy(*keys).agg(F.stddev_pop("ret").alias("whole")).filter("whole > 0")
    part = r.filter("ret is not null").groupBy(*keys, "bucket").agg(F.stddev_samp("ret").alias("part"), F.count("*").alias("n"))
    return part.join(whole, list(keys)).select(*keys, "bucket", "n", (F.col("part") / F.col("whole")).alias("ratio"))


def minute_shares(bars: DataFrame, keys: Sequence[str] = SESSION, width: int = 60) -> DataFrame:
    """Share of the session's volume in each slice."""
    per = bars.withColumn("slice", X.grid(F.col("sec"), width)).groupBy(*keys, "slice").agg(F.sum("volume").alias("volume"))
    return per.withColumn("share", X.ratio(F.col("volume"), F.sum("volume").over(Window.partitionBy(*keys))))


def last_per_second(rows: DataFrame, keys: Sequence[str] = SESSION, order: str = "seq") -> DataFrame:
    """The last row of each second."""
    rest = [c for c in rows.columns if c not in (*keys, "sec")]
    last = rows.groupBy(*keys, "sec").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def depth_by_minute(ladder: DataFrame, sizes: Column, keys: Sequence[str] = SESSION) -> DataFrame:
    """First non-empty size per minute: averaged in a session, then across sessions."""
    one = ladder.withColumn("minute", X.grid(F.col("sec"), 60)).withColumn("depth", X.first_depth(sizes))
    return one.groupBy(*keys, "minute").agg(F.avg("depth").alias("depth")).groupBy("minute").agg(F.avg("depth").alias("depth"))
