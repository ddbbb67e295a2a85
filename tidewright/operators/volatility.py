"""Trailing scales, execution windows and time-of-day profiles of other sessions."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators.bars import SESSION


def trailing_spread(daily: DataFrame, by: str = "permno", rows: int = 20) -> DataFrame:
    """Spread of the log returns of the ``rows`` days before each day; NULL until there are so many."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-rows, -1)
    r = daily.withColumn("log_ret", F.when(F.col("ret") > -1, F.log1p("ret")))
    return r.withColumn("sigma", F.when(F.count("log_ret").over(w) == rows, F.stddev_samp("log_ret").over(w))).drop("log_ret")


def trailing_volume(daily: DataFrame, by: str = "permno", rows: int = 20) -> DataFrame:
    """Mean volume and spread of close-to-close returns over the last ``rows`` days before each day."""
    order = Window.partitionBy(by).orderBy("date")
    r = daily.withColumn("change", X.log_return(F.col("close"), order))
    return r.withColumn("adv", F.avg("volume").over(order.rowsBetween(-rows, -1))).withColumn("sigma_d", F.stddev_samp("change").over(order.rowsBetween(-(rows - 1), -1))).drop("change")


def trailing_sigma(bars: DataFrame, orders: DataFrame, keys: Sequence[str] = SESSION, window: int = 1800, seconds: int = 23_400, subset: str | None = None) -> DataFrame:
    """Realised volatility of the ``window`` seconds before each order's ``at``.

    Time is cut in blocks of ``window`` seconds, so a window is the end of one block
    and the start of the next: two running sums over bars and asked seconds, whose
    work does not grow with the rows in a window. No sum is a difference of others.
    An order without a usable window gets the median of its own batch: of
    ``keys`` and, if given, ``subset`` (such as train or test).
    """
    r = bars.withColumn("_sq", F.coalesce(F.pow(X.log_return(F.col("mid"), Window.partitionBy(*keys).orderBy("sec")), F.lit(2)), F.lit(0.0)))
    r = r.select(*keys, F.col("sec").cast("long").alias("_t"), "_sq", F.lit(None).cast("long").alias("at"))
    name = F.col(subset).cast("string") if subset else F.lit("")
    o = orders.select(*keys, F.col("order_id").cast("long").alias("order_id"), name.alias("subset"), F.col("at").cast("long").alias("at"))
    asked = o.filter("at is not null").select(*keys, "at").distinct()
    asked = asked.select(*keys, F.explode(F.array(F.col("at") - window, F.col("at"))).alias("_t"), F.lit(None).cast("double").alias("_sq"), "at")
    block = [*keys, F.floor(F.col("_t") / window)]
    upto = Window.partitionBy(*block).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    since = Window.partitionBy(*block).orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    side = lambda f: F.when(F.col("_t") == F.col("at"), f("_sq").over(upto)).otherwise(f("_sq").over(since))
    ends = r.unionByName(asked).select(*keys, "at", side(F.sum).alias("_sum"), side(F.count).alias("_n")).filter("at is not null")
    found = ends.groupBy(*keys, "at").agg((F.sum("_sum") / F.greatest(F.sum("_n"), F.lit(1))).alias("_variance"))
    raw = o.join(found, [*keys, "at"], "left").withColumn("raw", F.sqrt(F.coalesce("_variance", F.lit(0.0)) * seconds))
    usable = F.when(F.col("raw") > 0, F.col("raw"))
    middle = raw.groupBy(*keys, "subset").agg(F.median(usable).alias("_middle"))
    return raw.join(middle, [*keys, "subset"]).select(*keys, "order_id", "subset", "at", F.coalesce(usable, "_middle").alias("sigma"))


def execution_rate(bars: DataFrame, orders: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Shares over the volume traded in the seconds the order spans, within [1e-6, 1].

    Prefix sums at the two ends replace a range join.
    """
    ticks = bars.select(*keys, F.col("sec").alias("at"), F.lit(0).alias("kind"), F.coalesce("volume", F.lit(0.0)).alias("v"), F.lit(None).cast("long").alias("order_id"))
    ends = orders.select(*keys, F.explode(F.array(F.struct(F.floor("t_start").alias("at"), F.lit(-1).alias("kind")), F.struct(F.floor("t_end").alias("at"), F.lit(1).alias("kind")))).alias("e"), "order_id")
    ends = ends.select(*keys, F.col("e.at").alias("at"), F.col("e.kind").alias("kind"), F.lit(0.0).alias("v"), F.col("order_id").cast("long").alias("order_id"))
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = ticks.unionByName(ends).withColumn("cum", F.sum("v").over(order)).filter("order_id is not null")
    traded = summed.groupBy(*keys, "order_id").agg(F.sum(F.col("cum") * F.col("kind")).alias("traded"))
    return orders.join(traded, [*keys, "order_id"]).withColumn("rate", X.clipped_rate(F.col("shares"), F.col("traded")))


def donor_profile(shapes: DataFrame, kind: str = "loso", value: str = "ratio", bucket: str = "bucket", keys: Sequence[str] = SESSION) -> DataFrame:
    """Median over other sessions of the same symbol, per session and bucket.

    ``loso``: all other sessions; ``prior``: earlier ones only, so a symbol's
    first session has no rows. Keys are (symbol, date). A symbol's bucket is one
    group, as long as the symbol has days: its values are sorted once, and every
    session's median is read off the ranks, so donors are never paired up.
    ``donors`` counts sessions with a row, also one without a value.
    """
    import pandas as pd

    symbol, date = keys
    kinds = dict(shapes.dtypes)
    mine = shapes.select(symbol, date).distinct()
    own = shapes.groupBy(symbol, date, bucket).agg(F.first(value).cast("double").alias("_value"), F.lit(True).alias("_held"))
    # As large as the result: every session with every bucket of its symbol.
    grid = mine.join(shapes.select(symbol, bucket).distinct(), symbol).join(own, [symbol, date, bucket], "left")

    def medians(key, rows):
        rows = rows.sort_values(date)
        values, held = rows["_value"].to_numpy(float), rows["_held"].notna().to_numpy()
        found, donors = (left_out if kind == "loso" else earlier)(values), (held.sum() - held if kind == "loso" else np.cumsum(held) - held)
        out = pd.DataFrame({symbol: rows[symbol], date: rows[date], bucket: rows[bucket], "multiplier": found, "donors": donors.astype("int64")})
        return out[donors > 0]

    return grid.groupBy(symbol, bucket).applyInPandas(medians, f"{symbol} {kinds[symbol]}, {date} {kinds[date]}, {bucket} {kinds[bucket]}, multiplier double, donors long")


def left_out(values: np.ndarray) -> np.ndarray:
    """For each place the median of the values at all others; NaN is no value."""
    own = np.flatnonzero(np.isfinite(values))
    order = np.sort(values[own])
    n, out = len(order), np.full(len(values), np.median(order) if len(order) else np.nan)
    if n:
        rank = np.empty(n, int)
        rank[np.argsort(values[own], kind="stable")] = np.arange(n)
        # Without rank r, the i-th of the rest is the i-th or, from r on, the next one.
        at = lambda i: order[np.minimum(i + (i >= rank), n - 1)]
        rest = n - 1
        out[own] = 0.5 * (at(np.full(n, (rest - 1) // 2)) + at(np.full(n, rest // 2))) if rest else np.nan
    return out


def earlier(values: np.ndarray) -> np.ndarray:
    """For each place the median of the values before it; NaN is no value."""
    held: list[float] = []
    out = np.full(len(values), np.nan)
    for k, v in enumerate(values.tolist()):
        n = len(held)
        if n:
            out[k] = 0.5 * (held[(n - 1) // 2] + held[n // 2])
        if np.isfinite(v):
            insort(held, v)
    return out


def donor_shares(volumes: DataFrame, kind: str = "prior", value: str = "volume", bucket: str = "bucket", keys: Sequence[str] = SESSION) -> DataFrame:
    """Volume shape of a session from its donors: their median share in each bucket, brought to a sum of one."""
    own = volumes.withColumn("share", X.ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))
    shape = donor_profile(own, kind, "share", bucket, keys)
    return shape.withColumn("share", X.ratio(F.col("multiplier"), F.sum("multiplier").over(Window.partitionBy(*keys)))).drop("multiplier")


def profile_sigma(orders: DataFrame, profile: DataFrame, sigma: str = "sigma_d", keys: Sequence[str] = SESSION, bucket: int = X.HALF_HOUR) -> DataFrame:
    """Daily volatility times the half hour's multiplier, 1 where there is none."""
    o = orders.withColumn("bucket", X.grid(F.col("at"), bucket))
    joined = o.join(profile.select(*keys, "bucket", "multiplier"), [*keys, "bucket"], "left")
    usable = F.when(F.col("multiplier") > 0, F.col("multiplier"))
    return joined.withColumn("sigma", F.col(sigma) * F.coalesce(usable, F.lit(1.0)))


def spread_shift(bars: DataFrame, split: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Population spread of returns before and after each session's split second, and their ratio."""
    r = bars.withColumn("ret", X.log_return(F.col("mid"), Window.partitionBy(*keys).orderBy("sec"))).join(split, list(keys))
    out = r.groupBy(*keys).agg(*[F.stddev_pop(F.when(c, F.col("ret"))).alias(n) for n, c in (("sigma_train", F.col("sec") < F.col("split")), ("sigma_test", F.col("sec") >= F.col("split")))])
    return out.withColumn("ratio", X.ratio(F.col("sigma_test"), F.col("sigma_train")))
