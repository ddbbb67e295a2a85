"""Order-book ladders: walking cost, premiums, imbalance.

A ladder row has arrays ``bid_px``, ``bid_sz``, ``ask_px`` and ``ask_sz``, best
level first. Walks are higher-order functions over one row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.functions.binning import log_bins
from tidewright.operators.joins import nearest

LADDER = ("bid_px", "bid_sz", "ask_px", "ask_sz")


def arrays(wide: DataFrame, depth: int = 10) -> DataFrame:
    """Wide level columns (bid_px_00 ...) to arrays."""
    other = [c for c in wide.columns if not c.startswith(("bid_", "ask_"))]
    return wide.select(*other, *[F.array(*[F.col(f"{n}_{k:02d}") for k in range(depth)]).alias(n) for n in LADDER])


def uncrossed(df: DataFrame) -> DataFrame:
    """Snapshots with a positive, uncrossed, non-empty touch."""
    best = lambda c: F.get(c, F.lit(0))
    return df.filter((best("bid_px") > 0) & (best("ask_px") > best("bid_px")) & (best("bid_sz") > 0) & (best("ask_sz") > 0))


def walk(px: Column, sz: Column, x: Column) -> Column:
    """Average price of ``x`` shares, the last level in part; NULL beyond the depth."""
    zero = F.struct(x.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def level(acc: Column, one: Column) -> Column:
        taken = F.least(acc["left"], one["s"])
        return F.struct((acc["left"] - taken).alias("left"), (acc["cost"] + taken * one["p"]).alias("cost"))

    levels = F.zip_with(px, sz, lambda p, s: F.struct(p.cast("double").alias("p"), F.greatest(s.cast("double"), F.lit(0.0)).alias("s")))
    return F.aggregate(levels, zero, level, lambda acc: F.when((acc["left"] <= 0) & (x > 0), acc["cost"] / x))


def costs(df: DataFrame, x: str = "x") -> DataFrame:
    """Buy and sell cost per share against the mid, with the mid, half spread and depths."""
    out = df.withColumn("mid", X.mid(F.get("bid_px", F.lit(0)), F.get("ask_px", F.lit(0)))).withColumn("half_spread", X.half_spread(F.get("bid_px", F.lit(0)), F.get("ask_px", F.lit(0))))
    return (
        out.withColumn("buy_cost", walk(F.col("ask_px"), F.col("ask_sz"), F.col(x)) - F.col("mid"))
        .withColumn("sell_cost", F.col("mid") - walk(F.col("bid_px"), F.col("bid_sz"), F.col(x)))
        .withColumn("depth_l1_ask", F.get("ask_sz", F.lit(0)))
        .withColumn("depth_l1_bid", F.get("bid_sz", F.lit(0)))
        .withColumn("depth_ask", X.array_sum(F.col("ask_sz")))
        .withColumn("depth_bid", X.array_sum(F.col("bid_sz")))
    )


def boundaries(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Cumulative ask size and premium over the best ask at each level but the first."""
    money = F.zip_with("ask_px", "ask_sz", lambda p, s: p * s)
    summed = df.select(*keep, F.get("ask_px", F.lit(0)).alias("best_ask"), F.arrays_zip(X.running(F.col("ask_sz").cast("array<double>")).alias("size"), X.running(money.cast("array<double>")).alias("cost")).alias("levels"))
    one = summed.select(*keep, "best_ask", F.posexplode("levels").alias("level", "v")).filter("level > 0")
    return one.select(*keep, "best_ask", "level", F.col("v.size").alias("size_shares"), (X.ratio(F.col("v.cost"), F.col("v.size")) - F.col("best_ask")).alias("premium"))


def premiums(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Level-boundary premiums in basis points and sizes in median first depths."""
    typical = df.groupBy(symbol).agg(F.median(X.first_depth(F.col("ask_sz").cast("array<double>"))).alias("typical")).filter("typical > 0")
    found = boundaries(df, [symbol]).filter("premium > 0 and size_shares > 0 and best_ask > 0")
    return found.join(typical, symbol).select(symbol, "level", "size_shares", "premium", "best_ask", (F.col("size_shares") / F.col("typical")).alias("size_rel"), (F.col("premium") / F.col("best_ask") * 1e4).alias("premium_bps"))


def whole_share_buckets(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean premium and count per whole-share cumulative size."""
    b = boundaries(df, list(by)).filter("premium > 0 and size_shares > 0")
    return b.groupBy(*by, F.floor("size_shares").cast("long").alias("x_int")).agg(F.avg("premium").alias("premium"), F.count("*").alias("n"))


def bucket_slopes(buckets: DataFrame, by: Sequence[str] = (), cap: int = 1000) -> DataFrame:
    """Three log-log slopes: capped, all, and all weighted by count; with what the cap drops."""
    lx, ly = F.ln("x_int"), F.ln("premium")
    kept = F.col("x_int") <= cap
    w, wx, wy = F.sum("n"), F.sum(F.col("n") * lx), F.sum(F.col("n") * ly)
    weighted = X.ratio(w * F.sum(F.col("n") * lx * ly) - wx * wy, w * F.sum(F.col("n") * lx * lx) - wx * wx)
    few = lambda n, x: F.when(n >= 3, x)
    n_kept = F.count(F.when(kept, 1))
    return buckets.groupBy(*by).agg(
        few(n_kept, F.regr_slope(F.when(kept, ly), F.when(kept, lx))).alias("p_filtered"),
        few(F.count("*"), F.regr_slope(ly, lx)).alias("p_all"),
        few(F.count("*"), weighted).alias("p_weighted"),
        F.count("*").alias("n_buckets"),
        n_kept.alias("n_kept"),
        (1 - X.ratio(F.sum(F.when(kept, F.col("n")).otherwise(0)), F.sum("n"))).alias("dropped"),
    )


def session_bins(df: DataFrame, sizes: Sequence[float], volumes: DataFrame, sigma: str, volume: str, by: Sequence[str], bins: int = 40) -> DataFrame:
    """Binned walking costs of a session: two sides, three size units, three cost units.

    ``volumes``: the keys with the daily volatility and volume columns. Sizes are
    shares, shares over the first depth, and shares over daily volume.
    ``participating`` is the share of snapshots deep enough at a bin's mean size:
    every snapshot and size, also one too shallow for a cost, counts in the bin
    whose mean size is nearest in logarithm.
    """
    walked = costs(df.withColumn("x", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))).join(volumes, list(by))
    sides = [F.struct(F.lit(n).alias("side"), F.col(f"{n}_cost").alias("cost"), F.col(f"depth_l1_{q}").cast("double").alias("touch")) for n, q in (("buy", "ask"), ("sell", "bid"))]
    both = walked.select(*by, "mid", "half_spread", "x", F.col(sigma).alias("_sigma"), F.col(volume).alias("_volume"), F.explode(F.array(*sides)).alias("s"))
    units = [F.struct(F.lit(n).alias("size_normalisation"), v.alias("size")) for n, v in (("shares", F.col("x")), ("depth", X.ratio(F.col("x"), F.col("s.touch"))), ("volume", X.ratio(F.col("x"), F.col("_volume"))))]
    rows = both.select("*", F.explode(F.array(*units)).alias("u")).select(
        *by,
        F.col("s.side").alias("side"),
        F.col("u.size_normalisation").alias("size_normalisation"),
        F.col("u.size").alias("size"),
        (F.col("s.cost") / F.col("mid") * 1e4).alias("cost_bp"),
        X.ratio(F.col("s.cost") / F.col("mid"), F.col("_sigma")).alias("cost_sigma"),
        X.ratio(F.col("s.cost"), F.col("half_spread")).alias("cost_half_spreads"),
        F.col("s.cost").isNotNull().cast("double").alias("_deep"),
    )
    keys = [*by, "side", "size_normalisation"]
    table = log_bins(rows, "size", ["cost_bp", "cost_sigma", "cost_half_spreads"], bins, keys)
    return table.join(participation_by_bin(rows.select(*keys, "size", "_deep"), "_deep", table, keys), [*keys, "bin"], "left")


def participation_by_bin(rows: DataFrame, deep: str, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, bin, ``participating``: the mean of ``deep`` over the rows whose size is nearest to the bin's mean size."""
    # A group has one short array: its bins' numbers and log sizes, in order.
    ordered = F.sort_array(F.collect_list(F.struct("bin", F.ln("size").alias("center"))))
    centers = table.groupBy(*keys).agg(ordered.alias("_bins"))
    # Sizes of a fixed grid repeat, so they are counted before they are placed.
    counted = rows.filter("size > 0").groupBy(*keys, "size").agg(F.sum(deep).alias("_deep"), F.count("*").alias("_n")).join(centers, list(keys))
    place = F.element_at("_bins", nearest(F.col("size"), F.transform("_bins", lambda b: b["center"])).cast("int") + 1)["bin"]
    return counted.withColumn("bin", place).groupBy(*keys, "bin").agg((F.sum("_deep") / F.sum("_n")).alias("participating"))


def deep_enough(bins: DataFrame, least: float) -> DataFrame:
    """Bins whose sizes a share of snapshots of at least ``least`` could fill."""
    return bins.filter(F.col("participating") >= least)


def participation(df: DataFrame, sizes: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Share of snapshots deep enough for each size, by side."""
    x = costs(df.withColumn("x", F.explode(F.array(*[F.lit(float(s)) for s in sizes]))))
    return x.groupBy(*by, "x").agg(F.avg(F.col("buy_cost").isNotNull().cast("double")).alias("buy"), F.avg(F.col("sell_cost").isNotNull().cast("double")).alias("sell"))


def imbalance(bid_px: Column, bid_sz: Column, ask_px: Column, ask_sz: Column, order) -> Column:
    """Order-flow imbalance of one level from consecutive states; 0 on the first row."""
    was = lambda c: F.lag(c).over(order)
    when = lambda c, v: F.when(c, v).otherwise(F.lit(0))
    flow = (
        when(bid_px >= was(bid_px), bid_sz)
        - when(bid_px <= was(bid_px), was(bid_sz))
        - when(ask_px <= was(ask_px), ask_sz)
        + when(ask_px >= was(ask_px), was(ask_sz))
    )
    return F.coalesce(F.when(was(bid_px).isNotNull(), flow), F.lit(0)).cast("double")


def level_imbalances(df: DataFrame, keys: Sequence[str], depth: int = 10, order: str = "seq") -> DataFrame:
    """The imbalance of each level of a ladder, as columns ofi_0 ..."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = lambda n, k: F.get(F.col(n), F.lit(k))
    return df.select(*keys, order, *([c for c in ("sec",) if c in df.columns]), *LADDER, *[imbalance(at("bid_px", k), at("bid_sz", k), at("ask_px", k), at("ask_sz", k), w).alias(f"ofi_{k}") for k in range(depth)])


def imbalance_bars(events: DataFrame, keys: Sequence[str], depth: int = 10) -> DataFrame:
    """Per-second sums of level imbalances over the session's mean depth of a level."""
    size = sum((F.coalesce(F.get("bid_sz", F.lit(k)), F.lit(0)) + F.coalesce(F.get("ask_sz", F.lit(k)), F.lit(0)) for k in range(depth)), F.lit(0.0))
    mean = events.groupBy(*keys).agg((F.avg(size) / (2 * depth)).alias("_q"))
    sums = events.groupBy(*keys, "sec").agg(*[F.sum(f"ofi_{k}").alias(f"ofi_{k}") for k in range(depth)])
    scaled = sums.join(mean, list(keys)).select(*keys, "sec", *[X.ratio(F.col(f"ofi_{k}"), F.col("_q")).alias(f"ofi_{k}") for k in range(depth)])
    return scaled.withColumn("ofi_best", F.col("ofi_0")).withColumn("ofi_sum", sum((F.col(f"ofi_{k}") for k in range(1, depth)), F.col("ofi_0")))


def principal_weights(bars: DataFrame, depth: int = 10, train: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and first component of the levels over training rows, from one aggregate.

    The moments are ``depth`` squared numbers, whatever the number of rows.
    """
    names = [f"ofi_{k}" for k in range(depth)]
    rows = bars.filter(train) if train is not None else bars
    moments = rows.agg(*[F.avg(n).alias(n) for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names], *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    mean, spread = np.array([moments[n] for n in names]), np.array([moments[f"s_{n}"] for n in names]) + 1e-12
    cov = np.array([[moments[f"c_{min(i, j)}_{max(i, j)}"] for j in range(depth)] for i in range(depth)]) / np.outer(spread, spread)
    w = np.linalg.eigh(cov)[1][:, -1]
    return mean, spread, w if w[0] >= 0 else -w


def integrated(bars: DataFrame, depth: int = 10, train: Column | None = None) -> DataFrame:
    """``bars`` with ``ofi_integrated``, the first component fitted on training rows only."""
    mean, spread, w = principal_weights(bars, depth, train)
    value = sum(((F.col(f"ofi_{k}") - float(mean[k])) / float(spread[k]) * float(w[k]) for k in range(depth)), F.lit(0.0))
    return bars.withColumn("ofi_integrated", value)
