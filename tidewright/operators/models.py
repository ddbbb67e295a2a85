"""Out-of-sample contest of impact models within each session.

:func:`contest` is one plan: orders get their scales by window frames, all fits
come from sums by session, and predictions are column expressions. No session
meets in one task. :func:`evaluate` does the same for one session in arrays.
Time-of-day multipliers come from other sessions and are joined to the orders
beforehand, as columns ``loso`` and ``prior`` (NULL: no such profile; a symbol's
first session has no ``prior`` model at all).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators import fits, kernels, volatility
from tidewright.operators.bars import SESSION
from tidewright.sources.scratch import folder

# The models' names, in the order of published tables.
MODELS = ("propagator", "propagator_scaled", "sqrt", "sqrt_trailing_sigma", "sqrt_blend", "sqrt_tod_loso", "sqrt_tod_prior", "sqrt_rate", "power_tod_loso", "power_tod_prior")


def split_seconds(bars: DataFrame, keys: Sequence[str] = SESSION, train: float = 0.7) -> DataFrame:
    """First and last second of a session and the second at which its test part starts."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("sec")
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = bars.select(*keys, "sec", F.row_number().over(w).alias("_r"), n.alias("_n"))
    cut = F.max(F.when(F.col("_r") == X.part(F.col("_n"), train) + 1, F.col("sec"))).alias("split")
    return ranked.groupBy(*keys).agg(F.min("sec").alias("first"), F.max("sec").alias("last"), cut)


def side(start: Column, end: Column, first: Column, last: Column, split: Column) -> Column:
    """train, test or crossing; NULL outside the bars. Training orders end before the split."""
    inside = (start >= first) & (end <= last)
    return F.when(inside & (start >= split), "test").when(inside & (end < split), "train").when(inside, "crossing")


def predict_orders(kernel: np.ndarray, delta: float, shares: np.ndarray, sign: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Response to orders spread evenly over whole seconds, as impact along the order."""
    d = np.maximum(seconds, 1.0)
    weight = np.maximum(d[:, None] - np.arange(len(kernel)), 0.0)
    return sign * kernels.flow_of(sign * shares / d, delta) * (weight @ kernel)


def trailing(sec: np.ndarray, returns: np.ndarray, at: np.ndarray, window: int = 1800) -> np.ndarray:
    """Daily-scaled volatility before each time; the batch's median where there is none."""
    cum = np.concatenate([[0.0], np.cumsum(np.nan_to_num(returns**2))])
    hi, lo = np.searchsorted(sec, at, "left"), np.searchsorted(sec, at - window, "left")
    out = np.sqrt(np.maximum((cum[hi] - cum[lo]) / np.maximum(hi - lo, 1), 0) * 23_400)
    ok = np.isfinite(out) & (out > 0)
    return np.where(ok, out, np.median(out[ok]) if ok.any() else np.nan)


def rates(sec: np.ndarray, volume: np.ndarray, start: np.ndarray, end: np.ndarray, shares: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0.0], np.cumsum(np.nan_to_num(volume))])
    traded = cum[np.searchsorted(sec, np.floor(end), "right")] - cum[np.searchsorted(sec, np.floor(start), "left")]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.where(traded > 0, shares / traded, np.nan), 1e-6, 1)


def score(y: np.ndarray, p: np.ndarray) -> dict[str, float]:
    ok = np.isfinite(y) & np.isfinite(p)
    y, p = y[ok], p[ok]
    nan = float("nan")
    total = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    out = {"n": float(len(y)), "r2_no_refit": float(1 - ((y - p) ** 2).sum() / total) if total > 0 else nan}
    if len(y) and p.std() > 0:
        slope = ((p - p.mean()) * (y - y.mean())).sum() / ((p - p.mean()) ** 2).sum()
        cut = y.mean() - slope * p.mean()
        out |= {"slope": float(slope), "intercept": float(cut), "r2_refit": float(1 - ((y - cut - slope * p) ** 2).sum() / total) if total > 0 else nan}
    else:
        out |= {"slope": nan, "intercept": nan, "r2_refit": nan}
    return out | {"mean_realised": float(y.mean()) if len(y) else nan, "mean_predicted": float(p.mean()) if len(y) else nan}


def predictions(bars: dict[str, np.ndarray], orders: dict[str, np.ndarray], volume: float, sigma: float, train: float = 0.7, least: int = 50) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, float]]:
    """Predictions for the test orders by model, their realised impact, and the parameters."""
    sec, ret = bars["sec"], kernels.returns_of(bars["mid"])
    cut = X.part_of(len(sec), train)
    if not 0 < cut < len(sec):
        raise ValueError("an empty bar window")
    split = sec[cut]
    kernel = kernels.nested(ret, bars["signed_vol"], cut)
    start, end = orders["t_start"], orders["t_end"]
    usable = (orders["mid_start"] > 0) & (orders["shares"] > 0) & (start >= sec[0]) & (end <= sec[-1])
    tr, te = usable & (start < split) & (end < split), usable & (start >= split)
    if tr.sum() < least or te.sum() < least:
        raise ValueError("too few orders on one side of the split")
    with np.errstate(divide="ignore", invalid="ignore"):
        impact = orders["sign"] * (np.log(orders["mid_end"]) - np.log(orders["mid_start"]))
    impact = np.where(np.isfinite(impact), impact, np.nan)
    q = orders["shares"] / volume
    at = np.floor(start)
    params = {"n_train": float(tr.sum()), "n_test": float(te.sum()), "n_crossing": float((usable & (start < split) & (end >= split)).sum()), "split_second": float(split), "delta": kernel.delta, "n_lags": float(kernel.lags)}
    out: dict[str, np.ndarray] = {}

    def fitted(x: np.ndarray) -> float:
        ok = np.isfinite(x[tr]) & np.isfinite(impact[tr])
        return float((x[tr][ok] * impact[tr][ok]).sum() / (x[tr][ok] ** 2).sum())

    seconds = np.floor(end) - np.floor(start) + 1
    raw = predict_orders(kernel.kernel, kernel.delta, orders["shares"], orders["sign"], seconds)
    params["propagator_scale"] = fitted(raw)
    out["propagator"], out["propagator_scaled"] = raw[te], params["propagator_scale"] * raw[te]
    root = np.sqrt(q)
    params["sqrt_c"] = fitted(sigma * root)
    out["sqrt"] = params["sqrt_c"] * sigma * root[te]
    near = np.full(len(q), np.nan)
    near[tr], near[te] = trailing(sec, ret, at[tr]), trailing(sec, ret, at[te])
    params["sqrt_trailing_c"] = fitted(near * root)
    out["sqrt_trailing_sigma"] = params["sqrt_trailing_c"] * near[te] * root[te]
    best = (np.inf, 0.0, 0.0)
    for alpha in np.linspace(0, 1, 101):
        x = sigma**alpha * near ** (1 - alpha) * root
        ok = tr & np.isfinite(x) & np.isfinite(impact) & (x > 0)
        c = (x[ok] * impact[ok]).sum() / (x[ok] ** 2).sum()
        best = min(best, (float(((impact[ok] - c * x[ok]) ** 2).sum()), float(alpha), float(c)), key=lambda t: t[0])
    _, params["blend_alpha"], params["blend_c"] = best
    out["sqrt_blend"] = best[2] * (sigma ** best[1] * near ** (1 - best[1]) * root)[te]
    for kind in ("loso", "prior"):
        factor = orders.get(kind)
        if factor is None or not np.isfinite(factor).any():
            continue
        scaled = sigma * np.where(np.isfinite(factor) & (factor > 0), factor, 1.0)
        params[f"sqrt_tod_{kind}_c"] = fitted(scaled * root)
        out[f"sqrt_tod_{kind}"] = params[f"sqrt_tod_{kind}_c"] * (scaled * root)[te]
        power = fits.power_arrays(impact[tr], scaled[tr], q[tr])
        params[f"power_tod_{kind}_c"], params[f"power_tod_{kind}_delta"] = power.c, power.delta
        out[f"power_tod_{kind}"] = power.c * scaled[te] * q[te] ** power.delta
    rate = rates(sec, bars["volume"], start, end, orders["shares"])
    c, delta, k = fits.rate_arrays(impact[tr] / sigma, q[tr], rate[tr])
    params |= {"rate_c": c, "rate_delta": delta, "rate_k": k}
    out["sqrt_rate"] = sigma * c * q[te] ** delta * (1 + k * np.log(rate[te]))
    return out, impact[te], params


def evaluate(bars: DataFrame, orders: DataFrame, keys: Sequence[str] = SESSION, train: float = 0.7, least: int = 50) -> DataFrame:
    """Long table (session, model, metric, value) of scores and parameters.

    ``orders`` carries session_volume and sigma_d, and optionally loso and prior.
    Sessions that are too short give no rows.
    """
    names = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in keys)
    extra = [c for c in ("loso", "prior") if c in orders.columns]

    def run(key, b, o):
        import pandas as pd

        rows = []
        if len(b) and len(o):
            b, o = b.sort_values("sec"), o.sort_values(["t_start", "t_end"])
            arrays = lambda f: {c: f[c].to_numpy(float) for c in f.columns if c not in keys}
            try:
                made, real, params = predictions(arrays(b), arrays(o), float(o["session_volume"].iloc[0]), float(o["sigma_d"].iloc[0]), train, least)
            except ValueError:
                made, real, params = {}, np.zeros(0), {}
            rows = [[*key, m, n, v] for m, p in made.items() for n, v in score(real, p).items()] + [[*key, "parameters", n, float(v)] for n, v in params.items()]
        return pd.DataFrame(rows, columns=[*keys, "model", "metric", "value"])

    left = bars.select(*keys, "sec", "signed_vol", "volume", "mid").groupBy(*keys)
    right = orders.select(*keys, "t_start", "t_end", "shares", "sign", "mid_start", "mid_end", "session_volume", "sigma_d", *extra).groupBy(*keys)
    return left.cogroup(right).applyInPandas(run, f"{names}, model string, metric string, value double")


def contest(bars: DataFrame, orders: DataFrame, keys: Sequence[str] = SESSION, train: float = 0.7, least: int = 50, window: int = 1800, seconds: int = 23_400, lags: Sequence[int] = kernels.LAGS, deltas: Sequence[float] = kernels.DELTAS, least_bars: int = 50, only: Sequence[str] = MODELS) -> DataFrame:
    """Scores of every model on the test orders of every session: a row a session and model.

    ``orders``: keys, order_id, t_start, t_end, shares, sign, mid_start, mid_end,
    session_volume, sigma_d, and optionally loso and prior. Sessions with fewer
    than ``least`` orders on a side give no rows, nor does a model whose kernel has
    fewer than ``least_bars`` bars on a side of its own split.
    """
    spark, keys = bars.sparkSession, list(keys)
    kinds = [k for k in ("loso", "prior") if k in orders.columns and any(m.endswith(k) for m in only)]
    place = side(F.col("t_start"), F.col("t_end"), F.col("first"), F.col("last"), F.col("split"))
    own = orders.join(split_seconds(bars, keys, train), keys).withColumn("side", place)
    present = orders.groupBy(*keys).agg(F.lit(1).alias("_any"), *[F.count(k).alias(f"has_{k}") for k in kinds])
    own = own.filter((F.col("mid_start") > 0) & (F.col("shares") > 0) & F.col("side").isin("train", "test"))
    size = own.groupBy(*keys).agg(*[F.count(F.when(F.col("side") == n, 1)).alias(f"_{n}") for n in ("train", "test")]).filter((F.col("_train") >= least) & (F.col("_test") >= least))
    own = own.join(size.select(*keys), keys, "left_semi").join(present, keys)
    own = own.withColumn("y", X.impact_log(F.col("sign"), F.col("mid_start"), F.col("mid_end"))).withColumn("q", F.col("shares") / F.col("session_volume")).withColumn("at", F.floor("t_start"))
    near = volatility.trailing_sigma(bars, own, keys, window, seconds, "side").select(*keys, "order_id", F.col("sigma").alias("near"))
    own = own.join(near, [*keys, "order_id"])
    if "sqrt_rate" in only:
        own = own.join(volatility.execution_rate(bars, own, keys).select(*keys, "order_id", "rate"), [*keys, "order_id"])
    for kind in kinds:
        usable = F.when(F.col(kind) > 0, F.col(kind))
        own = own.withColumn(f"scaled_{kind}", F.when(F.col(f"has_{kind}") > 0, F.col("sigma_d") * F.coalesce(usable, F.lit(1.0))))
    path = folder(spark, "contest")
    own.write.parquet(path)  # read by every fit below
    own = spark.read.parquet(path)
    root = F.sqrt("q")
    if any(m.startswith("propagator") for m in only):
        kernel = kernels.calibrate(bars, keys, lags=lags, deltas=deltas, end=train, least=least_bars).filter("best").select(*keys, F.col("delta").alias("_delta"), F.col("refit").alias("_kernel"))
        span = (F.floor("t_end") - F.floor("t_start") + 1).cast("double")
        own = own.join(kernel, keys, "left").withColumn("raw", X.propagator_impact(F.col("_kernel"), F.col("shares"), F.col("sign"), span, F.col("_delta")))
    fit_on = own.filter("side = 'train'")
    levels = {"sqrt": F.col("sigma_d") * root, "sqrt_trailing_sigma": F.col("near") * root} | {f"sqrt_tod_{k}": F.col(f"scaled_{k}") * root for k in kinds}
    if "raw" in own.columns:
        levels["propagator_scaled"] = F.col("raw")
    fitted = fit_on.groupBy(*keys).agg(*[fits.level(F.col("y"), x).alias(f"c_{n}") for n, x in levels.items()])
    made = {n: F.col(f"c_{n}") * x for n, x in levels.items()}
    if "raw" in own.columns:
        made["propagator"] = F.col("raw")
    if "sqrt_blend" in only:
        best = fits.blend_alpha(fit_on.filter("sigma_d > 0 and near > 0"), "y", "sigma_d", "near", "q", keys).select(*keys, F.col("alpha").alias("_alpha"), F.col("c").alias("c_blend"))
        fitted = fitted.join(best, keys, "left")
        made["sqrt_blend"] = F.col("c_blend") * X.blend(F.col("sigma_d"), F.col("near"), F.col("_alpha")) * root
    for kind in kinds:
        if f"power_tod_{kind}" in only:
            power = fits.power_fits(fit_on, "y", f"scaled_{kind}", "q", keys).select(*keys, F.col("c").alias(f"c_power_{kind}"), F.col("delta").alias(f"d_power_{kind}"))
            fitted = fitted.join(power, keys, "left")
            made[f"power_tod_{kind}"] = X.power_impact(F.col(f"c_power_{kind}"), F.col(f"d_power_{kind}"), F.col(f"scaled_{kind}"), F.col("q"))
    if "sqrt_rate" in only:
        rate = fits.rate_fits(fit_on.withColumn("_y", F.col("y") / F.col("sigma_d")), "_y", "q", "rate", keys).select(*keys, F.col("c").alias("c_rate"), F.col("delta").alias("d_rate"), F.col("k").alias("k_rate"))
        fitted = fitted.join(rate, keys, "left")
        made["sqrt_rate"] = X.rate_impact(F.col("c_rate"), F.col("d_rate"), F.col("k_rate"), F.col("sigma_d"), F.col("q"), F.col("rate"))
    tested = own.filter("side = 'test'").join(fitted, keys)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), made[n].alias("p")) for n in MODELS if n in made and n in only]))
    return fits.scores(tested.select(*keys, "y", rows.alias("m")).select(*keys, "y", "m.*"), "y", "p", [*keys, "model"])


def comparison(scores: DataFrame) -> DataFrame:
    """Per model: sessions and medians of out-of-sample R2 and slope."""
    wide = scores.filter("model <> 'parameters'").groupBy("model").agg(
        F.count(F.when(F.col("metric") == "r2_no_refit", 1)).alias("sessions"),
        F.median(F.when(F.col("metric") == "r2_no_refit", F.col("value"))).alias("median_r2"),
        F.median(F.when(F.col("metric") == "slope", F.col("value"))).alias("median_slope"),
    )
    return wide


def pooled_calibration(tables: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Count-weighted means of per-session decile tables."""
    n = F.sum("n")
    return tables.groupBy(*by, "decile").agg((F.sum(F.col("predicted") * F.col("n")) / n).alias("predicted"), (F.sum(F.col("realised") * F.col("n")) / n).alias("realised"), n.alias("n")).withColumn("ratio", F.col("realised") / F.nullif(F.col("predicted"), F.lit(0.0)))
