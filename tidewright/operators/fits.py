"""Separable fits: every model is linear in its level given one or two shapes.

For y = c * x(theta) the error is sum(y^2) - A^2 / B with A = sum(x y) and
B = sum(x^2). A grid over theta is exploded next to each row and summed away in
the same stage, so a fit is one partially aggregated pass; the last digits come
from a root search on the driver or in one small group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.functions.binning import cumulative, qcut_means
from tidewright.operators import resample


def level(y: Column, x: Column) -> Column:
    """Aggregate: least-squares c in y = c x."""
    ok = x.isNotNull() & y.isNotNull()
    return X.ratio(F.sum(F.when(ok, x * y)), F.sum(F.when(ok, x * x)))


def scores(df: DataFrame, realised: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2 of the prediction as is and refitted, with slope, intercept and means."""
    d = df.filter(F.col(realised).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(realised), F.col(predicted)
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        F.regr_syy(y, p).alias("_sst"),
        F.regr_r2(y, p).alias("r2_refit"),
        F.regr_slope(y, p).alias("slope"),
        F.regr_intercept(y, p).alias("intercept"),
        F.avg(y).alias("mean_realised"),
        F.avg(p).alias("mean_predicted"),
    )
    return out.withColumn("r2_no_refit", 1 - X.ratio(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


def profile(df: DataFrame, y: Column, x: Column, grid: Sequence[float], by: Sequence[str] = (), name: str = "theta") -> DataFrame:
    """Level and error at every grid value; ``x`` may use the column ``name``."""
    g = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in grid]))).withColumn("_x", x).withColumn("_y", y)
    g = g.filter(X.all_finite(["_x", "_y"]))
    sums = g.groupBy(*by, name).agg(F.sum(F.col("_x") * F.col("_y")).alias("A"), F.sum(F.col("_x") * F.col("_x")).alias("B"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.count("*").alias("n"))
    return sums.withColumn("c", X.ratio(F.col("A"), F.col("B"))).withColumn("sse", F.col("yy") - F.coalesce(F.col("A") * F.col("c"), F.lit(0.0)))


def lowest(table: DataFrame, by: Sequence[str] = (), name: str = "theta", error: str = "sse") -> DataFrame:
    """The grid row of least error; the earliest on ties."""
    rest = [c for c in table.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(error, name)).alias("_r")
    return (table.groupBy(*by).agg(pick) if by else table.agg(pick)).select(*by, "_r.*")


@dataclass(frozen=True)
class Power:
    c: float
    delta: float
    n: int


def _root(f: Callable[[float], float], lo: float, hi: float) -> float:
    a = f(lo)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        b = f(mid)
        if mid in (lo, hi) or b == 0:
            break
        if (a < 0) == (b < 0):
            lo, a = mid, b
        else:
            hi = mid
    return 0.5 * (lo + hi)


def power_arrays(y: np.ndarray, scale: np.ndarray, q: np.ndarray, weight: np.ndarray | None = None, bounds: tuple[float, float] = (0.0, 1.5), steps: int = 301) -> Power:
    """c and delta of y = c * scale * q ** delta: grid, then the root of the error's slope."""
    y, scale, q = (np.asarray(v, float) for v in (y, np.broadcast_to(scale, np.shape(q)), q))
    ok = np.isfinite(y) & np.isfinite(scale) & np.isfinite(q) & (q > 0) & (scale > 0)
    w = np.ones(ok.sum()) if weight is None else np.asarray(weight, float)[ok]
    y, scale, q = y[ok], scale[ok], q[ok]
    if not len(y):
        return Power(float("nan"), float("nan"), 0)
    lq = np.log(q)

    def parts(d: float) -> tuple[float, float, float, float]:
        x = scale * np.exp(d * lq)
        return (w * x * y).sum(), (w * x * x).sum(), (w * x * y * lq).sum(), 2 * (w * x * x * lq).sum()

    def error(d: float) -> float:
        a, b, _, _ = parts(d)
        c = max(a / b, 0.0)
        return float(-2 * c * a + c * c * b)

    def slope(d: float) -> float:
        a, b, da, db = parts(d)
        return 2 * b * da - a * db

    grid = np.linspace(*bounds, steps)
    best = int(np.argmin([error(d) for d in grid]))
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, steps - 1)]
    delta = _root(slope, lo, hi) if slope(lo) * slope(hi) < 0 else float(grid[best])
    a, b, _, _ = parts(delta)
    return Power(float(max(a / b, 0.0)), float(delta), len(y))


def power_fits(df: DataFrame, y: str, scale: str, q: str, by: Sequence[str], bounds: tuple[float, float] = (0.0, 1.5)) -> DataFrame:
    """c and delta of y = c * scale * q ** delta per group, from its sums at some sixty exponents.

    What meets in a task per group is those sums, not its rows.
    """
    import pandas as pd

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    rows = df.select(*by, F.col(y).alias("_y0"), F.col(scale).alias("_scale"), F.col(q).alias("_q")).filter((F.col("_scale") > 0))
    table, center = _power_sums(rows, F.col("_y0"), "_q", by, bounds, F.col("_scale"))

    def fit(key, sums):
        sums = sums.sort_values("theta")
        c, delta, _ = polished(sums["A"].to_numpy()[None, :], sums["B"].to_numpy()[None, :], bounds, center)
        return pd.DataFrame([[*key, float(c[0]), float(delta[0]), int(sums["n"].iloc[0])]], columns=[*by, "c", "delta", "n"])

    return table.groupBy(*by).applyInPandas(fit, f"{keys}, c double, delta double, n long")


class Curves:
    """Rows of values at the points of :func:`nodes` as Chebyshev series of each piece, evaluated at a place per row."""

    def __init__(self, values: np.ndarray, bounds: tuple[float, float], pieces: int = 4, degree: int = 16) -> None:
        chebyshev = np.polynomial.chebyshev
        x = np.cos(np.pi * np.arange(degree, -1, -1) / degree)
        own = np.stack([values[:, k * degree : (k + 1) * degree + 1] for k in range(pieces)], axis=1)
        self.series = own @ np.linalg.inv(chebyshev.chebvander(x, degree)).T
        self.ends, self.pieces = np.linspace(*bounds, pieces + 1), pieces
        self.slopes = chebyshev.chebder(self.series, axis=2) * (2 / (self.ends[1] - self.ends[0]))

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and slopes."""
        piece = np.clip(np.searchsorted(self.ends, at, side="right") - 1, 0, self.pieces - 1)
        t = 2 * (at - self.ends[piece]) / (self.ends[1] - self.ends[0]) - 1
        rows = np.arange(len(at))
        terms = np.polynomial.chebyshev.chebvander(t, self.series.shape[2] - 1)
        return (self.series[rows, piece] * terms).sum(axis=1), (self.slopes[rows, piece] * terms[:, :-1]).sum(axis=1)


def polished(a: np.ndarray, b: np.ndarray, bounds: tuple[float, float], center: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, exponent and error's fall of each row of sums at the points: the least on a fine grid, then the root of ``2 B A' - A B'``."""
    _, grid, matrix = nodes(bounds)
    curve_a, curve_b = Curves(a, bounds), Curves(b, bounds)
    fall = np.maximum(a @ matrix.T, 0) ** 2 / np.maximum(b @ matrix.T, 1e-300)
    best = fall.argmax(axis=1)
    lo, hi = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]

    def slope(x: np.ndarray) -> np.ndarray:
        (u, du), (v, dv) = curve_a(x), curve_b(x)
        return 2 * v * du - u * dv

    inside = slope(lo) * slope(hi) < 0
    left, right, sign = lo.copy(), hi.copy(), np.sign(slope(lo))
    for _ in range(60):
        middle = 0.5 * (left + right)
        same = np.sign(slope(middle)) == sign
        left, right = np.where(same, middle, left), np.where(same, right, middle)
    delta = np.where(inside, 0.5 * (left + right), grid[best])
    top, low = np.maximum(curve_a(delta)[0], 0), np.maximum(curve_b(delta)[0], 1e-300)
    return top / low * np.exp(-delta * center), delta, top**2 / low


def nodes(bounds: tuple[float, float], pieces: int = 4, degree: int = 16, fine: int = 3001) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chebyshev points of each piece of an interval, a fine grid, and the matrix from values at the points to the grid."""
    x = np.cos(np.pi * np.arange(degree, -1, -1) / degree)
    weight = np.where(np.arange(degree + 1) % 2 == 0, 1.0, -1.0)
    weight[[0, -1]] /= 2
    ends = np.linspace(*bounds, pieces + 1)
    points = np.unique(np.concatenate([lo + (x + 1) / 2 * (hi - lo) for lo, hi in zip(ends[:-1], ends[1:])]).round(12))
    grid, matrix = np.linspace(*bounds, fine), np.zeros((fine, len(points)))
    for k in range(pieces):
        rows = np.flatnonzero((grid >= ends[k]) & ((grid < ends[k + 1]) if k + 1 < pieces else (grid <= ends[-1])))
        own = points[k * degree : (k + 1) * degree + 1]
        gap = grid[rows, None] - own
        with np.errstate(divide="ignore", invalid="ignore"):
            part = weight / gap
            part /= part.sum(axis=1, keepdims=True)
        on = np.abs(gap) < 1e-13
        part[on.any(axis=1)] = on[on.any(axis=1)].astype(float)
        matrix[rows, k * degree : (k + 1) * degree + 1] = part
    return points, grid, matrix


def _power_sums(orders: DataFrame, y: Column, q: str, by: Sequence[str], bounds: tuple[float, float], scale: Column | None = None) -> tuple[DataFrame, float]:
    """Sums of every group at the points, sizes taken relative to their mean logarithm."""
    scale = F.lit(1.0) if scale is None else scale
    d = orders.withColumn("_y0", y).filter(X.all_finite(["_y0", q]) & (F.col(q) > 0)).withColumn("_lq", F.ln(q))
    center = d.agg(F.avg("_lq")).first()[0] or 0.0
    table = profile(d, F.col("_y0"), scale * F.exp(F.col("theta") * (F.col("_lq") - center)), nodes(bounds)[0].tolist(), by)
    return table.select(*by, "theta", "A", "B", "yy", "n"), center


def published(orders: DataFrame, y: Column, q: str, group: str, draws: int = 1000, seed: int = 0, bounds: tuple[float, float] = (0.0, 3.0)) -> dict[str, float]:
    """Free and square-root exponents of y = c q ** delta with block intervals, in one pass.

    A and B are smooth in delta, so the pass keeps their group sums at some sixty
    points; every draw is a contraction of them, interpolated to a fine grid and
    polished by the root of the error's slope.
    """
    table, center = _power_sums(orders, y, q, [group], bounds)
    return contracted(table.toPandas(), group, bounds, center, draws, seed)


def contracted(rows, group: str, bounds: tuple[float, float], center: float, draws: int, seed: int) -> dict[str, float]:
    """Estimates and block intervals from the sums of every group and point."""
    points, grid, matrix = nodes(bounds)
    groups = sorted(rows[group].unique())
    shape = (len(groups), len(points))
    rows = rows.sort_values([group, "theta"])
    a, b = rows["A"].to_numpy().reshape(shape), rows["B"].to_numpy().reshape(shape)
    n = rows["n"].to_numpy().reshape(shape)[:, 0]
    times = np.concatenate([np.ones((1, len(groups))), resample.multiplicities(groups, draws, seed).reshape(draws, len(groups))])
    c, delta, _ = polished(times @ a, times @ b, bounds, center)
    half = np.argmin(np.abs(grid - 0.5))
    level = (times @ (a @ matrix[half])) / np.maximum(times @ (b @ matrix[half]), 1e-300) * np.exp(-grid[half] * center)
    (d_lo, d_hi), (h_lo, h_hi) = resample.interval(delta[1:]), resample.interval(level[1:])
    return {"c_free": float(c[0]), "delta": float(delta[0]), "c_half": float(level[0]), "n": int(n.sum()), "delta_low": d_lo, "delta_high": d_hi, "c_half_low": h_lo, "c_half_high": h_hi}


def published_panels(orders: DataFrame, y: Column, q: str, panel: str, group: str, draws: int = 200, seed: int = 0, bounds: tuple[float, float] = (0.0, 3.0)) -> DataFrame:
    """:func:`published` for every panel: sums are shuffled, orders are not."""
    import pandas as pd

    table, center = _power_sums(orders, y, q, [panel, group], bounds)
    kind = orders.schema[panel].dataType.simpleString()

    def fit(key, rows):
        return pd.DataFrame([{panel: key[0], **contracted(rows, group, bounds, center, draws, seed)}])

    out = f"{panel} {kind}, c_free double, delta double, c_half double, n long, delta_low double, delta_high double, c_half_low double, c_half_high double"
    return table.groupBy(panel).applyInPandas(fit, out)


def blend_alpha(df: DataFrame, y: str, daily: str, trailing: str, q: str, by: Sequence[str] = (), steps: int = 101) -> DataFrame:
    """Weight of the daily volatility in the blend, and its level."""
    x = X.blend(F.col(daily), F.col(trailing), F.col("alpha")) * F.sqrt(q)
    return lowest(profile(df, F.col(y), x, np.linspace(0, 1, steps).tolist(), by, "alpha"), by, "alpha")


def rate_arrays(y: np.ndarray, q: np.ndarray, rate: np.ndarray, steps: int = 601) -> tuple[float, float, float]:
    """c, delta and k of y = c q ** delta (1 + k ln rate).

    Linear in (c, c k) given delta; the bound on k makes a cone, so the interior
    solution is compared with both of its edges. c stays positive.
    """
    y, q, lr = np.asarray(y, float), np.asarray(q, float), np.log(np.asarray(rate, float))
    ok = np.isfinite(y) & np.isfinite(q) & np.isfinite(lr) & (q > 0)
    y, lq, lr = y[ok], np.log(q[ok]), lr[ok]
    most = 0.95 / max(np.abs(lr).max(initial=0.0), 1e-9)

    def solve(delta: float) -> tuple[float, float, float]:
        p = np.exp(delta * lq)
        u, v = p, p * lr
        g = np.array([[u @ u, u @ v], [u @ v, v @ v]])
        h = np.array([u @ y, v @ y])
        found = []
        if np.linalg.cond(g) < 1e12:
            c, ck = np.linalg.solve(g, h)
            if c > 0 and abs(ck) <= most * c:
                found.append((c, ck / c))
        for k in (-most, 0.0, most) if not found else ():
            x = u + k * v
            found.append((max(x @ y / (x @ x), 1e-12), k))
        return min(((float(((y - c * (u + k * v)) ** 2).sum()), float(c), float(k)) for c, k in found), key=lambda t: t[0])

    grid = np.linspace(0, 3, steps)
    errors = [solve(d)[0] for d in grid]
    k = int(np.argmin(errors))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, steps - 1)]
    phi = (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
        if solve(a)[0] <= solve(b)[0]:
            hi = b
        else:
            lo = a
    delta = 0.5 * (lo + hi)
    if solve(delta)[0] > errors[k]:
        delta = grid[k]
    _, c, slope = solve(delta)
    return c, float(delta), slope


def _cone(sums: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least error, c and k of y = c (u + k v) for columns of sums uu, uv, vv, uy, vy, yy, where c > 0 and k lies within ``edge``."""
    uu, uv, vv, uy, vy, yy = sums
    det = uu * vv - uv * uv
    with np.errstate(divide="ignore", invalid="ignore"):
        c, ck = (vv * uy - uv * vy) / det, (uu * vy - uv * uy) / det
        free = (det > 1e-12 * uu * vv) & (c > 0) & (np.abs(ck) <= edge * c)
        found = [(np.where(free, c, 1e-12), np.where(free, ck / c, 0.0))]
        found += [(np.maximum((uy + k * vy) / (uu + 2 * k * uv + k * k * vv), 1e-12), np.full(len(uu), k)) for k in (-edge, 0.0, edge)]
    errors = np.array([yy - 2 * c * (uy + k * vy) + c * c * (uu + 2 * k * uv + k * k * vv) for c, k in found])
    pick = np.where(free, 0, 1 + errors[1:].argmin(axis=0))
    at = np.arange(len(uu))
    return errors[pick, at], np.array([c for c, _ in found])[pick, at], np.array([k for _, k in found])[pick, at]


def rate_fits(df: DataFrame, y: str, q: str, rate: str, by: Sequence[str], bounds: tuple[float, float] = (0.0, 3.0)) -> DataFrame:
    """c, delta and k of y = c * q ** delta * (1 + k * ln rate) per group, as :func:`rate_arrays`, from sums at the points."""
    import pandas as pd

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    d = df.withColumn("_lr", X.log(F.col(rate))).filter(X.all_finite([y, q, "_lr"]) & (F.col(q) > 0)).withColumn("_lq", F.ln(q))
    center = d.agg(F.avg("_lq")).first()[0] or 0.0
    points = nodes(bounds)[0]
    g = d.withColumn("theta", F.explode(F.array(*[F.lit(v) for v in points.tolist()]))).withColumn("_u", F.exp(F.col("theta") * (F.col("_lq") - center))).withColumn("_v", F.col("_u") * F.col("_lr"))
    u, v, target = F.col("_u"), F.col("_v"), F.col(y)
    sums = {"uu": u * u, "uv": u * v, "vv": v * v, "uy": u * target, "vy": v * target, "yy": target * target}
    table = g.groupBy(*by, "theta").agg(*[F.sum(e).alias(n) for n, e in sums.items()], F.max(F.abs("_lr")).alias("most"), F.count("*").alias("n"))

    names = list(sums)

    def fit(key, rows):
        rows = rows.sort_values("theta")
        values, edge = rows[names].to_numpy().T, 0.95 / max(float(rows["most"].max()), 1e-9)
        curve = Curves(values, bounds)
        _, grid, matrix = nodes(bounds)
        errors = _cone(values @ matrix.T, edge)[0]
        best = int(np.argmin(errors))
        solve = lambda x: [float(v[0]) for v in _cone(curve(np.full(len(names), x))[0][:, None], edge)]
        lo, hi, phi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (5**0.5 - 1) / 2
        for _ in range(50):
            a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
            lo, hi = (lo, b) if solve(a)[0] <= solve(b)[0] else (a, hi)
        delta = 0.5 * (lo + hi) if solve(0.5 * (lo + hi))[0] <= errors[best] else grid[best]
        _, c, k = solve(delta)
        return pd.DataFrame([[*key, c * np.exp(-delta * center), float(delta), k, int(rows["n"].iloc[0])]], columns=[*by, "c", "delta", "k", "n"])

    return table.groupBy(*by).applyInPandas(fit, f"{keys}, c double, delta double, k double, n long")


def two_regime_arrays(q: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 200) -> dict[str, float]:
    """Crossover of a linear and a square-root branch by profiling; with its interval."""
    q, y, w = (np.asarray(v, float) for v in (q, y, w))
    ok = np.isfinite(q) & np.isfinite(y) & np.isfinite(w) & (q > 0)
    q, y, w = q[ok], y[ok], w[ok]
    grid = np.geomspace(q.min(), q.max(), steps)
    x = np.where(q <= grid[:, None], q, np.sqrt(grid[:, None] * q))
    a = (w * x * y).sum(axis=1) / (w * x * x).sum(axis=1)
    sse = (w * (y - a[:, None] * x) ** 2).sum(axis=1)
    k = int(np.argmin(sse))
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = len(q) * np.log(sse / sse[k]) if sse[k] > 0 else np.where(sse > 0, np.inf, 0.0)
    inside = grid[deviance <= 3.841]
    mean = (w * y).sum() / w.sum()
    total = (w * (y - mean) ** 2).sum()
    return {"a": float(a[k]), "q_star": float(grid[k]), "wsse": float(sse[k]), "r2": float(1 - sse[k] / total) if total > 0 else float("nan"), "n": len(q), "low": float(inside.min()), "high": float(inside.max()), "at_boundary": bool(k in (0, steps - 1))}


def two_regime_profile(bins: DataFrame, q: str, y: str, w: str, grid: Sequence[float]) -> DataFrame:
    """Level and weighted error at each crossover of ``grid``, with the deviance."""
    g = bins.withColumn("q_star", F.explode(F.array(*[F.lit(float(v)) for v in grid]))).withColumn("x", X.two_regime(F.lit(1.0), F.col("q_star"), F.col(q)))
    s = g.groupBy("q_star").agg(F.sum(F.col(w) * F.col("x") * F.col(y)).alias("A"), F.sum(F.col(w) * F.col("x") * F.col("x")).alias("B"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
    s = s.select("q_star", "n", X.ratio(F.col("A"), F.col("B")).alias("a"), (F.col("yy") - F.col("A") * X.ratio(F.col("A"), F.col("B"))).alias("wsse"))
    least = s.agg(F.min("wsse").alias("_least"))
    return s.crossJoin(F.broadcast(least)).select("q_star", "a", "wsse", (F.col("n") * X.log(X.ratio(F.col("wsse"), F.col("_least")))).alias("deviance"))  # one row


def crossovers(bins: DataFrame, q: str, y: str, w: str, by: Sequence[str], steps: int = 200) -> DataFrame:
    """Per group: the crossover of least weighted error on a log grid over its sizes, its level, and whether it is interior."""
    own = bins.filter(F.col(q) > 0)
    ends = own.groupBy(*by).agg(F.ln(F.min(q)).alias("_lo"), F.ln(F.max(q)).alias("_hi"))
    g = own.join(ends, list(by)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    g = g.withColumn("q_star", F.exp(F.col("_lo") + F.col("_k") * (F.col("_hi") - F.col("_lo")) / (steps - 1))).withColumn("_x", X.two_regime(F.lit(1.0), F.col("q_star"), F.col(q)))
    s = g.groupBy(*by, "_k").agg(F.max("q_star").alias("q_star"), F.sum(F.col(w) * F.col("_x") * F.col(y)).alias("A"), F.sum(F.col(w) * F.col("_x") * F.col("_x")).alias("B"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("yy"))
    s = s.select(*by, "_k", "q_star", X.ratio(F.col("A"), F.col("B")).alias("a"), (F.col("yy") - F.col("A") * X.ratio(F.col("A"), F.col("B"))).alias("sse"))
    return lowest(s, by, "_k").withColumn("interior", (F.col("_k") > 0) & (F.col("_k") < steps - 1)).drop("_k", "sse")


def interior(found: DataFrame) -> DataFrame:
    """Crossovers that do not sit at an end of the sizes seen."""
    return found.filter("interior")


def impact_law(df: DataFrame, x: str, y: str, bins: int = 12, rows: int = 10, least: int = 4) -> DataFrame:
    """Exponent of bin means; no row under ``rows`` rows a bin or ``least`` bins of positive means."""
    if len(df.select(x).limit(bins * rows).collect()) < bins * rows:
        return log_log(df.limit(0), x, y).filter("n > 0")
    return log_log(qcut_means(df, x, y, bins), f"mean_{x}", f"mean_{y}").filter(F.col("n") >= least)


def log_log(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Exponent, log level, R2 and count of y = a x ** p on positive values."""
    lx, ly = X.log(F.col(x)), X.log(F.col(y))
    return df.groupBy(*by).agg(F.regr_slope(ly, lx).alias("exponent"), F.regr_intercept(ly, lx).alias("log_level"), F.regr_r2(ly, lx).alias("r2"), F.regr_count(ly, lx).alias("n"))


def log_log_interval(df: DataFrame, x: str, y: str, group: str, draws: int = 500, seed: int = 0) -> tuple[float, float]:
    """Block interval of the exponent, from one row of sums a group."""
    d = df.withColumn("_x", X.log(F.col(x))).withColumn("_y", X.log(F.col(y))).filter("_x is not null and _y is not null")
    groups, s = resample.group_sums(d, group, [F.lit(1.0), F.col("_x"), F.col("_y"), F.col("_x") * F.col("_x"), F.col("_x") * F.col("_y")])
    if len(groups) < 3:
        return float("nan"), float("nan")
    slope = lambda v: (v[0] * v[4] - v[1] * v[2]) / (v[0] * v[3] - v[1] ** 2)
    return resample.interval(resample.contract(s, resample.multiplicities(groups, draws, seed), slope))


def ols_hc1(df: DataFrame, y: str, xs: Sequence[str]) -> list[dict]:
    """OLS with an intercept and HC1 errors from two passes of sums (k + 1 squared numbers)."""
    d = df.filter(X.all_finite([y, *xs])).select(y, *xs)
    names = ["intercept", *xs]
    col = lambda c: F.lit(1.0) if c == "intercept" else F.col(c).cast("double")
    k = len(names)
    first = d.agg(F.count("*").alias("n"), F.sum(F.col(y)).alias("s"), F.sum(F.col(y) * F.col(y)).alias("yy"), *[F.sum(col(a) * col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], *[F.sum(col(a) * F.col(y)).alias(f"h_{i}") for i, a in enumerate(names)]).first()
    n = first["n"]
    if n <= k:
        raise ValueError(f"{n} usable rows for {k} parameters")
    full = lambda r, p: np.array([[r[f"{p}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    inverse = np.linalg.pinv(full(first, "g"))
    beta = inverse @ np.array([first[f"h_{i}"] for i in range(k)], float)
    e = F.col(y) - sum((float(b) * col(c) for b, c in zip(beta, names)), F.lit(0.0))
    second = d.withColumn("_e2", e * e).agg(F.sum("_e2").alias("sse"), *[F.sum(F.col("_e2") * col(a) * col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    cov = inverse @ full(second, "m") @ inverse * (n / (n - k))
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    total = first["yy"] - first["s"] ** 2 / n
    r2 = 1 - second["sse"] / total if total > 0 else float("nan")
    return [{"term": t, "coef": float(b), "se_robust": float(s), "t": float(b / s) if s > 0 else None, "significant_5pct": bool(s > 0 and abs(b / s) > 1.96), "r2": float(r2), "n": n} for t, b, s in zip(names, beta, se)]


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    def ranks(d: DataFrame, c: str, name: str) -> DataFrame:
        ranked = cumulative(d.select(c), [c]).withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2)
        return d.join(ranked.select(c, name), c)

    d = ranks(ranks(df.select(x, y).dropna(), x, "_rx"), y, "_ry")
    return d.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the incomplete beta's continued fraction."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if flip else front * h
