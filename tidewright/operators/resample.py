"""Block bootstraps: draws on the driver, one pass over the data.

Draws follow ``numpy.random.default_rng(seed)`` over the groups in the order
given. Statistics are contracted from per-group sums, so a thousand draws read
the data once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame


def multiplicities(groups: Sequence, draws: int, seed: int = 0) -> np.ndarray:
    """How often each group occurs in each draw (draws, groups)."""
    rng, n = np.random.default_rng(seed), len(groups)
    return np.stack([np.bincount(rng.choice(n, size=n, replace=True), minlength=n) for _ in range(draws)]) if n else np.zeros((draws, 0), int)


def interval(values: np.ndarray, low: float = 2.5, high: float = 97.5) -> tuple[float, float]:
    ok = np.asarray(values, float)
    ok = ok[np.isfinite(ok)]
    return (float(np.percentile(ok, low)), float(np.percentile(ok, high))) if len(ok) else (float("nan"), float("nan"))


def group_sums(df: DataFrame, by: str, columns: Sequence) -> tuple[list, np.ndarray]:
    """Sorted groups and their sums, one row a group."""
    names = [f"_{k}" for k in range(len(columns))]
    from pyspark.sql import functions as F

    rows = df.groupBy(by).agg(*[F.sum(c).alias(n) for c, n in zip(columns, names)]).orderBy(by).collect()
    return [r[by] for r in rows], np.array([[r[n] or 0.0 for n in names] for r in rows], float).reshape(len(rows), len(names))


def contract(sums: np.ndarray, draws: np.ndarray, statistic: Callable[[np.ndarray], float]) -> np.ndarray:
    """The statistic of the summed sums of every draw."""
    return np.array([statistic(m @ sums) for m in draws])


def band(values: Sequence[float], draws: int = 4000, seed: int = 0) -> tuple[float, float]:
    """Bootstrap interval of the mean of finite values, by integer draws."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    if not len(v):
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    return interval(v[rng.integers(0, len(v), (draws, len(v)))].mean(axis=1))


def cluster(values: Sequence[float], groups: Sequence, statistic: Callable = np.median, draws: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Bootstrap interval of a statistic over values resampled by whole groups, in sorted order."""
    v, g = np.asarray(values, float), np.asarray(groups)
    names = np.unique(g)
    own = {n: v[g == n] for n in names}
    rng = np.random.default_rng(seed)
    return interval(np.array([statistic(np.concatenate([own[n] for n in rng.choice(names, size=len(names), replace=True)])) for _ in range(draws)]))
