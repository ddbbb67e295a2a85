"""Distributed ranks, quantile edges and pooled lag fits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import binning
from tidewright.operators import fits, kernels, universe


def frame(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    # A third of all rows hold one value, and one group most rows.
    v = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(size=n), 2))
    g = np.where(rng.random(n) < 0.7, "a", rng.choice(["b", "c"], n))
    return v, g, spark.createDataFrame([(float(x), str(k)) for x, k in zip(v, g)], "v double, g string").repartition(7)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_cumulative(spark, by):
    v, g, df = frame(spark)
    for r in binning.cumulative(df, ["v"], by).collect():
        own = v[g == r.g] if by else v
        assert (r._n, r._before, r._all) == ((own == r.v).sum(), (own < r.v).sum(), len(own))


@pytest.mark.parametrize("bins", [1, 4, 12])
def test_edges(spark, bins):
    v, g, df = frame(spark)
    whole = binning.edges(df, F.col("v"), bins).first().edges
    assert np.allclose(whole, np.unique(np.quantile(v, np.linspace(0, 1, bins + 1))))
    for r in binning.edges(df, F.col("v"), bins, ["g"]).collect():
        assert np.allclose(r.edges, np.unique(np.quantile(v[g == r.g], np.linspace(0, 1, bins + 1))))


def test_edges_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (2.0, "a")], "v double, g string")
    assert binning.edges(df, F.col("v"), 3, ["g"]).first().edges == [2.0]
    assert binning.edges(df.limit(0), F.col("v"), 3, ["g"]).count() == 0


def test_draw_is_that_of_sorted_lists(spark):
    rows = [(f"c{k % 3}", f"s{k:03d}") for k in range(50)]
    picked, short = universe.draw(spark.createDataFrame(rows, "cell string, symbol string"), 17, 5)
    rng, want = np.random.default_rng(5), set()
    for cell in ("c0", "c1", "c2"):
        own = sorted(s for c, s in rows if c == cell)
        want |= set(rng.choice(np.array(own), size=min(17, len(own)), replace=False).tolist())
    assert {r.symbol for r in picked.collect()} == want and short == ["c2"]


def test_pooled_lags_of_one_session_are_the_session_fit(spark):
    rng = np.random.default_rng(3)
    flow = rng.normal(size=400) * 100
    ret = 1e-4 * np.sign(flow) * np.abs(flow) ** 0.5 + 3e-5 * np.roll(flow, 1) / 10 + rng.normal(size=400) * 1e-4
    mid = 100 * np.exp(np.cumsum(ret))
    rows = [("a", "d", k, float(flow[k]), float(mid[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, day string, sec int, signed_vol double, mid double")
    got = {(r.delta, r.n_lags): r for r in kernels.calibrate(df, ("symbol", "day"), ["symbol"], (0, 2), (0.5,), least=0).collect()}
    want = kernels.fit_lags(kernels.returns_of(mid), flow, 2, 0.5)
    r = got[0.5, 2]
    assert r.kernel == pytest.approx(want.kernel.tolist(), rel=1e-6)
    assert (r.r2_in, r.r2_out, r.n_train, r.n_test) == pytest.approx((want.r2_in, want.r2_out, want.n_train, want.n_test), rel=1e-6)
    assert sum(x.best for x in got.values()) == 1


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, 500)
    y = rng.integers(0, 9, 500) + x // 7
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    assert fits.spearman(df, "x", "y").first().rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
