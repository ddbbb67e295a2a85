"""Exact order statistics and bins that are wide enough to fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import binning
from tidewright.operators import book


def test_located_values_of_any_size(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), np.full(800, 3.25), np.zeros(300), [-0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf, np.inf], 1 + rng.random(2000) * 1e-9])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(6)
    ranks = sorted({0, len(v) - 1, *rng.integers(0, len(v), 25).tolist()})
    got = {r._v: (r._n, r._before, r._all) for r in binning.located(df, F.col("v"), lambda n: F.array(*[F.lit(k).cast("long") for k in ranks])).collect()}
    own = np.sort(v)
    assert got == {float(own[k]): (int((v == own[k]).sum()), int((v < own[k]).sum()), len(v)) for k in ranks}
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    last = binning.located(nan, F.col("v"), lambda n: F.array(n - 1)).first()
    assert np.isnan(last._v) and last._before == 2
    assert binning.located(df.limit(0), F.col("v"), lambda n: F.array(n - 1)).collect() == []


@pytest.mark.parametrize("n", [1, 3, 10, 997])
def test_deciles_of_heavy_ties(spark, n):
    rng = np.random.default_rng(n)
    v, g = rng.integers(0, max(n // 4, 2), n), rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(k), float(x), int(y)) for k, (x, y) in enumerate(zip(v, g))], "k long, v double, g long")
    for by in ((), ("g",)):
        got = {r.k: r.decile for r in binning.deciles(df, "v", F.col("v"), by).collect()}
        for k in range(n):
            own = v[g == g[k]] if by else v
            assert got[k] == (2 * (own < v[k]).sum() + (own == v[k]).sum()) * 10 // (2 * len(own))


def test_participation_counts_books_that_are_too_shallow(spark):
    # Two books of one and of ten deep levels; sizes up to what one of them holds.
    px = lambda side: [100 + side * 0.01 * (k + 1) for k in range(2)]
    rows = [(1, px(1), [10.0, 10.0], px(-1), [10.0, 10.0]), (1, px(1), [10.0, 990.0], px(-1), [10.0, 990.0])]
    df = spark.createDataFrame(rows, "k long, ask_px array<double>, ask_sz array<double>, bid_px array<double>, bid_sz array<double>")
    scales = spark.createDataFrame([(1, 0.02, 1e6)], "k long, sigma double, volume double")
    sizes = [5.0, 15.0, 100.0, 500.0, 1000.0, 2000.0]
    got = book.session_bins(df, sizes, scales, "sigma", "volume", ["k"], 4).filter("side = 'buy' and size_normalisation = 'shares'").orderBy("bin").collect()
    mean = {r.bin: r["size"] for r in got}
    deep = {5.0: [1, 1], 15.0: [1, 1], 100.0: [0, 1], 500.0: [0, 1], 1000.0: [0, 1], 2000.0: [0, 0]}
    want = {}
    for x, own in deep.items():
        want.setdefault(min(mean, key=lambda b: (abs(np.log(x) - np.log(mean[b])), b)), []).extend(own)
    assert {r.bin: r.participating for r in got if r.participating is not None} == pytest.approx({b: np.mean(own) for b, own in want.items()})
    assert min(want, key=lambda b: np.mean(want[b])) == max(mean)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 31])
def test_medians_of_others_and_of_earlier_days(n):
    from tidewright.operators import volatility

    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 5, n).astype(float))
    middle = lambda v: np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else np.nan
    assert np.array_equal(volatility.left_out(values), [middle(np.delete(values, k)) for k in range(n)], equal_nan=True)
    assert np.array_equal(volatility.earlier(values), [middle(values[:k]) for k in range(n)], equal_nan=True)


def test_interval_join_makes_matches_only(spark):
    import datetime as dt

    from tidewright.operators import joins

    rng, day = np.random.default_rng(3), lambda k: dt.date(1999, 12, 20) + dt.timedelta(days=int(k))
    names = [(int(k % 3), f"n{k}", day(a) if k % 7 else None, day(a + rng.integers(-3, 900)) if k % 5 else None) for k, a in enumerate(rng.integers(0, 3000, 60))]
    # One key holds most facts.
    facts = [(0 if k % 10 else int(k // 10 % 4), day(a), k) for k, a in enumerate(rng.integers(-400, 4000, 700))] + [(0, None, 701)]
    f = spark.createDataFrame(facts, "key int, at date, id int")
    n = spark.createDataFrame(names, "key int, name string, a date, z date")
    joined = joins.valid_at(f, n, "key", "at", "a", "z")
    got = sorted((r.id, r.name) for r in joined.collect())
    want = sorted((i, m) for k, at, i in facts if at for q, m, a, z in names if k == q and (a or dt.date(1900, 1, 1)) <= at <= (z or dt.date(2100, 12, 31)))
    assert got == want and len(want) > 1000
    # A name's blocks are few, disjoint and hold just its days.
    for a, z in ((0, 0), (1, 6), (5, 4), (730_000, 730_365), (0, 3_652_058)):
        blocks = spark.range(1).select(joins.day_cells(F.lit(a), F.lit(z)).alias("b")).first().b
        assert len(blocks) <= 2 * joins.LEVELS and sum(2**b.level for b in blocks) == max(z - a + 1, 0)
        ends = sorted((b.cell * 2**b.level, (b.cell + 1) * 2**b.level) for b in blocks)
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:])) and (not ends or (ends[0][0], ends[-1][1]) == (a, z + 1))


def test_contest_over_tasks_is_the_contest(spark):
    from tidewright.operators import forms

    rng = np.random.default_rng(5)
    u, s = np.exp(rng.uniform(-3, 3, 60)), np.repeat([f"s{k}" for k in range(6)], 10)
    y, w = 2 * np.maximum(u, 0.8) ** 0.4 * (1 + 0.05 * rng.normal(size=60)), rng.integers(1, 9, 60).astype(float)
    order = np.lexsort((y, u, s))
    s, u, y, w = s[order], u[order], y[order], w[order]
    own = forms.FORMS[:2] + forms.FORMS[4:]
    want = {e.form: (k, e) for k, e in enumerate(forms.contest(s, u, y, w, own, 15), 1)}
    df = spark.createDataFrame(list(zip(s.tolist(), u.tolist(), y.tolist(), w.tolist())), "s string, u double, y double, w double").repartition(3)
    got = forms.contested(df, "s", "u", "y", "w", own, 15).collect()
    assert len(got) == len(own)
    for r in got:
        place, e = want[r.form]
        assert r.place == place and (r.wsse, r.aic, r.left_out) == pytest.approx((e.fit.wsse, e.fit.aic, e.left_out))
        assert (r.exponent_low is None) == np.isnan(e.interval[0]) and (np.isnan(e.interval[0]) or (r.exponent_low, r.exponent_high) == pytest.approx(e.interval))
    with pytest.raises(ValueError):
        forms.contested(df, "s", "u", "y", "w", own, 5, most=59)


def test_table_functions_check_their_arguments(spark):
    from pyspark.errors import PySparkException

    from tidewright.functions import tables

    tables.register(spark)
    spark.createDataFrame([("a", 0.1, 0.1, 1.0), ("a", 0.5, 0.4, 1.0), ("a", 2.0, 0.9, 1.0), ("b", 1.0, 1.0, 1.0)], "g string, q double, y double, w double").createOrReplaceTempView("tw_test")
    got = spark.sql("SELECT * FROM two_regime_fit(TABLE(tw_test) PARTITION BY g ORDER BY q)")
    assert got.columns == ["g", "a", "q_star", "wsse", "low", "high", "at_boundary"] and {r.g for r in got.collect()} == {"a", "b"}
    for text in ("form_fit(TABLE(tw_test) PARTITION BY g, form => 'power')", "two_regime_fit(TABLE(SELECT g, q FROM tw_test) PARTITION BY g)", "form_fit(TABLE(SELECT g, q AS u, y, w FROM tw_test) PARTITION BY g, form => 'none')"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {text}").collect()
