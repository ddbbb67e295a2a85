"""The model contest as one plan against the contest of arrays, and fits from sums against fits of rows."""

import numpy as np
import pytest

from tidewright.operators import fits, models


def test_rate_fits_from_sums_are_those_of_rows(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, (delta, k) in {"a": (0.5, 0.1), "b": (0.3, -0.05), "c": (0.7, -0.6), "d": (0.4, 0.0)}.items():
        q, rate = np.exp(rng.uniform(-9, -4, 300)), np.exp(rng.uniform(-3, 0, 300))
        y = 0.8 * q**delta * (1 + k * np.log(rate)) * (1 + 0.05 * rng.normal(size=300))
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(y, q, rate)]
        want[g] = fits.rate_arrays(y, q, rate)
    got = {r.g: (r.c, r.delta, r.k) for r in fits.rate_fits(spark.createDataFrame(rows, "g string, y double, q double, rate double"), "y", "q", "rate", ["g"]).collect()}
    for g, w in want.items():
        assert got[g] == pytest.approx(w, rel=2e-5, abs=1e-10)


def test_plan_scores_what_arrays_score(spark):
    rng = np.random.default_rng(9)
    bars, orders, want = [], [], {}
    for day in ("d1", "d2"):
        n = 900
        sec, flow = 34_200 + 20 * np.arange(n), rng.normal(size=n) * 300
        ret = 2e-6 * np.sign(flow) * np.abs(flow) ** 0.5 + 1e-6 * np.roll(flow, 1) / 20 + rng.normal(size=n) * 1e-5
        mid, volume = 100 * np.exp(np.cumsum(ret)), np.abs(flow) + rng.uniform(1, 50, n)
        bars += [("S", day, int(a), float(b), float(c), float(d)) for a, b, c, d in zip(sec, flow, volume, mid)]
        start = np.sort(rng.uniform(36_200, 51_500, 300))
        end, shares, sign = start + rng.uniform(5, 300, 300), np.exp(rng.uniform(0, 6, 300)), rng.choice([-1.0, 1.0], 300)
        impact = 0.02 * (shares / 1e5) ** 0.5 * (1 + 0.3 * rng.normal(size=300))
        loso = np.where(rng.random(300) < 0.1, np.nan, rng.uniform(0.5, 2, 300))
        prior = np.full(300, np.nan) if day == "d1" else loso[::-1].copy()
        o = {"t_start": start, "t_end": end, "shares": shares, "sign": sign, "mid_start": np.full(300, 100.0), "mid_end": 100 * np.exp(sign * impact), "loso": loso, "prior": prior}
        none = lambda x: None if np.isnan(x) else float(x)
        orders += [("S", day, k, *[none(v[k]) for v in o.values()], 1e5, 0.02) for k in range(300)]
        made, real, _ = models.predictions({"sec": sec, "signed_vol": flow, "volume": volume, "mid": mid}, o, 1e5, 0.02)
        want |= {(day, m): models.score(real, p) for m, p in made.items()}
    b = spark.createDataFrame(bars, "symbol string, dt string, sec int, signed_vol double, volume double, mid double")
    o = spark.createDataFrame(orders, "symbol string, dt string, order_id int, t_start double, t_end double, shares double, sign double, mid_start double, mid_end double, loso double, prior double, session_volume double, sigma_d double")
    got = {(r.dt, r.model): r for r in models.contest(b, o, ("symbol", "dt")).collect()}
    assert set(got) == set(want) and len(want) == 18
    for key, w in want.items():
        for name in ("n", "r2_no_refit", "r2_refit", "slope", "intercept", "mean_realised", "mean_predicted"):
            assert got[key][name] == pytest.approx(w[name], rel=1e-5, abs=1e-9), (key, name)
    assert models.contest(b, o, ("symbol", "dt"), least=400).collect() == []
