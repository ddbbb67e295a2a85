"""Parameter recovery, optimality and closed forms of the fits and schedules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import book, fits, forms, kernels, models, resample, schedule


def test_power_recovers_level_and_exponent():
    rng = np.random.default_rng(0)
    q = np.exp(rng.uniform(np.log(1e-6), np.log(1e-2), 6000))
    sigma = rng.uniform(0.01, 0.03, 6000)
    p = fits.power_arrays(0.8 * sigma * q**0.37 + rng.normal(0, 1e-6, 6000), sigma, q)
    assert p.delta == pytest.approx(0.37, abs=0.005) and p.c == pytest.approx(0.8, rel=0.03)
    exact = fits.power_arrays(0.8 * sigma * q**0.5, sigma, q)
    assert exact.delta == pytest.approx(0.5, abs=1e-9)


def test_power_fits_per_group(spark):
    rng = np.random.default_rng(1)
    q = np.exp(rng.uniform(np.log(1e-5), np.log(1e-2), 400))
    rows = pd.DataFrame({"g": ["a"] * 200 + ["b"] * 200, "q": q, "s": 0.02, "y": 0.02 * q ** np.repeat([0.4, 0.6], 200)})
    got = {r.g: r.delta for r in fits.power_fits(spark.createDataFrame(rows), "y", "s", "q", ["g"]).collect()}
    assert got["a"] == pytest.approx(0.4, abs=1e-9) and got["b"] == pytest.approx(0.6, abs=1e-9)


def test_blend(spark):
    rng = np.random.default_rng(2)
    n = 4000
    d, t, q = rng.uniform(0.01, 0.02, n), rng.uniform(0.005, 0.03, n), np.exp(rng.uniform(-9, -4, n))
    f = spark.createDataFrame(pd.DataFrame({"d": d, "t": t, "q": q, "y": 0.9 * d**0.3 * t**0.7 * np.sqrt(q)}))
    r = fits.blend_alpha(f, "y", "d", "t", "q").first()
    assert r.alpha == pytest.approx(0.3, abs=0.02) and r.c == pytest.approx(0.9, abs=0.02)


def test_rate_model():
    rng = np.random.default_rng(3)
    q, rate = np.exp(rng.uniform(-12, -4, 6000)), rng.uniform(0.02, 1, 6000)
    c, delta, k = fits.rate_arrays(0.8 * q**0.45 * (1 + 0.15 * np.log(rate)), q, rate)
    assert (c, delta, k) == (pytest.approx(0.8, rel=0.03), pytest.approx(0.45, abs=0.02), pytest.approx(0.15, abs=0.02))
    c, _, k = fits.rate_arrays(-np.ones(100), q[:100], rate[:100])
    assert c > 0 and abs(k) * np.abs(np.log(rate[:100])).max() < 1


def test_two_regime():
    rng = np.random.default_rng(4)
    q = np.geomspace(1e-6, 1e-1, 200)
    y = 4 * np.where(q <= 5e-4, q, np.sqrt(5e-4 * q))
    f = fits.two_regime_arrays(q, y * np.exp(rng.normal(0, 0.001, 200)), np.ones(200))
    assert f["q_star"] == pytest.approx(5e-4, rel=0.05) and f["a"] == pytest.approx(4, rel=0.05) and not f["at_boundary"]
    assert fits.two_regime_arrays(q, np.sqrt(q), np.ones(200))["at_boundary"]


def test_published_fit_and_block_interval(spark):
    rng = np.random.default_rng(5)
    q = np.exp(rng.uniform(np.log(1e-4), np.log(1e-2), 4000))
    session = np.repeat([f"s{k}" for k in range(8)], 500)
    level = 0.7 * np.repeat(np.exp(rng.normal(0, 0.2, 8)), 500)
    rows = pd.DataFrame({"s": session, "q": q, "y": level * np.sqrt(q)})
    f = fits.published(spark.createDataFrame(rows.assign(y=0.7 * np.sqrt(q))), F.col("y"), "q", "s", 50)
    assert f["delta"] == pytest.approx(0.5, abs=0.005) and f["c_half"] == pytest.approx(0.7, rel=0.01)
    g = fits.published(spark.createDataFrame(rows), F.col("y"), "q", "s", 200)
    assert g["c_half_low"] < g["c_half"] < g["c_half_high"] and g["c_half_high"] - g["c_half_low"] > 0.01
    # A draw is what refitting the resampled rows gives.
    m = resample.multiplicities(sorted(set(session)), 1, 0)[0]
    w = np.repeat(m, 500)
    want = (w * np.sqrt(q) * rows["y"]).sum() / (w * q).sum()
    one = fits.published(spark.createDataFrame(rows), F.col("y"), "q", "s", 1)
    assert one["c_half_low"] == pytest.approx(want, rel=1e-9)


def test_ols_hc1(spark):
    rng = np.random.default_rng(6)
    n = 120
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 0.3 - 0.08 * a + 0.02 * b + rng.normal(0, 0.05, n) * (1 + np.abs(a))
    got = {r["term"]: r for r in fits.ols_hc1(spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b})), "y", ["a", "b"])}
    x = np.column_stack([np.ones(n), a, b])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    se = np.sqrt(np.diag(inv @ (x.T @ (e[:, None] ** 2 * x)) @ inv) * n / (n - 3))
    for k, t in enumerate(("intercept", "a", "b")):
        assert got[t]["coef"] == pytest.approx(beta[k], abs=1e-9) and got[t]["se_robust"] == pytest.approx(se[k], rel=1e-7)


def test_spearman_and_student(spark):
    d = pd.DataFrame({"x": [1, 2, 2, 4, 5, 6], "y": [3, 1, 1, 5, 9, 8]})
    assert fits.spearman(spark.createDataFrame(d), "x", "y").first().rho == pytest.approx(d.x.rank().corr(d.y.rank()))
    assert fits.student_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert fits.student_tail(1.0, 2) == pytest.approx(0.4226497, abs=1e-6)
    assert fits.student_tail(0.0, 5) == pytest.approx(1.0)


def test_lag_kernel_and_half_life():
    rng = np.random.default_rng(7)
    flow = rng.normal(size=6000)
    ret = np.convolve(flow, [3e-5, 1e-5, 4e-6])[:6000] + rng.normal(0, 1e-6, 6000)
    f = kernels.fit_lags(ret, flow, 2, 1.0)
    assert f.kernel == pytest.approx([3e-5, 1e-5, 4e-6], rel=0.05)
    assert np.isnan(kernels.lag_matrix(np.arange(5.0), 2)[0, 1:]).all() and kernels.lag_matrix(np.arange(5.0), 2)[2].tolist() == [2, 1, 0]
    assert kernels.half_life(np.array([1, -0.5, -0.25]), 2) == 1.0
    assert np.isnan(kernels.half_life(np.array([1, 0.5]), 1)) and np.isnan(kernels.half_life(np.array([1.0]), 1))


def test_level_responses():
    r = kernels.LevelResponse.of_returns([1, -0.5, -0.25])
    assert r.values == (1, 0.5, 0.25)
    assert kernels.LevelResponse.of_returns([1, 0, 0]).over(6).tolist() == [1] * 6
    with pytest.raises(ValueError):
        kernels.LevelResponse((1.0,), "refuse").over(2)
    with pytest.raises(TypeError):
        kernels.response_matrix([1, 0.5], 4)
    m = kernels.response_matrix(kernels.LevelResponse((1.0, -0.9, 0.9)), 5)
    assert m.projected and np.linalg.eigvalsh(m.matrix)[0] > 0
    m = kernels.response_matrix(kernels.LevelResponse(tuple(np.exp(-np.arange(20) / 5))), 20)
    x = schedule.minimum_impact(m, 100.0)
    best = schedule.quadratic_cost(x, m)
    rng = np.random.default_rng(8)
    for _ in range(20):
        step = rng.normal(size=20)
        assert schedule.quadratic_cost(x + step - step.mean(), m) >= best
    with pytest.raises(NotImplementedError):
        schedule.replay_session()


def test_replayed(spark):
    """Drift and impact of schedules against mid paths, by session, against sums in plain Python."""
    levels, rng, rows = [1.0, 0.5, 0.25], np.random.default_rng(4), []
    for name in ("a", "b"):
        for k in range(6):
            rows.append((name, k, float(rng.uniform(1, 9)), 10 + float(rng.normal()) / 10))
    frame = spark.createDataFrame(rows, "session string, slice int, shares double, mid double")
    for r in schedule.replayed(frame, levels, ["session"]).collect():
        x, mid = zip(*[(s, m) for name, _, s, m in rows if name == r.session])
        cost = 0.5 * sum(x[i] * x[j] * levels[min(abs(i - j), 2)] for i in range(6) for j in range(6))
        assert r.impact_cost == pytest.approx(cost)
        assert r.impact_per_share == pytest.approx(mid[0] * cost / sum(x))
        assert r.drift_per_share == pytest.approx(sum(a * b for a, b in zip(x, mid)) / sum(x) - mid[0])


def session(n=6000):
    rng = np.random.default_rng(9)
    flow = rng.normal(0, 100, n)
    mid = 100 * np.exp(np.cumsum(3e-6 * flow + rng.normal(0, 1e-7, n)))
    sec = 34200.0 + np.arange(n)
    start = sec[20:-20:20] + 0.5
    at = (start - 34200).astype(int)
    orders = {"t_start": start, "t_end": start.copy(), "shares": np.abs(flow[at]) + 1, "sign": np.sign(flow[at]), "mid_start": mid[at - 1], "mid_end": mid[at]}
    return {"sec": sec, "signed_vol": flow, "volume": np.abs(flow) * 2, "mid": mid}, orders


def test_models_on_a_linear_session(spark):
    b, o = session()
    split = b["sec"][4200]
    for k, v in {"t_start": split - 1, "t_end": split + 1, "shares": 10.0, "sign": 1.0, "mid_start": 100.0, "mid_end": 100.1}.items():
        o[k] = np.append(o[k], v)
    made, real, params = models.predictions(b, o, 1e6, 0.02)
    assert params["n_crossing"] == 1 and params["split_second"] == split
    assert models.score(real, made["propagator"])["r2_no_refit"] > 0.99
    assert "sqrt_tod_loso" not in made and "sqrt_tod_prior" not in made
    o["loso"] = np.ones(len(o["shares"]))
    assert models.predictions(b, o, 1e6, 0.02)[0]["sqrt_tod_loso"] == pytest.approx(made["sqrt"])
    bars = spark.createDataFrame(pd.DataFrame(b).assign(symbol="A", dt="d"))
    orders = spark.createDataFrame(pd.DataFrame(o).assign(symbol="A", dt="d", session_volume=1e6, sigma_d=0.02))
    out = {(r.model, r.metric): r.value for r in models.evaluate(bars, orders).collect()}
    assert out["parameters", "n_crossing"] == 1 and out["propagator", "r2_no_refit"] > 0.99
    assert {m for m, _ in out} == set(models.MODELS) - {"sqrt_tod_prior", "power_tod_prior"} | {"parameters"}


def test_forms():
    rng = np.random.default_rng(10)
    u = np.exp(rng.uniform(np.log(1e-3), np.log(30), 600))
    w = rng.uniform(50, 5000, 600)
    s = np.repeat(np.arange(15), 40)
    f = forms.fit(forms.POWER, u, 1.3 * u**0.4, w)
    assert f.theta == pytest.approx([1.3, 0.4], rel=1e-6)
    y = np.where(u <= 0.8, 1.0, (u / 0.8) ** 0.4)
    f = forms.fit(forms.PIECEWISE, u, y + rng.normal(0, 0.001, 600), w)
    assert f.theta == pytest.approx([1, 0.8, 0.4], rel=0.03)
    f = forms.fit(forms.LOG, u, 2 * np.log1p(u / 0.5) + rng.normal(0, 0.001, 600), w)
    assert f.theta == pytest.approx([2, 0.5], rel=0.02)
    y = 1.3 * u**0.4 * np.exp(rng.normal(0, 0.05, 600))
    rows = forms.contest(s, u, y, w, (forms.LINEAR, forms.POWER, forms.ATHL_06), 20)
    assert rows[0].form == "power" and rows[0].interval[0] < 0.4 < rows[0].interval[1] and forms.aic_gaps(rows)[0] == 0
    p = forms.exponent_profile(forms.POWER, u, y, w, [0.3, 0.4, 0.5])
    assert p[1].deviance == 0 and p[0].deviance > 3.841


@pytest.mark.parametrize("form", forms.FORMS)
def test_form_slopes_against_differences(form):
    u = np.geomspace(1e-3, 30, 50)
    shape = np.array([0.7, 0.4][: len(form.bounds)])
    for k, slope in enumerate(form.slopes(shape, u)):
        step = np.zeros(len(shape))
        step[k] = 1e-6
        assert slope == pytest.approx((form.basis(shape + step, u) - form.basis(shape - step, u)) / 2e-6, abs=1e-6)


def test_schedules():
    rng = np.random.default_rng(11)
    depth = rng.uniform(50, 300, 40)
    best = schedule.allocate(depth, 0.01, 0.5, 50_000)
    cost = schedule.piecewise_cost(best, depth, 0.01, 0.5)
    for _ in range(50):
        step = rng.normal(0, 5, 40)
        assert schedule.piecewise_cost(np.maximum(best + step - step.mean(), 0), depth, 0.01, 0.5) >= cost * (1 - 1e-12)

    def total(x, a):
        return schedule.piecewise_cost(x, depth, 0.01, 0.5) + a * 0.01**2 * (schedule.inventory(x, 50_000) ** 2).sum()

    a = 1e-4
    averse = schedule.allocate_averse(depth, 0.01, 0.5, 50_000, 0.01, a)
    assert averse.sum() == pytest.approx(50_000) and (averse >= 0).all() and averse[:10].sum() > best[:10].sum()
    for _ in range(100):
        step = rng.normal(0, 50, 40)
        moved = averse + step - step.mean()
        if (moved >= 0).all():
            assert total(moved, a) >= total(averse, a) * (1 - 1e-9)
    assert total(averse, a) <= total(best, a)
    assert schedule.sinh_schedule(5, 10, 0).tolist() == [2] * 5
    x = schedule.sinh_schedule(5, 10, 0.5)
    assert x.sum() == pytest.approx(10) and (np.diff(x) < 0).all()


def test_kkt_is_inverse_square_of_the_multiplier(spark):
    m = np.random.default_rng(12).uniform(0.3, 3, 60)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(60), "a": m, "w": 1 / m**2, "size": 1000.0}))
    x = np.array([r.shares for r in schedule.proportional(d, "w", "size", ["k"]).orderBy("t").collect()])
    assert x.sum() == pytest.approx(1000) and x * m**2 == pytest.approx(np.full(60, x[0] * m[0] ** 2), rel=1e-6)


def test_depth_spline_and_basis():
    t = np.arange(390.0)
    true = 500 + 300 * np.exp(-t / 40) + 200 * np.exp(-(389 - t) / 40)
    noisy = true + np.random.default_rng(13).normal(0, 15, 390)
    f = schedule.smooth_depth(t, noisy)
    assert np.abs(f["profile"] - true).mean() < 0.4 * np.abs(noisy - true).mean()
    b = schedule.basis(t, f["knots"])
    assert b.shape == (390, 10) and b.sum(axis=1) == pytest.approx(np.ones(390)) and b[-1, -1] == pytest.approx(1)


def test_principal_component_uses_training_rows(spark):
    rng = np.random.default_rng(14)
    common = rng.normal(size=3000)
    z = common[:, None] * np.linspace(1, 2, 5) + rng.normal(0, 0.3, (3000, 5))
    z[2000:] *= rng.normal(size=(1000, 5)) * 50
    d = spark.createDataFrame(pd.DataFrame(z, columns=[f"ofi_{k}" for k in range(5)]).assign(i=range(3000)))
    mean, sd, w = book.principal_weights(d, 5, F.col("i") < 2000)
    s = (z[:2000] - z[:2000].mean(0)) / z[:2000].std(0)
    v = np.linalg.svd(s - s.mean(0), full_matrices=False)[2][0]
    assert w == pytest.approx(v * np.sign(v[0]), abs=1e-6) and w[0] > 0


def test_bands():
    v = np.random.default_rng(0).normal(size=15)
    rng = np.random.default_rng(0)
    want = np.percentile(v[rng.integers(0, 15, (100, 15))].mean(axis=1), [2.5, 97.5])
    assert resample.band(v, 100, 0) == pytest.approx(tuple(want))
    low, high = resample.cluster(v, np.arange(15) // 3, np.median, 100)
    assert low <= np.median(v) <= high


def test_points_interpolate_power_sums():
    points, grid, matrix = fits.nodes((0.0, 3.0))
    rng = np.random.default_rng(15)
    lq = rng.normal(0, 2, 500)
    exact, at = (np.exp(2 * t[:, None] * lq).sum(axis=1) for t in (grid, points))
    assert matrix @ at == pytest.approx(exact, rel=1e-6)
