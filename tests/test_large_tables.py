"""Steps that only showed on larger tables: joins that repeat rows, shares of counts, sums made twice, wide windows, wide orders, first batches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins, kernels, models, studies, universe, volatility
from tidewright.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_an_interval_join_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 50)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    facts = [(1 if k % 2 else k % 7, day(k)) for k in range(200)]
    names = [(k % 7, day(10 * k), day(10 * k + 25), k) for k in range(30)]
    f = spark.createDataFrame(facts, "key int, at date")
    n = spark.createDataFrame(names, "key int, a date, z date, name int")
    joined = joins.valid_at(f, n, "key", "at", "a", "z")
    last = [line for line in plan(joined).splitlines() if "Join" in line][0]
    assert "SortMergeJoin" in last
    got = sorted((r.key, r["at"], r.name) for r in joined.collect())
    assert got == sorted((k, at, name) for k, at in facts for key, a, z, name in names if key == k and a <= at <= z)


def test_share_of_a_count_is_that_of_decimals(spark):
    assert int(1440 * 0.7) == 1007
    bars = spark.createDataFrame([("a", "d", 60 * k) for k in range(1440)], "symbol string, dt string, sec long")
    assert models.split_seconds(bars).first().split == 60 * 1008


def test_lag_fits_train_on_the_share_of_decimals(spark):
    rng = np.random.default_rng(1)
    rows = [("a", "d", k, float(rng.normal()), float(100 + rng.normal())) for k in range(1441)]
    df = spark.createDataFrame(rows, "symbol string, dt string, sec int, signed_vol double, mid double")
    r = kernels.calibrate(df, ("symbol", "dt"), lags=(0,), deltas=(0.5,)).first()
    assert (r.n_train, r.n_test) == (1008, 432)
    assert kernels.fit_lags(kernels.returns_of(np.array([x[4] for x in rows])), np.array([x[3] for x in rows]), 0, 0.5).n_train == 1008


def test_cells_keep_every_name_when_its_volume_is_summed_twice(spark):
    noisy = F.udf(lambda v: v * (1 + 1e-15 * random.randrange(1000)), "double").asNondeterministic()
    stats = spark.range(300).select(F.col("id").cast("string").alias("symbol"), (0.01 / (1 + F.col("id"))).alias("relative_tick"), noisy((1 + F.col("id") * 7 % 300).cast("double")).alias("dollar_volume"))
    cells = universe.strata(stats)
    assert cells.count() == 300 == cells.select("symbol").distinct().count()
    assert {r["volume_tercile"]: r["count"] for r in cells.groupBy("volume_tercile").count().collect()} == {"low": 100, "mid": 100, "high": 100}


def test_trailing_windows_without_a_frame_of_their_length(spark):
    rng = np.random.default_rng(3)
    sec = np.sort(rng.choice(3000, 500, replace=False)) - 200
    mid = np.where(sec < 900, 100.0, 100 + rng.normal(size=500).round(2))
    orders = [("a", "d", k, int(t), "xy"[k % 2]) for k, t in enumerate(rng.integers(-300, 3300, 400))] + [("a", "d", 900, None, "x")]
    b = spark.createDataFrame([("a", "d", int(s), float(m)) for s, m in zip(sec, mid)], "symbol string, dt string, sec long, mid double")
    o = spark.createDataFrame(orders, "symbol string, dt string, order_id long, at long, part string")
    found = volatility.trailing_sigma(b, o.unionByName(o.limit(1)), window=250, subset="part")
    assert "RangeFrame, -250" not in plan(found)
    got = {r.order_id: r.sigma for r in found.collect()}
    assert found.count() == len(orders) + 1
    sq, want = np.concatenate([[0.0], np.log(mid[1:] / mid[:-1]) ** 2]), {}
    for _, _, k, t, p in orders:
        own = sq[(sec >= t - 250) & (sec < t)] if t is not None else sq[:0]
        want[k] = p, np.sqrt(own.sum() / max(len(own), 1) * 23_400)
    rows = [want[r[2]] for r in [*orders, orders[0]]]  # the first order stands twice
    middle = {p: np.median([v for q, v in rows if q == p and v > 0]) for p in "xy"}
    assert got == pytest.approx({k: v if v > 0 else middle[p] for k, (p, v) in want.items()})


def test_schedules_are_priced_from_sums(spark):
    rng, n = np.random.default_rng(1), 6000
    start = np.sort(rng.uniform(34200, 34200 + n - 10, 1500))
    q = np.exp(rng.uniform(-12, -6, 1500))
    impact = 0.8 * 0.02 * np.sqrt(q) * np.exp(rng.normal(0, 0.05, 1500))
    rows = [("a", float(s), float(s + 1), float(x * 1e6), 1.0, 100.0, float(100 * np.exp(y))) for s, x, y in zip(start, q, impact)]
    profile, shape = np.linspace(0.5, 2, 13), np.full(390, 1 / 390)
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    o = spark.createDataFrame(rows, "symbol string, t_start double, t_end double, shares double, sign double, mid_start double, mid_end double")
    o = o.select("*", F.lit(1e6).alias("session_volume"), F.lit(0.02).alias("sigma_d"), F.lit(1e6).alias("adv"), array(profile).alias("profile"), array(shape).alias("shape"))
    b = spark.range(34200, 34200 + n).select(F.lit("a").alias("symbol"), F.col("id").alias("sec")).unionByName(spark.createDataFrame([("short", 34200)], "symbol string, sec long"))
    found = studies.evaluate_schedules(b, o, ("symbol",))
    assert "CoGroups" not in plan(found)
    got = {(r.symbol, r.schedule, r.pricing): r.cost for r in found.collect()}
    arrays = {c: np.array([r[k] for r in rows]) for k, c in enumerate(o.columns[:7]) if k}
    want = studies.price_schedules({"sec": 34200.0 + np.arange(n)}, arrays, 1e6, 0.02, 1e6, profile, shape)
    assert got == pytest.approx({("a", name, kind): c for name, kind, c in want})


def test_streamed_runs_of_days_that_sequence_numbers_mix(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 9)
    at = lambda day, k: start + dt.timedelta(days=day, seconds=k)
    rows = [("A", at(k % 3, k), k, 10.0, 1.0, 1 if k % 3 else -1) for k in range(30)] + [("A", at(9, 0), 100, 1.0, 1.0, 1)]
    source, made = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double, sign int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    live.fill_runs(stream).writeStream.format("parquet").option("checkpointLocation", made + "-log").trigger(availableNow=True).start(made).awaitTermination()
    got = sorted((r.first_seq, r.last_seq, r.sign, r.n_fills) for r in spark.read.parquet(made).collect())
    assert got == [(0, 27, -1, 10), (1, 28, 1, 10), (2, 29, 1, 10)]
