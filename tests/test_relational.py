"""Hand-computable cases of the relational operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import binning as B
from tidewright.functions import exprs as X
from tidewright.operators import bars, book, contracts, joins, runs, universe, volatility

DAY = dt.date(2024, 1, 2)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def messages(spark, rows):
    """rows: (time, type, size, direction, mid)"""
    full = [("A", DAY, k, float(t), e, s, d, m) for k, (t, e, s, d, m) in enumerate(rows)]
    return frame(spark, full, "symbol string, dt date, seq long, time double, event_type int, size long, direction int, mid double")


def test_resting_side_and_hidden_prints(spark):
    m = messages(spark, [(34200, 4, 100, -1, 10.0), (34200.5, 5, 900, 1, 10.0), (34201, 4, 40, 1, 10.1)])
    got = [(r.sec, r.signed_vol, r.volume) for r in bars.from_messages(m).orderBy("sec").collect()]
    assert got == [(34200, 100.0, 100.0), (34201, -40.0, 40.0)]


def test_bins_exist_only_with_messages_and_mid_is_carried(spark):
    m = messages(spark, [(34200, 4, 10, -1, 10.0), (34201, 1, 5, 1, None), (34203, 1, 5, 1, None)])
    got = [(r.sec, r.volume, r.mid) for r in bars.from_messages(m).orderBy("sec").collect()]
    assert got == [(34200, 10.0, 10.0), (34201, 0.0, 10.0), (34203, 0.0, 10.0)]


def test_fine_bins(spark):
    m = messages(spark, [(34200.10, 4, 100, -1, 1.0), (34200.40, 4, 40, -1, 1.0), (34201.25, 4, 70, 1, 1.0)])
    got = [(round(r.sec, 6), r.signed_vol) for r in bars.from_messages(m, milliseconds=100).orderBy("sec").collect()]
    assert got == [(34200.1, 100.0), (34200.4, 40.0), (34201.2, -70.0)]
    assert dict(bars.from_messages(m).dtypes)["sec"] == "bigint"


def test_fill_runs(spark):
    rows = [(34200 + k, 4, 10, d, 100.0 + k) for k, d in enumerate([-1, -1, -1, 1, 1, -1])]
    shuffled = messages(spark, rows).orderBy(F.rand(3))
    got = sorted((r.run, r.sign, r.shares, r.n_fills) for r in runs.fill_runs(shuffled).collect())
    assert got == [(1, 1.0, 30.0, 3), (2, -1.0, 20.0, 2), (3, 1.0, 10.0, 1)]


def test_other_messages_do_not_break_a_run_and_mid_is_the_one_before(spark):
    m = messages(spark, [(1, 1, 1, 1, 100.01), (2, 4, 10, -1, 100.03), (3, 1, 1, 1, None), (4, 4, 10, -1, 100.05)])
    (r,) = runs.fill_runs(m).collect()
    assert (r.n_fills, r.mid_start, r.mid_end) == (2, 100.01, 100.05)


def burst(spark, flip=False):
    rows = []
    for s in range(600):
        on = 120 <= s < 240
        sign = -1 if flip and 180 <= s < 210 else 1
        rows.append(("A", DAY, 34200 + s, sign * 900.0 if on else 0.0, 1000.0 if on else 100.0, 100.0 if s < 180 else 101.0))
    b = frame(spark, rows, "symbol string, dt date, sec long, signed_vol double, volume double, mid double")
    return b, frame(spark, [("A", DAY, 168_000.0)], "symbol string, dt date, session_volume double")


def test_burst_is_one_order(spark):
    b, v = burst(spark)
    (r,) = runs.bin_metaorders(b, v).collect()
    assert (r.duration_seconds, r.Q) == (120, 108_000.0) and r.impact > 0
    assert runs.bin_metaorders(b, v, dominance=0.95).count() == 0
    assert runs.bin_metaorders(b, v, duration=150).count() == 0
    assert runs.bin_metaorders(b, v, size=0.9).count() == 0


def test_sign_flip_splits_and_a_missing_bin_ends_a_run(spark):
    b, v = burst(spark, flip=True)
    assert [r.sign for r in runs.bin_metaorders(b, v, duration=30).orderBy("bin_start").collect()] == [1, -1, 1]
    b, v = burst(spark)
    gap = b.filter("not (sec >= 34380 and sec < 34410)")
    assert runs.bin_metaorders(gap, v, duration=30).count() == 2


def test_prints_to_bars_and_day_volumes(spark):
    p = frame(spark, [("A", DAY, 1, 1, 10.0, 100.0, 1), ("A", DAY, 1, 2, 10.1, 50.0, -1), ("A", DAY, 1, 3, 10.2, 30.0, 0), ("A", DAY, 2, 4, 11.0, 20.0, 1)], "symbol string, dt date, sec long, seq long, price double, size double, sign int")
    first = bars.from_prints(p).orderBy("sec").first()
    assert (first.volume, first.signed_vol, first.mid) == (180.0, 50.0, 10.2)
    d = frame(spark, [("A", DAY, s, z) for s, z in ((20000, 10.0), (34200, 20.0), (34300, 30.0), (57600, 1000.0), (70000, 5.0))], "symbol string, dt date, sec long, size double")
    r = bars.day_volumes(d).first()
    assert (r.rth_volume, r.day_volume) == (50.0, 1065.0)


def test_tally_counts_a_trade_with_its_fill_once(spark):
    t = frame(spark, [("A", DAY, 1, 10), ("A", DAY, 2, 20)], "symbol string, dt date, sequence long, size long")
    f = t.filter("sequence = 1")
    h = t.filter("sequence = 2").withColumn("size", F.lit(7).cast("long"))
    r = bars.tally(f, t, h).first()
    assert (r.displayed, r.hidden, r.unmatched, r.total) == (10, 7, 20, 30)


def test_order_flow_imbalance(spark):
    rows = [(1, 10.0, 100.0, 10.1, 200.0), (2, 10.01, 300.0, 10.1, 200.0), (3, 10.0, 100.0, 10.1, 200.0), (4, 10.0, 140.0, 10.1, 200.0)]
    d = frame(spark, [("A", s, [b], [q], [a], [z]) for s, b, q, a, z in rows], "symbol string, seq long, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>")
    got = [r.ofi_0 for r in book.level_imbalances(d, ("symbol",), 1).orderBy("seq").collect()]
    assert got == [0.0, 300.0, -300.0, 40.0]


LADDER = "ask_px array<double>, ask_sz array<double>, bid_px array<double>, bid_sz array<double>"


def test_ladder_walk(spark):
    px, sz = [10.0, 10.01, 10.02], [100.0, 200.0, 300.0]
    d = joins.with_sizes(frame(spark, [(px, sz, [9.98], [100.0])], LADDER), [50, 100, 150, 300, 600, 601, 1])
    got = {r.x: r.v for r in d.select("x", book.walk(F.col("ask_px"), F.col("ask_sz"), F.col("x")).alias("v")).collect()}
    want = {50: 10.0, 100: 10.0, 150: (1000 + 50 * 10.01) / 150, 300: (1000 + 200 * 10.01) / 300, 600: (1000 + 200 * 10.01 + 300 * 10.02) / 600}
    for x, v in want.items():
        assert got[x] == pytest.approx(v, abs=1e-12)
    assert got[601] is None
    c = book.costs(frame(spark, [([10.0, 10.01], [100.0, 100.0], [9.98], [100.0])], LADDER).withColumn("x", F.lit(1.0))).first()
    assert (c.half_spread, c.buy_cost, c.sell_cost) == (pytest.approx(0.01), pytest.approx(0.01), pytest.approx(0.01))


def test_signed_power_and_grids(spark):
    d = frame(spark, [(float(v),) for v in (-400, -100, 0, 100, 400)], "v double")
    assert [r[0] for r in d.select(X.signed_power(F.col("v"), 0.5)).collect()] == [-20, -10, 0, 10, 20]
    s = frame(spark, [(34200,), (35999,), (36000,), (57599,), (34199,)], "s long")
    assert [r[0] for r in s.select(X.grid(F.col("s"), 1800)).collect()] == [0, 0, 1, 12, -1]
    assert [r[0] for r in s.select(X.grid(F.col("s"), 60)).collect()][:3] == [0, 29, 30]


def test_propagator_prediction(spark):
    d = frame(spark, [(100.0, 1.0, 1.0), (400.0, -1.0, 1.0), (900.0, 1.0, 3.0)], "q double, s double, n double")
    kernel = F.array(*[F.lit(v) for v in (2.0, 1.0, 0.5)])
    got = [r[0] for r in d.select(X.propagator_impact(kernel, F.col("q"), F.col("s"), F.col("n"), 0.5)).collect()]
    assert got == [pytest.approx(20.0), pytest.approx(40.0), pytest.approx(8.5 * 300**0.5)]


def test_execution_rate(spark):
    b = frame(spark, [("A", DAY, 34200 + k, v) for k, v in enumerate((0.0, 500.0, 500.0, 0.0, 0.0))], "symbol string, dt date, sec long, volume double")
    o = frame(spark, [("A", DAY, 1, 34201.0, 34202.5, 250.0), ("A", DAY, 2, 34203.0, 34204.0, 5.0)], "symbol string, dt date, order_id long, t_start double, t_end double, shares double")
    got = {r.order_id: r.rate for r in volatility.execution_rate(b, o).collect()}
    assert got == {1: 0.25, 2: None}


def test_trailing_spread_is_causal(spark):
    rng = np.random.default_rng(0)
    ret = rng.normal(0, 0.02, 50)

    def sigma(r):
        rows = [(1, DAY + dt.timedelta(k), float(v)) for k, v in enumerate(r)]
        return [x.sigma for x in volatility.trailing_spread(frame(spark, rows, "permno long, date date, ret double")).orderBy("date").collect()]

    base = sigma(ret)
    ret[30] = 0.5
    moved = sigma(ret)
    assert base[19] is None and base[20] is not None
    assert base[30] == moved[30] and moved[31] > base[31]
    assert base[20] == pytest.approx(np.std(np.log1p(ret[:20]), ddof=1))


def test_deciles_keep_ties_whole(spark):
    rng = np.random.default_rng(1)
    v = np.repeat(np.arange(1, 11), 4) + rng.normal(0, 1e-14, 40)
    d = frame(spark, [(float(x),) for x in rng.permutation(v)], "v double")
    got = B.deciles(d, "v", X.significant(F.col("v"))).groupBy("decile").count().orderBy("decile").collect()
    assert [(r["decile"], r["count"]) for r in got] == [(k, 4) for k in range(10)]


def test_qcut_matches_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    v = np.round(rng.exponential(1, 2000), 2)
    d = frame(spark, [(float(x), 1.0) for x in v], "x double, y double")
    got = [r.n for r in B.qcut_means(d, "x", "y", 12).orderBy("bin").collect()]
    assert got == pd.Series(pd.qcut(v, 12, duplicates="drop")).value_counts(sort=False).tolist()


NAMES = "ticker string, permno long, namedt date, nameendt date, shrcd int, exchcd int"


def test_names_at_a_date(spark):
    n = frame(spark, [("abc", 1111, dt.date(2000, 1, 1), dt.date(2010, 1, 1), 11, 1), ("ABC", 2222, dt.date(2010, 1, 2), None, 11, 1), ("x.y", 3, None, None, 12, 1), ("X.Y", 4, None, None, 11, None)], NAMES)
    pick = lambda at: {r.ticker: r.permno for r in joins.resolve_names(n, ["abc", "X.Y"], at).collect()}
    assert pick("2005-01-01") == {"ABC": 1111, "X-Y": 4}
    assert pick("2024-01-01") == {"ABC": 2222, "X-Y": 4}


def test_contracts(spark):
    a = frame(spark, [(1, 2.0), (2, 3.0)], "k long, v double")
    with pytest.raises(contracts.ContractError):
        contracts.many_to_one(a, frame(spark, [(1, "x")], "k long, n string"), ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.many_to_one(a, frame(spark, [(1, "x"), (1, "y"), (2, "z")], "k long, n string"), ["k"])
    assert contracts.same_rows(a, a).count() == 0
    assert contracts.differences(a, a.withColumn("v", F.col("v") + 1e-12), ["k"]).count() == 0
    assert contracts.differences(a, a.withColumn("v", F.col("v") + 1e-3), ["k"]).count() == 2
    assert sorted(r.match for r in contracts.matched(a, frame(spark, [(2, 1), (3, 1)], "k long, w int"), ["k"]).collect()) == ["both", "left_only", "right_only"]
    assert contracts.outside(a, F.col("v") > 2.5).count() == 1
    assert contracts.conserved(a, a.withColumnRenamed("v", "t"), ["k"], "v", "t").count() == 0
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["nope"])


def test_universe(spark):
    rng = np.random.default_rng(4)
    rows = [(f"S{k:03d}", float(t), float(v)) for k, (t, v) in enumerate(zip(np.exp(rng.uniform(-8, -3, 180)), np.exp(rng.uniform(10, 20, 180))))]
    cells = universe.strata(frame(spark, rows, "symbol string, relative_tick double, dollar_volume double"))
    assert cells.select("cell").distinct().count() == 9
    drawn, short = universe.draw(cells, 12)
    again, _ = universe.draw(cells.orderBy(F.rand(1)), 12)
    assert sorted(r.symbol for r in drawn.collect()) == sorted(r.symbol for r in again.collect())
    counts = {r.cell: (r.available, r.drawn) for r in universe.cell_counts(cells).collect()}
    assert drawn.count() == sum(d for _, d in counts.values()) and set(short) == {c for c, (a, _) in counts.items() if a < 12}


def test_donor_profiles(spark):
    rows = [("A", DAY + dt.timedelta(k), 0, float(k + 1)) for k in range(3)] + [("B", DAY, 0, 9.0)]
    s = frame(spark, rows, "symbol string, dt date, bucket long, ratio double")
    loso = {(r.symbol, (r.dt - DAY).days): r.multiplier for r in volatility.donor_profile(s, "loso").collect()}
    assert loso == {("A", 0): 2.5, ("A", 1): 2.0, ("A", 2): 1.5}
    prior = {(r.symbol, (r.dt - DAY).days): r.multiplier for r in volatility.donor_profile(s, "prior").collect()}
    assert prior == {("A", 1): 1.0, ("A", 2): 1.5}
