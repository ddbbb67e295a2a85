"""Queries over the star-schema tables, one or more per operator, with their SQL.

``@query(sql)`` registers a function and the DuckDB text that gives the same
rows. Doubles are rounded to six digits and integers widened on the way out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import binning as B
from tidewright.functions import exprs as X
from tidewright.functions import tables
from tidewright.operators import bars as bar
from tidewright.operators import book, contracts, fits, forms, joins, kernels, models, resample, runs, schedule, studies, universe, volatility
from tidewright.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ("symbol", "dt")


def tidy(df: DataFrame) -> DataFrame:
    kinds = {"double": lambda c: F.round(c, 6), "int": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar.from_prints(V.prints(spark, sf_dir), KEYS, 60)


# Bars -----------------------------------------------------------------------


@query(_with(V.PRINTS) + """SELECT symbol, dt, sec // 1800 * 1800 AS sec, round(SUM(size), 6) AS volume, round(SUM(size * sign), 6) AS signed_vol,
  round(arg_max(price, (sec, seq)), 6) AS mid FROM prints GROUP BY 1, 2, 3""")
def bars_from_prints(spark, d):
    return bar.from_prints(V.prints(spark, d), KEYS, 1800)


@query(_with(V.PRINTS, V.MESSAGES) + """, b AS (SELECT symbol, dt, CAST(floor("time" / 60) AS BIGINT) * 60 AS sec,
  SUM(CASE WHEN event_type = 4 THEN -direction * size ELSE 0 END) AS s, SUM(CASE WHEN event_type = 4 THEN size ELSE 0 END) AS v,
  arg_max(mid, seq) FILTER (WHERE mid IS NOT NULL) AS m FROM messages WHERE "time" >= 34200 AND "time" < 57600 GROUP BY 1, 2, 3)
  SELECT symbol, dt, sec, CAST(s AS DOUBLE) AS signed_vol, CAST(v AS DOUBLE) AS volume,
  round(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, dt ORDER BY sec ROWS UNBOUNDED PRECEDING), 6) AS mid FROM b""")
def bars_from_messages(spark, d):
    return bar.from_messages(V.messages(spark, d), KEYS, 60_000)


_DIR = """, bins AS (SELECT symbol, dt, sec // 1800 * 1800 AS bin, SUM(signed_vol) AS signed, SUM(volume) AS volume, arg_min(mid, sec) AS mid_first,
  arg_max(mid, sec) AS mid_last, COUNT(*) AS n FROM bars GROUP BY 1, 2, 3),
  dirs AS (SELECT *, abs(signed) / nullif(volume, 0) AS dominance,
  CAST(CASE WHEN abs(signed) / nullif(volume, 0) >= 0.3 AND signed <> 0 THEN sign(signed) ELSE 0 END AS BIGINT) AS direction FROM bins)"""


@query(_with(V.PRINTS, V.BARS) + _DIR + """ SELECT symbol, dt, bin, round(signed, 6) AS signed, round(volume, 6) AS volume, round(mid_first, 6) AS mid_first,
  round(mid_last, 6) AS mid_last, n, round(dominance, 6) AS dominance, direction FROM dirs""")
def bars_directional(spark, d):
    return bar.directional(minute_bars(spark, d), KEYS, 1800)


@query(_with(V.PRINTS) + """SELECT symbol, dt, round(SUM(CASE WHEN sec >= 34200 AND sec < 57600 THEN size ELSE 0 END), 6) AS rth_volume,
  round(SUM(size), 6) AS day_volume FROM prints GROUP BY 1, 2""")
def rth_vs_full_day_volume(spark, d):
    return bar.day_volumes(V.prints(spark, d), KEYS)


@query(_with(V.PRINTS) + """, v AS (SELECT symbol, dt, SUM(CASE WHEN sec >= 34200 AND sec < 57600 THEN size ELSE 0 END) / nullif(SUM(size), 0) AS r FROM prints GROUP BY 1, 2)
  SELECT symbol, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75 FROM v GROUP BY 1""")
def venue_ratio_quartiles(spark, d):
    v = bar.day_volumes(V.prints(spark, d), KEYS).withColumn("r", X.ratio(F.col("rth_volume"), F.col("day_volume")))
    return v.groupBy("symbol").agg(*[F.percentile("r", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])


@query(_with(V.PRINTS, V.MESSAGES) + """, f AS (SELECT symbol, dt, seq // 2 AS sequence, size FROM messages WHERE event_type = 4 AND direction = 1),
  t AS (SELECT symbol, dt, seq // 2 AS sequence, size FROM messages WHERE event_type = 4 AND direction = -1),
  h AS (SELECT symbol, dt, size FROM messages WHERE event_type = 5),
  p AS (SELECT symbol, dt, size AS a, 0 AS b, 0 AS c FROM f UNION ALL SELECT symbol, dt, 0, size, 0 FROM h
  UNION ALL SELECT symbol, dt, 0, 0, size FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol = t.symbol AND f.dt = t.dt AND f.sequence = t.sequence))
  SELECT symbol, dt, CAST(SUM(a) AS BIGINT) AS displayed, CAST(SUM(b) AS BIGINT) AS hidden, CAST(SUM(c) AS BIGINT) AS unmatched, CAST(SUM(a) + SUM(c) AS BIGINT) AS total FROM p GROUP BY 1, 2""")
def volume_tally(spark, d):
    m = V.messages(spark, d).withColumn("sequence", F.floor(F.col("seq") / 2))
    return bar.tally(m.filter("event_type = 4 and direction = 1"), m.filter("event_type = 4 and direction = -1"), m.filter("event_type = 5"), KEYS)


_CLOSES = """, c AS (SELECT symbol, dt, CAST(floor((sec - 34200) / 1800) AS BIGINT) AS bin, arg_max(price, (sec, seq)) AS close FROM prints GROUP BY 1, 2, 3),
  r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, dt ORDER BY bin)) AS ret FROM c)"""


@query(_with(V.PRINTS) + _CLOSES + """ SELECT symbol, dt, COUNT(*) AS n, CASE WHEN COUNT(*) >= 10 THEN round(stddev_samp(ret) * sqrt(13.0), 6) END AS sigma FROM r GROUP BY 1, 2""")
def realised_volatility(spark, d):
    return bar.realised_volatility(V.prints(spark, d), KEYS, 1800, 13)


@query(_with(V.PRINTS) + _CLOSES + """, w AS (SELECT symbol, dt, COUNT(*) AS bins, stddev_samp(ret) AS whole FROM r GROUP BY 1, 2),
  p AS (SELECT symbol, dt, CAST(floor(bin * 1800.0 / 7200) AS BIGINT) AS bucket, COUNT(*) AS n, stddev_samp(ret) AS part FROM r WHERE ret IS NOT NULL GROUP BY 1, 2, 3)
  SELECT symbol, dt, bucket, n, round(part / nullif(whole, 0), 6) AS ratio FROM p JOIN w USING (symbol, dt) WHERE bins >= 10 AND n >= 3 AND bucket BETWEEN 0 AND 12""")
def shape_from_prints(spark, d):
    return bar.shape_from_prints(V.prints(spark, d), KEYS, 1800, 7200)


_MID = """, mr AS (SELECT symbol, dt, sec, ln(mid / lag(mid) OVER (PARTITION BY symbol, dt ORDER BY sec)) AS ret,
  CAST(floor((sec - 34200) / 7200) AS BIGINT) AS bucket FROM bars),
  mw AS (SELECT symbol, dt, stddev_pop(ret) AS whole FROM mr GROUP BY 1, 2),
  shape AS (SELECT symbol, dt, bucket, COUNT(*) AS n, stddev_samp(ret) / whole AS ratio FROM mr JOIN mw USING (symbol, dt) WHERE ret IS NOT NULL AND whole > 0 GROUP BY symbol, dt, bucket, whole)"""


@query(_with(V.PRINTS, V.BARS) + _MID + " SELECT symbol, dt, bucket, n, round(ratio, 6) AS ratio FROM shape")
def shape_from_mids(spark, d):
    return bar.shape_from_mids(minute_bars(spark, d), KEYS, 7200)


def _donor(rule: str) -> str:
    return f""", mine AS (SELECT DISTINCT symbol, dt FROM shape), donor AS (SELECT m.symbol, m.dt, s.bucket, median(s.ratio) AS multiplier, COUNT(*) AS donors
  FROM mine m JOIN shape s ON s.symbol = m.symbol AND s.dt {rule} m.dt GROUP BY 1, 2, 3)"""


@query(_with(V.PRINTS, V.BARS) + _MID + _donor("<>") + " SELECT symbol, dt, bucket, round(multiplier, 6) AS multiplier, donors FROM donor")
def donor_profile_loso(spark, d):
    return volatility.donor_profile(bar.shape_from_mids(minute_bars(spark, d), KEYS, 7200), "loso")


@query(_with(V.PRINTS, V.BARS) + _MID + _donor("<") + " SELECT symbol, dt, bucket, round(multiplier, 6) AS multiplier, donors FROM donor")
def donor_profile_prior(spark, d):
    return volatility.donor_profile(bar.shape_from_mids(minute_bars(spark, d), KEYS, 7200), "prior")


@query(_with(V.PRINTS, V.BARS, V.ORDERS) + _MID + _donor("<") + """ SELECT order_id, round(sigma * COALESCE(CASE WHEN multiplier > 0 THEN multiplier END, 1), 6) AS scaled
  FROM mo LEFT JOIN donor d ON d.symbol = mo.symbol AND d.dt = mo.dt AND d.bucket = CAST(floor(("at" - 34200) / 7200) AS BIGINT)""")
def profile_sigma_lookup(spark, d):
    profile = volatility.donor_profile(bar.shape_from_mids(minute_bars(spark, d), KEYS, 7200), "prior")
    o = V.metaorders(spark, d).withColumnRenamed("sigma", "sigma_d")
    return volatility.profile_sigma(o, profile, "sigma_d", KEYS, 7200).select("order_id", F.col("sigma").alias("scaled"))


@query(_with(V.PRINTS, V.BARS) + """, s AS (SELECT symbol, dt, CAST(floor((sec - 34200) / 3600) AS BIGINT) AS slice, SUM(volume) AS v FROM bars GROUP BY 1, 2, 3)
  SELECT symbol, dt, slice, round(v, 6) AS volume, round(v / nullif(SUM(v) OVER (PARTITION BY symbol, dt), 0), 6) AS share FROM s""")
def minute_shares(spark, d):
    return bar.minute_shares(minute_bars(spark, d), KEYS, 3600)


@query(_with(V.PRINTS) + """SELECT symbol, sec // 3600 AS sec, seq FROM (SELECT symbol, sec, seq, row_number() OVER (PARTITION BY symbol, sec // 3600 ORDER BY seq DESC) AS r FROM prints) WHERE r = 1""")
def last_per_second(spark, d):
    p = V.prints(spark, d).withColumn("sec", F.floor(F.col("sec") / 3600))
    return bar.last_per_second(p, ("symbol",)).select("symbol", "sec", "seq")


# Projections ------------------------------------------------------------------


@query(_with(V.PRINTS, V.BARS) + "SELECT symbol, dt, sec, round(ln(mid / lag(mid) OVER (PARTITION BY symbol, dt ORDER BY sec)), 6) AS ret FROM bars")
def log_returns(spark, d):
    b = minute_bars(spark, d)
    return b.select(*KEYS, "sec", X.log_return(F.col("mid"), Window.partitionBy(*KEYS).orderBy("sec")).alias("ret"))


@query(_with(V.PRINTS, V.BARS) + "SELECT symbol, dt, sec, round(sign(signed_vol) * pow(abs(signed_vol), 0.5), 6) AS flow FROM bars")
def signed_power_flow(spark, d):
    return minute_bars(spark, d).select(*KEYS, "sec", X.signed_power(F.col("signed_vol"), 0.5).alias("flow"))


@query(_with(V.PRINTS, V.BARS) + """SELECT symbol, dt, sec, round(signed_vol, 6) AS lag_0, round(lag(signed_vol, 1) OVER w, 6) AS lag_1, round(lag(signed_vol, 2) OVER w, 6) AS lag_2
  FROM bars WINDOW w AS (PARTITION BY symbol, dt ORDER BY sec)""")
def lag_matrix(spark, d):
    return kernels.lag_columns(minute_bars(spark, d), "signed_vol", 2, KEYS).select(*KEYS, "sec", "lag_0", "lag_1", "lag_2")


@query(_with(V.PRINTS) + """SELECT side, round(SUM(size * CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END), 6) AS signed, COUNT(*) AS n FROM prints GROUP BY 1""")
def aggressor_sign_volume(spark, d):
    p = V.prints(spark, d)
    return p.groupBy("side").agg(F.sum(F.col("size") * X.aggressor_sign(F.col("side"))).alias("signed"), F.count("*").alias("n"))


@query(_with(V.PRINTS) + """SELECT symbol || '_' || CAST(dt AS VARCHAR) AS session, CAST(floor(sec * 1000000 / 250000) AS BIGINT) AS bin_250ms, CAST(floor((sec - 34200) / 1800.0) AS BIGINT) AS half_hour, COUNT(*) AS n FROM prints GROUP BY 1, 2, 3""")
def session_grid(spark, d):
    p = V.prints(spark, d)
    return p.groupBy(X.session_key(F.col("symbol"), F.col("dt")).alias("session"), X.bin_index(F.col("sec").cast("double"), 250).alias("bin_250ms"), X.grid(F.col("sec"), 1800).alias("half_hour")).agg(F.count("*").alias("n"))


@query(_with(V.ORDERS) + """SELECT order_id, round(pow(sigma, 0.3) * pow(trail, 0.7), 6) AS blended, round(0.8 * sigma * sqrt(q), 6) AS root, round(0.8 * sigma * pow(q, 0.4), 6) AS powered,
  round(sigma * 0.8 * pow(q, 0.45) * (1 + 0.1 * ln(least(greatest(shares / 50, 0.000001), 1.0))), 6) AS rated,
  round(2.0 * CASE WHEN q <= 0.002 THEN q ELSE sqrt(0.002 * q) END, 6) AS regimes FROM mo""")
def model_predictions(spark, d):
    o = V.metaorders(spark, d)
    rate = X.clipped_rate(F.col("shares"), F.lit(50.0))
    c = F.lit(0.8)
    return o.select(
        "order_id",
        X.blend(F.col("sigma"), F.col("trail"), 0.3).alias("blended"),
        X.sqrt_impact(c, F.col("sigma"), F.col("q")).alias("root"),
        X.power_impact(c, F.lit(0.4), F.col("sigma"), F.col("q")).alias("powered"),
        X.rate_impact(c, F.lit(0.45), F.lit(0.1), F.col("sigma"), F.col("q"), rate).alias("rated"),
        X.two_regime(F.lit(2.0), F.lit(0.002), F.col("q")).alias("regimes"),
    )


@query(_with(V.ORDERS) + """, k AS (SELECT unnest([0, 1, 2]) AS l, unnest([2.0, 1.0, 0.5]) AS g)
  SELECT order_id, round(SUM(greatest(1 + u - l, 0) * g) * sqrt(shares / (1 + u)), 6) AS predicted FROM mo, k GROUP BY order_id, shares, u""")
def propagator_prediction(spark, d):
    o = V.metaorders(spark, d)
    kernel = F.array(*[F.lit(x) for x in (2.0, 1.0, 0.5)])
    return o.select("order_id", X.propagator_impact(kernel, F.col("shares"), F.lit(1.0), (1 + F.col("u")).cast("double"), 0.5).alias("predicted"))


@query(_with(V.ORDERS) + """SELECT symbol, round(avg((sigma - m) / s), 6) AS z FROM (SELECT *, avg(sigma) OVER () AS m, stddev_pop(sigma) OVER () AS s FROM mo) GROUP BY 1""")
def z_scores(spark, d):
    o = V.metaorders(spark, d)
    stats = o.agg(F.avg("sigma").alias("m"), F.stddev_pop("sigma").alias("s"))
    return o.crossJoin(F.broadcast(stats)).groupBy("symbol").agg(F.avg((F.col("sigma") - F.col("m")) / F.col("s")).alias("z"))  # one row


# Runs -------------------------------------------------------------------------


@query(_with(V.PRINTS, V.MESSAGES) + """, f AS (SELECT *, last_value(mid IGNORE NULLS) OVER (PARTITION BY symbol, dt ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM messages),
  g AS (SELECT *, COALESCE(lag(m) OVER (PARTITION BY symbol, dt ORDER BY seq), m) AS mb FROM f),
  h AS (SELECT *, CASE WHEN -direction <> lag(-direction) OVER (PARTITION BY symbol, dt ORDER BY seq) THEN 1 WHEN lag(direction) OVER (PARTITION BY symbol, dt ORDER BY seq) IS NULL THEN 1 ELSE 0 END AS ch FROM g WHERE event_type = 4),
  i AS (SELECT *, SUM(ch) OVER (PARTITION BY symbol, dt ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM h)
  SELECT symbol, dt, CAST(run AS BIGINT) AS run, CAST(arg_min(-direction, seq) AS DOUBLE) AS sign, CAST(SUM(size) AS DOUBLE) AS shares, COUNT(*) AS n_fills, arg_min("time", seq) AS t_start, arg_max("time", seq) AS t_end,
  round(first(mb ORDER BY seq), 6) AS mid_start, round(last(m ORDER BY seq), 6) AS mid_end FROM i GROUP BY 1, 2, 3""")
def fill_runs(spark, d):
    return runs.fill_runs(V.messages(spark, d), KEYS)


_RUNS = _DIR + """, ch AS (SELECT *, CASE WHEN direction <> COALESCE(lag(direction) OVER w, 0) OR bin - COALESCE(lag(bin) OVER w, bin - 1800) <> 1800 THEN 1 ELSE 0 END AS c FROM dirs WINDOW w AS (PARTITION BY symbol, dt ORDER BY bin)),
  ru AS (SELECT *, SUM(c) OVER (PARTITION BY symbol, dt ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM ch),
  vol AS (SELECT symbol, dt, SUM(size) AS session_volume FROM prints GROUP BY 1, 2),
  br AS (SELECT symbol, dt, CAST(run AS BIGINT) AS run, MIN(direction) AS sign, SUM(signed) AS net, SUM(volume) AS gross, COUNT(*) AS n_bins, MIN(bin) AS bin_start, arg_min(mid_first, bin) AS mid_start, arg_max(mid_last, bin) AS mid_end
  FROM ru WHERE direction <> 0 GROUP BY 1, 2, 3),
  bo AS (SELECT br.*, session_volume, n_bins * 1800 AS duration_seconds, abs(net) AS Q, abs(net) / nullif(session_volume, 0) AS participation, sign * (ln(mid_end) - ln(mid_start)) AS impact FROM br JOIN vol USING (symbol, dt)
  WHERE n_bins * 1800 >= 1800 AND abs(net) / nullif(session_volume, 0) >= 0.0001)"""


def _bin_orders(spark, d):
    volumes = V.prints(spark, d).groupBy(*KEYS).agg(F.sum("size").alias("session_volume"))
    return runs.bin_metaorders(minute_bars(spark, d), volumes, KEYS, 1800, 0.3, 1800)


@query(_with(V.PRINTS, V.BARS) + _RUNS + """ SELECT symbol, dt, run, sign, round(net, 6) AS net, round(gross, 6) AS gross, n_bins, bin_start, round(mid_start, 6) AS mid_start, round(mid_end, 6) AS mid_end, round(session_volume, 6) AS session_volume,
  duration_seconds, round(Q, 6) AS "Q", round(participation, 6) AS participation, round(impact, 6) AS impact FROM bo""")
def bin_metaorders(spark, d):
    return _bin_orders(spark, d)


@query(_with(V.PRINTS, V.BARS) + _RUNS + " SELECT symbol, dt, run, round(sign * (mid_end - mid_start) / nullif(mid_start, 0), 6) AS impact_simple FROM bo")
def impact_simple(spark, d):
    return _bin_orders(spark, d).select(*KEYS, "run", X.impact_simple(F.col("sign"), F.col("mid_start"), F.col("mid_end")).alias("impact_simple"))


# Volatility and windows ---------------------------------------------------------


@query(_with(V.TAPE) + """, r AS (SELECT permno, date, volume / 1000 - 0.02 AS ret FROM daily), l AS (SELECT *, ln(1 + ret) AS lr FROM r)
  SELECT permno, date, CASE WHEN COUNT(lr) OVER w = 20 THEN round(stddev_samp(lr) OVER w, 6) END AS sigma FROM l WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def trailing_vol_20(spark, d):
    r = V.daily(spark, d).select("permno", "date", (F.col("volume") / 1000 - 0.02).alias("ret"))
    return volatility.trailing_spread(r).select("permno", "date", "sigma")


@query(_with(V.TAPE) + """, c AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY permno ORDER BY date)) AS ch FROM daily)
  SELECT permno, date, round(avg(volume) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS adv,
  round(stddev_samp(ch) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), 6) AS sigma_d FROM c""")
def trailing_adv_20(spark, d):
    return volatility.trailing_volume(V.daily(spark, d)).select("permno", "date", "adv", "sigma_d")


@query(_with(V.PRINTS, V.BARS, V.ORDERS) + """, r AS (SELECT symbol, dt, sec, COALESCE(pow(ln(mid / lag(mid) OVER (PARTITION BY symbol, dt ORDER BY sec)), 2), 0) AS sq FROM bars),
  v AS (SELECT o.order_id, o.symbol, o.dt, sqrt(COALESCE(SUM(sq), 0) / greatest(COUNT(sq), 1) * 23400) AS raw FROM mo o LEFT JOIN r ON r.symbol = o.symbol AND r.dt = o.dt AND r.sec >= o."at" - 7200 AND r.sec < o."at" GROUP BY 1, 2, 3),
  m AS (SELECT symbol, dt, median(raw) FILTER (WHERE raw > 0) AS mid FROM v GROUP BY 1, 2)
  SELECT order_id, round(COALESCE(CASE WHEN raw > 0 THEN raw END, mid), 6) AS sigma FROM v JOIN m USING (symbol, dt)""")
def trailing_sigma(spark, d):
    return volatility.trailing_sigma(minute_bars(spark, d), V.metaorders(spark, d), KEYS, 7200).select("order_id", "sigma")


@query(_with(V.PRINTS, V.BARS, V.ORDERS) + """SELECT o.order_id, CASE WHEN COALESCE(SUM(volume), 0) > 0 THEN round(least(greatest(o.shares / SUM(volume), 0.000001), 1), 6) END AS rate
  FROM mo o LEFT JOIN bars b ON b.symbol = o.symbol AND b.dt = o.dt AND b.sec >= o.at AND b.sec <= o.at + 3600 GROUP BY o.order_id, o.shares""")
def execution_rate(spark, d):
    o = V.metaorders(spark, d).withColumn("t_start", F.col("at").cast("double")).withColumn("t_end", F.col("at") + 3600.0)
    return volatility.execution_rate(minute_bars(spark, d), o, KEYS).select("order_id", "rate")


_SPLIT = """, rk AS (SELECT symbol, dt, sec, row_number() OVER (PARTITION BY symbol, dt ORDER BY sec) AS r, COUNT(*) OVER (PARTITION BY symbol, dt) AS n FROM bars),
  sp AS (SELECT symbol, dt, MIN(sec) AS "first", MAX(sec) AS "last", MAX(CASE WHEN r = floor(n * 0.7) + 1 THEN sec END) AS split FROM rk GROUP BY 1, 2)"""


@query(_with(V.PRINTS, V.BARS, V.ORDERS) + _SPLIT + """ SELECT order_id, CASE WHEN "at" >= sp."first" AND "at" + u * 60 <= sp."last" THEN CASE WHEN "at" >= split THEN 'test' WHEN "at" + u * 60 < split THEN 'train' ELSE 'crossing' END END AS side FROM mo JOIN sp USING (symbol, dt)""")
def train_test_split(spark, d):
    o = V.metaorders(spark, d).join(models.split_seconds(minute_bars(spark, d), KEYS), list(KEYS))
    return o.select("order_id", models.side(F.col("at"), F.col("at") + F.col("u") * 60, F.col("first"), F.col("last"), F.col("split")).alias("side"))


@query(_with(V.PRINTS, V.BARS) + _SPLIT + _MID + """ SELECT symbol, dt, round(stddev_pop(ret) FILTER (WHERE sec < split), 6) AS sigma_train, round(stddev_pop(ret) FILTER (WHERE sec >= split), 6) AS sigma_test,
  round(stddev_pop(ret) FILTER (WHERE sec >= split) / nullif(stddev_pop(ret) FILTER (WHERE sec < split), 0), 6) AS ratio FROM mr JOIN sp USING (symbol, dt) GROUP BY 1, 2""")
def volatility_shift(spark, d):
    b = minute_bars(spark, d)
    return volatility.spread_shift(b, models.split_seconds(b, KEYS).select(*KEYS, "split"), KEYS)


# Binning ------------------------------------------------------------------------

_EDGES = "list_distinct(quantile_cont({v}, [{p}]))"


def _points(bins: int) -> str:
    return ", ".join(repr(float(x)) for x in np.linspace(0, 1, bins + 1))


@query(_with(V.ORDERS) + f""", e AS (SELECT list_sort({_EDGES.format(v='q', p=_points(12))}) AS e FROM mo),
  b AS (SELECT q, realised, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM mo, e)
  SELECT CAST(bin AS BIGINT) AS bin, round(avg(q), 6) AS mean_q, round(avg(realised), 6) AS mean_realised, COUNT(*) AS n FROM b GROUP BY 1""")
def qcut_impact_bins(spark, d):
    return B.qcut_means(V.metaorders(spark, d), "q", "realised", 12)


@query(_with(V.ORDERS) + f""", o AS (SELECT *, round(ln(shares), 12) AS ls FROM mo), e AS (SELECT symbol, list_sort(list_distinct(list_transform({_EDGES.format(v='ls', p=_points(10))}, lambda x: round(x, 12)))) AS e FROM o GROUP BY 1),
  b AS (SELECT symbol, shares, realised, sigma, least(greatest(len(list_filter(e, lambda x: x <= ls)) - 1, 0), len(e) - 2) AS bin FROM o JOIN e USING (symbol))
  SELECT symbol, CAST(bin AS BIGINT) AS bin, round(avg(shares), 6) AS shares, COUNT(*) AS n, round(avg(realised), 6) AS realised, round(avg(sigma), 6) AS sigma, round(stddev_samp(realised), 6) AS cost_sd FROM b GROUP BY 1, 2""")
def log_equal_count_bins(spark, d):
    return B.log_bins(V.metaorders(spark, d), "shares", ["realised", "sigma"], 10, ["symbol"])


_DECILE = """, kk AS (SELECT *, CAST(format('{:.11e}', q) AS DOUBLE) AS key FROM mo), ct AS (SELECT symbol, key, COUNT(*) AS n FROM kk GROUP BY 1, 2),
  cu AS (SELECT *, SUM(n) OVER (PARTITION BY symbol ORDER BY key) AS cum, SUM(n) OVER (PARTITION BY symbol) AS al FROM ct),
  de AS (SELECT kk.*, CAST(floor((2 * cum - n) * 10.0 / (2 * al)) AS BIGINT) AS decile FROM kk JOIN cu USING (symbol, key))"""


@query(_with(V.ORDERS) + _DECILE + " SELECT order_id, decile FROM de")
def calibration_deciles(spark, d):
    return B.deciles(V.metaorders(spark, d), "q", X.significant(F.col("q")), ["symbol"]).select("order_id", "decile")


_TABLE = """, ta AS (SELECT symbol, decile, avg(q) AS predicted, avg(realised) AS realised, stddev_samp(realised) / sqrt(COUNT(*)) AS realised_se, COUNT(*) AS n FROM de GROUP BY 1, 2)"""


@query(_with(V.ORDERS) + _DECILE + _TABLE + " SELECT symbol, decile, round(predicted, 6) AS predicted, round(realised, 6) AS realised, round(realised_se, 6) AS realised_se, n, round(realised / nullif(predicted, 0), 6) AS ratio FROM ta")
def calibration_table(spark, d):
    return B.calibration(V.metaorders(spark, d), "realised", "q", X.significant(F.col("q")), ["symbol"])


@query(_with(V.ORDERS) + _DECILE + _TABLE + " SELECT decile, round(SUM(predicted * n) / SUM(n), 6) AS predicted, round(SUM(realised * n) / SUM(n), 6) AS realised, CAST(SUM(n) AS BIGINT) AS n, round(SUM(realised * n) / nullif(SUM(predicted * n), 0), 6) AS ratio FROM ta GROUP BY 1")
def pooled_calibration(spark, d):
    return models.pooled_calibration(B.calibration(V.metaorders(spark, d), "realised", "q", X.significant(F.col("q")), ["symbol"]), ())


_CELLS = """, u AS (SELECT *, row_number() OVER (ORDER BY relative_tick, symbol) * 1.0 / COUNT(*) OVER () AS a, row_number() OVER (ORDER BY dollar_volume, symbol) * 1.0 / COUNT(*) OVER () AS b FROM universe WHERE relative_tick > 0 AND dollar_volume > 0),
  ce AS (SELECT symbol, CASE WHEN a <= 1/3 THEN 'low' WHEN a <= 2/3 THEN 'mid' ELSE 'high' END || '_tick__' || CASE WHEN b <= 1/3 THEN 'low' WHEN b <= 2/3 THEN 'mid' ELSE 'high' END || '_volume' AS cell FROM u)"""


@query(_with(V.UNIVERSE) + _CELLS + " SELECT symbol, cell FROM ce")
def tercile_cells(spark, d):
    return universe.strata(V.universe(spark, d)).select("symbol", "cell")


@query(_with(V.UNIVERSE) + _CELLS + " SELECT cell, COUNT(*) AS available, least(COUNT(*), 12) AS drawn FROM ce GROUP BY 1")
def cell_counts(spark, d):
    return universe.cell_counts(universe.strata(V.universe(spark, d)))


@query()
def stratified_sample(spark, d):
    return universe.draw(universe.strata(V.universe(spark, d)).select("symbol", "cell"))[0]


@query(_with(V.UNIVERSE) + "SELECT symbol, round(relative_tick, 9) AS relative_tick FROM (SELECT * FROM universe ORDER BY relative_tick, symbol LIMIT 60)")
def nsmallest_tick(spark, d):
    return V.universe(spark, d).orderBy("relative_tick", "symbol").limit(60).select("symbol", F.format_number("relative_tick", 9).cast("decimal(18,9)").cast("double").alias("relative_tick"))


# Fits ---------------------------------------------------------------------------


@query(_with(V.ORDERS) + "SELECT symbol, round(SUM(sigma * sqrt(q) * realised) / SUM(sigma * sigma * q), 6) AS c FROM mo GROUP BY 1")
def sqrt_coefficient(spark, d):
    return V.metaorders(spark, d).groupBy("symbol").agg(fits.level(F.col("realised"), F.col("sigma") * F.sqrt("q")).alias("c"))


@query(_with(V.ORDERS) + """, p AS (SELECT symbol, realised AS y, sigma * sqrt(q) AS p FROM mo) SELECT symbol, COUNT(*) AS n, round(regr_r2(y, p), 6) AS r2_refit, round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept,
  round(avg(y), 6) AS mean_realised, round(avg(p), 6) AS mean_predicted, round(1 - SUM((y - p) * (y - p)) / regr_syy(y, p), 6) AS r2_no_refit FROM p GROUP BY 1""")
def fit_scores(spark, d):
    return fits.scores(V.metaorders(spark, d).withColumn("predicted", F.col("sigma") * F.sqrt("q")), "realised", "predicted", ["symbol"])


def _profile_sql(x: str, grid: np.ndarray, name: str) -> str:
    g = ", ".join(repr(float(v)) for v in grid)
    return f""", g AS (SELECT unnest([{g}]) AS {name}), s AS (SELECT symbol, {name}, SUM(({x}) * realised) AS A, SUM(({x}) * ({x})) AS B, SUM(realised * realised) AS yy, COUNT(*) AS n FROM mo, g GROUP BY 1, 2)
  SELECT symbol, round({name}, 6) AS {name}, round(A / B, 6) AS c, round(1000 * (yy - A * A / B), 6) AS sse, n FROM s"""


@query(_with(V.ORDERS) + _profile_sql("sigma * pow(q, delta)", np.linspace(0, 1.5, 31), "delta"))
def power_profile_grid(spark, d):
    t = fits.profile(V.metaorders(spark, d), F.col("realised"), F.col("sigma") * F.pow("q", F.col("delta")), np.linspace(0, 1.5, 31).tolist(), ["symbol"], "delta")
    return t.select("symbol", "delta", "c", (1000 * F.col("sse")).alias("sse"), "n")


@query(_with(V.ORDERS) + _profile_sql("pow(sigma, alpha) * pow(trail, 1 - alpha) * sqrt(q)", np.linspace(0, 1, 21), "alpha"))
def blend_grid(spark, d):
    x = X.blend(F.col("sigma"), F.col("trail"), F.col("alpha")) * F.sqrt("q")
    t = fits.profile(V.metaorders(spark, d), F.col("realised"), x, np.linspace(0, 1, 21).tolist(), ["symbol"], "alpha")
    return t.select("symbol", "alpha", "c", (1000 * F.col("sse")).alias("sse"), "n")


def _least_sql(x: str, grid: np.ndarray, name: str) -> str:
    g = ", ".join(repr(float(v)) for v in grid)
    return f""", g AS (SELECT unnest([{g}]) AS {name}), s AS (SELECT symbol, {name}, SUM(({x}) * realised) AS A, SUM(({x}) * ({x})) AS B, SUM(realised * realised) AS yy, COUNT(*) AS n FROM mo, g GROUP BY 1, 2)
  SELECT symbol, round(arg_min({name}, (yy - A * A / B, {name})), 6) AS {name}, round(arg_min(A / B, (yy - A * A / B, {name})), 6) AS c, MAX(n) AS n FROM s GROUP BY 1"""


@query(_with(V.ORDERS) + _least_sql("pow(sigma, alpha) * pow(trail, 1 - alpha) * sqrt(q)", np.linspace(0, 1, 101), "alpha"))
def blend_alpha(spark, d):
    return fits.blend_alpha(V.metaorders(spark, d), "realised", "sigma", "trail", "q", ["symbol"]).select("symbol", "alpha", "c", "n")


@query(_with(V.ORDERS) + _least_sql("sigma * pow(q, delta)", np.linspace(0, 1.5, 151), "delta"))
def power_least(spark, d):
    grid = fits.profile(V.metaorders(spark, d), F.col("realised"), F.col("sigma") * F.pow("q", F.col("delta")), np.linspace(0, 1.5, 151).tolist(), ["symbol"], "delta")
    return fits.lowest(grid, ["symbol"], "delta").select("symbol", "delta", "c", "n")


#: Sums at exponents of step 0.0025: levels, products and their slopes.
_POWER_SUMS = """, f AS (SELECT symbol, ln(q) AS l, {y} AS y, {scale} AS s FROM mo), g AS (SELECT unnest(range(0, 601)) AS j), x AS (SELECT symbol, j, y, l, s * exp(l * j * 0.0025) AS x FROM f, g),
  s AS (SELECT symbol, j, SUM(x * y) AS a, SUM(x * x) AS b, SUM(x * y * l) AS da, 2 * SUM(x * x * l) AS db, COUNT(*) AS n FROM x GROUP BY 1, 2)"""


def _root_sql(key: str, step: float = 0.0025) -> str:
    """Exponent and level by ``key`` from sums ``s``: the root of the error's slope between grid points, by cubics through four of them."""
    others = lambda i: [k for k in range(4) if k != i]
    root = " + ".join(f"d{i} * " + " * ".join(f"g{k} / (g{k} - g{i})" for k in others(i)) for i in range(4))
    level = " + ".join(f"v{i} * " + " * ".join(f"(d - d{k}) / (d{i} - d{k})" for k in others(i)) for i in range(4))
    at = ", ".join(f"MAX(CASE WHEN e.j = p.j + {i - 1} THEN {c} END) AS {n}{i}" for i in range(4) for n, c in (("d", f"e.j * {step}"), ("g", "e.g"), ("v", "e.v")))
    return f""", e AS (SELECT {key}, j, 2 * da / a - db / b AS g, ln(a / b) AS v, a * a / b AS fall, n FROM s WHERE a > 0), k AS (SELECT {key}, arg_max(j, fall) AS best, MAX(n) AS n FROM e GROUP BY 1),
  p AS (SELECT u.{key}, u.j FROM e u JOIN e w ON u.{key} = w.{key} AND w.j = u.j + 1 JOIN k ON k.{key} = u.{key} WHERE u.j IN (best - 1, best) AND sign(u.g) <> sign(w.g)),
  q AS (SELECT e.{key}, {at} FROM e JOIN p ON e.{key} = p.{key} GROUP BY 1), o AS (SELECT *, {root} AS d FROM q), z AS (SELECT o.{key}, d, exp({level}) AS c, n FROM o JOIN k ON o.{key} = k.{key})"""


@query(_with(V.ORDERS) + _POWER_SUMS.format(y="realised", scale="sigma") + _root_sql("symbol") + " SELECT symbol, round(c, 6) AS c, round(d, 6) AS delta, n FROM z")
def power_fits(spark, d):
    return fits.power_fits(V.metaorders(spark, d), "realised", "sigma", "q", ["symbol"]).select("symbol", "c", "delta", "n")


_CROSS = np.geomspace(1e-4, 1e-2, 40)


@query(_with(V.ORDERS) + f""", e AS (SELECT list_sort({_EDGES.format(v='q', p=_points(20))}) AS e FROM mo),
  b AS (SELECT q, realised, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM mo, e), m AS (SELECT avg(q) AS q, avg(realised) AS y, COUNT(*) AS w FROM b GROUP BY bin),
  g AS (SELECT unnest([{', '.join(repr(float(v)) for v in _CROSS)}]) AS q_star), x AS (SELECT q_star, w, y, CASE WHEN q <= q_star THEN q ELSE sqrt(q_star * q) END AS x FROM m, g),
  s AS (SELECT q_star, COUNT(*) AS n, SUM(w * x * y) / SUM(w * x * x) AS a, SUM(w * y * y) - SUM(w * x * y) * SUM(w * x * y) / SUM(w * x * x) AS wsse FROM x GROUP BY 1)
  SELECT round(q_star, 6) AS q_star, round(a, 6) AS a, round(wsse, 6) AS wsse, round(n * ln(wsse / MIN(wsse) OVER ()), 4) AS deviance FROM s""")
def two_regime_profile(spark, d):
    bins = B.qcut_means(V.metaorders(spark, d), "q", "realised", 20)
    return fits.two_regime_profile(bins, "mean_q", "mean_realised", "n", _CROSS.tolist()).withColumn("deviance", F.round("deviance", 4))


@query(_with(V.ORDERS) + f""", z AS (SELECT symbol, q, CASE WHEN q <= 0.003 THEN q ELSE sqrt(0.003 * q) END * (1 + 0.1 * (u % 3)) AS y FROM mo), e AS (SELECT symbol, list_sort({_EDGES.format(v='q', p=_points(20))}) AS e FROM z GROUP BY symbol),
  b AS (SELECT symbol, q, y, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM z JOIN e USING (symbol)), m AS (SELECT symbol, avg(q) AS q, avg(y) AS y, COUNT(*) AS w FROM b GROUP BY symbol, bin),
  n AS (SELECT symbol, ln(MIN(q)) AS lo, ln(MAX(q)) AS hi FROM m GROUP BY 1), g AS (SELECT symbol, w, y, q, k, exp(lo + k * (hi - lo) / 199) AS c FROM m JOIN n USING (symbol), (SELECT unnest(range(0, 200)) AS k)),
  x AS (SELECT symbol, k, c, w, y, CASE WHEN q <= c THEN q ELSE sqrt(c * q) END AS x FROM g), s AS (SELECT symbol, k, MAX(c) AS c, SUM(w * x * y) / SUM(w * x * x) AS a, SUM(w * y * y) - SUM(w * x * y) * SUM(w * x * y) / SUM(w * x * x) AS sse FROM x GROUP BY 1, 2),
  r AS (SELECT symbol, arg_min(k, (sse, k)) AS k, arg_min(c, (sse, k)) AS c, arg_min(a, (sse, k)) AS a FROM s GROUP BY 1) SELECT symbol, round(c, 6) AS q_star, round(a, 6) AS a, k > 0 AND k < 199 AS interior FROM r WHERE k > 0 AND k < 199""")
def interior_crossovers(spark, d):
    """Crossovers of a linear and a square-root branch by symbol, those at an end left out."""
    y = F.when(F.col("q") <= 0.003, F.col("q")).otherwise(F.sqrt(0.003 * F.col("q"))) * (1 + 0.1 * (F.col("u") % 3))
    bins = B.qcut_means(V.metaorders(spark, d).withColumn("y", y), "q", "y", 20, ["symbol"])
    return fits.interior(fits.crossovers(bins, "mean_q", "mean_y", "n", ["symbol"])).select("symbol", "q_star", "a", "interior")


@query(_with(V.ORDERS) + _POWER_SUMS.format(y="realised", scale="sigma") + _root_sql("symbol") + " SELECT symbol, round(c, 6) AS c, round(d, 6) AS delta, n AS rows FROM z")
def sql_power_fits(spark, d):
    """Power fits called from SQL, over sums that the same SQL makes."""
    tables.register(spark)
    V.metaorders(spark, d).createOrReplaceTempView("tw_orders")
    points = ", ".join(repr(float(x)) for x in fits.nodes((0.0, 1.5))[0])
    return spark.sql(f"""WITH c AS (SELECT avg(ln(q)) AS center FROM tw_orders), x AS (SELECT symbol, theta, realised AS y, sigma * exp(theta * (ln(q) - center)) AS x FROM tw_orders, c LATERAL VIEW explode(array({points})) AS theta),
      s AS (SELECT symbol, theta, sum(x * y) AS A, sum(x * x) AS B, count(*) AS n FROM x GROUP BY symbol, theta)
      SELECT * FROM power_fit(TABLE(s) PARTITION BY symbol ORDER BY theta, center => {V.metaorders(spark, d).agg(F.avg(F.ln("q"))).first()[0]!r}D)""")


@query(_with(V.ORDERS) + f""", z AS (SELECT symbol, q, CASE WHEN q <= 0.003 THEN q ELSE sqrt(0.003 * q) END * (1 + 0.1 * (u % 3)) AS y FROM mo), e AS (SELECT symbol, list_sort({_EDGES.format(v='q', p=_points(20))}) AS e FROM z GROUP BY symbol),
  b AS (SELECT symbol, q, y, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM z JOIN e USING (symbol)), m AS (SELECT symbol, avg(q) AS q, avg(y) AS y, COUNT(*) AS w FROM b GROUP BY symbol, bin),
  n AS (SELECT symbol, ln(MIN(q)) AS lo, ln(MAX(q)) AS hi, COUNT(*) AS bins FROM m GROUP BY 1), g AS (SELECT symbol, bins, w, y, q, k, exp(lo + k * (hi - lo) / 199) AS c FROM m JOIN n USING (symbol), (SELECT unnest(range(0, 200)) AS k)),
  x AS (SELECT symbol, bins, k, c, w, y, CASE WHEN q <= c THEN q ELSE sqrt(c * q) END AS x FROM g), s AS (SELECT symbol, k, MAX(bins) AS bins, MAX(c) AS c, SUM(w * x * y) / SUM(w * x * x) AS a, SUM(w * y * y) - SUM(w * x * y) * SUM(w * x * y) / SUM(w * x * x) AS sse FROM x GROUP BY 1, 2),
  r AS (SELECT symbol, MIN(sse) AS least, arg_min(c, (sse, k)) AS c, arg_min(a, (sse, k)) AS a FROM s GROUP BY 1) SELECT symbol, round(r.a, 6) AS a, round(r.c, 6) AS q_star, round(MIN(CASE WHEN bins * ln(sse / least) <= 3.841 THEN s.c END), 6) AS low, round(MAX(CASE WHEN bins * ln(sse / least) <= 3.841 THEN s.c END), 6) AS high FROM s JOIN r USING (symbol) GROUP BY 1, 2, 3""")
def sql_two_regime_fits(spark, d):
    """Crossovers with their intervals by a table function."""
    tables.register(spark)
    y = F.when(F.col("q") <= 0.003, F.col("q")).otherwise(F.sqrt(0.003 * F.col("q"))) * (1 + 0.1 * (F.col("u") % 3))
    bins = B.qcut_means(V.metaorders(spark, d).withColumn("y", y), "q", "y", 20, ["symbol"])
    bins.select("symbol", F.col("mean_q").alias("q"), F.col("mean_y").alias("y"), F.col("n").alias("w")).createOrReplaceTempView("tw_bins")
    return spark.sql("SELECT symbol, a, q_star, low, high FROM two_regime_fit(TABLE(tw_bins) PARTITION BY symbol ORDER BY q)")


@query(_with(V.ORDERS) + "SELECT symbol, round(regr_slope(ln(realised), ln(q)), 6) AS exponent, round(regr_intercept(ln(realised), ln(q)), 6) AS log_level, round(regr_r2(ln(realised), ln(q)), 6) AS r2, COUNT(*) AS n FROM mo GROUP BY 1")
def log_log_fit(spark, d):
    return fits.log_log(V.metaorders(spark, d), "q", "realised", ["symbol"])


@query(_with(V.ORDERS) + f""", e AS (SELECT list_sort({_EDGES.format(v='q', p=_points(12))}) AS e FROM mo),
  b AS (SELECT q, realised, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM mo, e), m AS (SELECT avg(q) AS x, avg(realised) AS y FROM b GROUP BY bin)
  SELECT round(regr_slope(ln(y), ln(x)), 6) AS exponent, round(regr_intercept(ln(y), ln(x)), 6) AS log_level, round(regr_r2(ln(y), ln(x)), 6) AS r2, COUNT(*) AS n FROM m WHERE x > 0 AND y > 0""")
def impact_law(spark, d):
    return fits.impact_law(V.metaorders(spark, d), "q", "realised", 12)


@query(_with(V.ORDERS) + "SELECT round(corr(sigma, realised), 6) AS r, COUNT(*) AS n FROM mo")
def corr_pearson(spark, d):
    return V.metaorders(spark, d).agg(F.corr("sigma", "realised").alias("r"), F.count("*").alias("n"))


@query(_with(V.ORDERS) + """, r AS (SELECT rank() OVER (ORDER BY u) + (COUNT(*) OVER (PARTITION BY u) - 1) / 2.0 AS a, rank() OVER (ORDER BY realised) + (COUNT(*) OVER (PARTITION BY realised) - 1) / 2.0 AS b FROM mo)
  SELECT round(corr(a, b), 6) AS rho, COUNT(*) AS n FROM r""")
def corr_spearman(spark, d):
    return fits.spearman(V.metaorders(spark, d), "u", "realised")


@query(_with(V.ORDERS) + """, b AS (SELECT regr_slope(realised, q) AS s, regr_intercept(realised, q) AS i, COUNT(*) AS n, avg(q) AS m, var_pop(q) * COUNT(*) AS sxx FROM mo),
  e AS (SELECT SUM(pow(realised - i - s * q, 2) * pow(q - m, 2)) AS meat FROM mo, b)
  SELECT 'q' AS term, round(s, 6) AS coef, round(sqrt(meat / (sxx * sxx) * n / (n - 2)), 6) AS se_robust, round(s / sqrt(meat / (sxx * sxx) * n / (n - 2)), 3) AS t FROM b, e""")
def ols_hc1(spark, d):
    rows = [r for r in fits.ols_hc1(V.metaorders(spark, d), "realised", ["q"]) if r["term"] == "q"]
    return spark.createDataFrame([(r["term"], r["coef"], r["se_robust"], round(r["t"], 3)) for r in rows], "term string, coef double, se_robust double, t double")


_DRAWS = 200
#: The five event types of the driver's tables, in order, are the blocks; draw 0 is all of them once.
_TIMES = ", ".join(f"({t}, {k}, {m})" for t, row in enumerate([[1] * 5, *resample.multiplicities(range(5), _DRAWS).tolist()]) for k, m in enumerate(row))


@query(_with(V.ORDERS) + _POWER_SUMS.format(y="realised / sigma", scale="1.0").replace("s AS (SELECT symbol", "own AS (SELECT symbol") + f""", m(t, k, m) AS (VALUES {_TIMES}), b AS (SELECT own.*, dense_rank() OVER (ORDER BY symbol) - 1 AS k FROM own),
  s AS (SELECT t, j, SUM(m * a) AS a, SUM(m * b) AS b, SUM(m * da) AS da, SUM(m * db) AS db, CAST(SUM(m * n) AS BIGINT) AS n FROM b JOIN m USING (k) GROUP BY 1, 2)""" + _root_sql("t") + """, h AS (SELECT t, a / b AS h FROM s WHERE j = 200)
  SELECT round(MAX(CASE WHEN t = 0 THEN c END), 6) AS c_free, round(MAX(CASE WHEN t = 0 THEN h END), 6) AS c_half, round(quantile_cont(h, 0.975) FILTER (WHERE t > 0), 6) AS c_half_high, round(quantile_cont(h, 0.025) FILTER (WHERE t > 0), 6) AS c_half_low,
  round(MAX(CASE WHEN t = 0 THEN d END), 6) AS delta, round(quantile_cont(d, 0.975) FILTER (WHERE t > 0), 6) AS delta_high, round(quantile_cont(d, 0.025) FILTER (WHERE t > 0), 6) AS delta_low, MAX(CASE WHEN t = 0 THEN n END) AS n FROM z JOIN h USING (t)""")
def published_fit(spark, d):
    o = V.metaorders(spark, d)
    f = fits.published(o, F.col("realised") / F.col("sigma"), "q", "symbol", _DRAWS)
    return spark.createDataFrame([f]).select(*sorted(f))


@query()
def bootstrap_bands(spark, d):
    o = V.metaorders(spark, d).groupBy(*KEYS).agg(F.avg("realised").alias("m")).orderBy(*KEYS).collect()
    low, high = resample.band([r["m"] for r in o], 500)
    a, b = resample.cluster([r["m"] for r in o], [r["symbol"] for r in o], np.median, 500)
    return spark.createDataFrame([("mean", low, high), ("median", a, b)], "statistic string, low double, high double")


# Joins ----------------------------------------------------------------------------


@query(_with(V.PRINTS) + "SELECT DISTINCT p.symbol, p.dt FROM prints p WHERE EXISTS (SELECT 1 FROM prints q WHERE q.symbol = p.symbol AND q.dt < p.dt)")
def sessions_with_prior(spark, d):
    return joins.first_sessions_out(V.prints(spark, d).select(*KEYS).distinct())


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_coverage(spark, d):
    good = V.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return contracts.uncovered(V.table(spark, d, "orders"), good, ["o_custkey"])


@query("""WITH a AS (SELECT s_nationkey AS k, COUNT(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), b AS (SELECT c_nationkey AS k, COUNT(*) AS customers FROM customer WHERE c_acctbal > 9500 GROUP BY 1)
  SELECT CAST(COALESCE(a.k, b.k) AS BIGINT) AS k, suppliers, customers, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS match FROM a FULL JOIN b ON a.k = b.k""")
def outer_indicator(spark, d):
    a = V.table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = V.table(spark, d, "customer").filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return contracts.matched(a, b, ["k"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def many_to_one(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return contracts.many_to_one(c, n, ["k"]).select("c_custkey", "n_name")


_NAMES = """nm AS (SELECT o_custkey AS permno, o_orderkey, CAST(o_orderdate AS DATE) AS a, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS z, CAST(o_orderkey % 3 + 10 AS INTEGER) AS shrcd FROM orders)"""


def _names(spark, d):
    o = V.table(spark, d, "orders").withColumn("a", F.to_date("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("permno"), "o_orderkey", "a", F.date_sub(F.lead("a").over(w), 1).alias("z"), (F.col("o_orderkey") % 3 + 10).cast("int").alias("shrcd"))


@query(f"WITH {_NAMES}, f AS (SELECT o_custkey AS permno, CAST(o_orderdate AS DATE) AS \"at\" FROM orders) SELECT f.permno, f.\"at\", nm.o_orderkey FROM f JOIN nm ON nm.permno = f.permno AND f.\"at\" BETWEEN nm.a AND COALESCE(nm.z, DATE '2100-12-31')")
def interval_join(spark, d):
    f = V.table(spark, d, "orders").select(F.col("o_custkey").alias("permno"), F.to_date("o_orderdate").alias("at"))
    return joins.valid_at(f, _names(spark, d), "permno", "at", "a", "z").select("permno", "at", "o_orderkey")


@query(f"WITH {_NAMES} SELECT permno, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY CASE shrcd WHEN 11 THEN 1 WHEN 10 THEN 2 ELSE 3 END, a DESC, o_orderkey DESC) AS r FROM nm) WHERE r = 1")
def top_share_class(spark, d):
    rank = F.when(F.col("shrcd") == 11, 1).when(F.col("shrcd") == 10, 2).otherwise(3)
    return joins.best(_names(spark, d), ["permno"], [rank, F.col("a").desc(), F.col("o_orderkey").desc()]).select("permno", "o_orderkey")


_CENTERS = np.geomspace(1, 500, 12).tolist()


@query(_with(V.ORDERS) + f""", c AS (SELECT unnest(range({len(_CENTERS)})) AS i, unnest([{', '.join(repr(float(np.log(x))) for x in _CENTERS)}]) AS lc),
  b AS (SELECT order_id, arg_min(i, (abs(ln(shares) - lc), i)) AS bin FROM mo, c GROUP BY 1) SELECT bin, COUNT(*) AS n FROM b GROUP BY 1""")
def nearest_center(spark, d):
    return joins.nearest_center(V.metaorders(spark, d), "shares", np.log(_CENTERS).tolist()).groupBy("bin").agg(F.count("*").alias("n"))


@query(_with(V.PRINTS, V.BARS) + "SELECT b.symbol, b.dt, b.sec, round(b.mid, 6) AS mid, round(o.s, 6) AS ofi FROM bars b JOIN (SELECT symbol, dt, sec // 60 * 60 AS sec, SUM(size * k) AS s FROM prints WHERE k > 20 GROUP BY 1, 2, 3) o USING (symbol, dt, sec)")
def bars_with_flow(spark, d):
    o = V.prints(spark, d).filter("k > 20").groupBy(*KEYS, (F.floor(F.col("sec") / 60) * 60).alias("sec")).agg(F.sum(F.col("size") * F.col("k")).alias("ofi"))
    return minute_bars(spark, d).join(o, [*KEYS, "sec"]).select(*KEYS, "sec", "mid", "ofi")


# Book -----------------------------------------------------------------------------

_SIZES = (10.0, 200.0, 600.0)
_WALK = f""", x AS (SELECT unnest([{', '.join(map(str, _SIZES))}]) AS x),
  cu AS (SELECT vec_id, level, ask_px, ask_sz, bid_px, bid_sz, SUM(ask_sz) OVER w - ask_sz AS ab, SUM(bid_sz) OVER w - bid_sz AS bb FROM levels WINDOW w AS (PARTITION BY vec_id ORDER BY level)),
  wk AS (SELECT vec_id, x, SUM(least(greatest(x - ab, 0), ask_sz) * ask_px) / x AS av, SUM(ask_sz) AS ad, SUM(least(greatest(x - bb, 0), bid_sz) * bid_px) / x AS bv, SUM(bid_sz) AS bd FROM cu, x GROUP BY 1, 2)"""


@query(_with(V.LADDER) + _WALK + " SELECT vec_id, x, round(CASE WHEN ad >= x THEN av - 99.99 END, 6) AS buy_cost, round(CASE WHEN bd >= x THEN 99.99 - bv END, 6) AS sell_cost, ad AS depth_ask FROM wk")
def ladder_walk(spark, d):
    return book.costs(joins.with_sizes(V.ladder(spark, d), _SIZES)).select("vec_id", "x", "buy_cost", "sell_cost", "depth_ask")


@query(_with(V.LADDER) + _WALK + " SELECT x, round(avg(CASE WHEN ad >= x THEN 1.0 ELSE 0 END), 6) AS buy, round(avg(CASE WHEN bd >= x THEN 1.0 ELSE 0 END), 6) AS sell FROM wk GROUP BY 1")
def walk_participation(spark, d):
    return book.participation(V.ladder(spark, d), _SIZES, [])


_PREM = """, bo AS (SELECT vec_id, label, level, 100.0 AS best, SUM(ask_sz) OVER w AS size, SUM(ask_sz * ask_px) OVER w AS cost FROM levels WINDOW w AS (PARTITION BY vec_id ORDER BY level)),
  pr AS (SELECT vec_id, label, level, size, cost / size - best AS premium, best FROM bo WHERE level > 0)"""


@query(_with(V.LADDER) + _PREM + """, ty AS (SELECT label, median(ask_sz) AS t FROM levels WHERE level = 0 GROUP BY 1)
  SELECT CAST(label AS BIGINT) AS label, CAST(level AS BIGINT) AS level, COUNT(*) AS n, round(avg(size / t), 6) AS size_rel, round(avg(premium / best * 10000), 6) AS premium_bps FROM pr JOIN ty USING (label) WHERE premium > 0 GROUP BY 1, 2""")
def book_premiums(spark, d):
    p = book.premiums(V.ladder(spark, d), "label")
    return p.groupBy("label", "level").agg(F.count("*").alias("n"), F.avg("size_rel").alias("size_rel"), F.avg("premium_bps").alias("premium_bps"))


_BUCK = _PREM + ", bk AS (SELECT CAST(floor(size) AS BIGINT) AS x_int, avg(premium) AS premium, COUNT(*) AS n FROM pr WHERE premium > 0 GROUP BY 1)"


@query(_with(V.LADDER) + _BUCK + " SELECT x_int, round(premium, 6) AS premium, n FROM bk")
def whole_share_buckets(spark, d):
    return book.whole_share_buckets(V.ladder(spark, d))


@query(_with(V.LADDER) + _BUCK + """ SELECT round(regr_slope(ln(premium), ln(x_int)) FILTER (WHERE x_int <= 1000), 6) AS p_filtered, round(regr_slope(ln(premium), ln(x_int)), 6) AS p_all,
  round((SUM(n) * SUM(n * ln(x_int) * ln(premium)) - SUM(n * ln(x_int)) * SUM(n * ln(premium))) / (SUM(n) * SUM(n * ln(x_int) * ln(x_int)) - SUM(n * ln(x_int)) * SUM(n * ln(x_int))), 6) AS p_weighted,
  COUNT(*) AS n_buckets, COUNT(*) FILTER (WHERE x_int <= 1000) AS n_kept, round(1 - SUM(n) FILTER (WHERE x_int <= 1000) / SUM(n), 6) AS dropped FROM bk""")
def bucket_slopes(spark, d):
    return book.bucket_slopes(book.whole_share_buckets(V.ladder(spark, d)))


_OFI = """, lv AS (SELECT vec_id, label, level, bid_px + 0.01 * (vec_id % 3) AS bp, bid_sz, ask_px + 0.01 * (vec_id % 2) AS ap, ask_sz FROM levels),
  of AS (SELECT vec_id, label, level, bid_sz + ask_sz AS q, CASE WHEN lag(bp) OVER w IS NULL THEN 0 ELSE (CASE WHEN bp >= lag(bp) OVER w THEN bid_sz ELSE 0 END) - (CASE WHEN bp <= lag(bp) OVER w THEN lag(bid_sz) OVER w ELSE 0 END)
  - (CASE WHEN ap <= lag(ap) OVER w THEN ask_sz ELSE 0 END) + (CASE WHEN ap >= lag(ap) OVER w THEN lag(ask_sz) OVER w ELSE 0 END) END AS e FROM lv WINDOW w AS (PARTITION BY label, level ORDER BY vec_id))"""


def _flows(spark, d):
    moved = V.ladder(spark, d).withColumn("bid_px", F.transform("bid_px", lambda x: x + 0.01 * (F.col("vec_id") % 3))).withColumn("ask_px", F.transform("ask_px", lambda x: x + 0.01 * (F.col("vec_id") % 2)))
    return book.level_imbalances(moved.withColumn("sec", F.floor(F.col("vec_id") / 20)), ("label",), 10, "vec_id")


@query(_with(V.LADDER) + _OFI + " SELECT vec_id, round(SUM(CASE WHEN level = 0 THEN e END), 6) AS ofi_0, round(SUM(CASE WHEN level = 9 THEN e END), 6) AS ofi_9 FROM of GROUP BY 1")
def level_ofi(spark, d):
    return _flows(spark, d).select("vec_id", "ofi_0", "ofi_9")


@query(_with(V.LADDER) + _OFI + """, qq AS (SELECT label, avg(t) / 20 AS qbar FROM (SELECT label, vec_id, SUM(q) AS t FROM of GROUP BY 1, 2) GROUP BY 1),
  sm AS (SELECT label, vec_id // 20 AS sec, SUM(CASE WHEN level = 0 THEN e ELSE 0 END) AS b, SUM(e) AS s FROM of GROUP BY 1, 2)
  SELECT CAST(label AS BIGINT) AS label, sec, round(b / qbar, 6) AS ofi_best, round(s / qbar, 6) AS ofi_sum FROM sm JOIN qq USING (label)""")
def ofi_bars(spark, d):
    return book.imbalance_bars(_flows(spark, d), ("label",)).select("label", "sec", "ofi_best", "ofi_sum")


@query()
def pca_weights(spark, d):
    return book.integrated(book.imbalance_bars(_flows(spark, d), ("label",)), 10, F.col("sec") < 10).select("label", "sec", "ofi_integrated")


_GRID = np.geomspace(1, 8000, 30).tolist()
_BINS = f""", g AS (SELECT unnest([{', '.join(map(repr, _GRID))}]) AS x), l2 AS (SELECT vec_id, label, level, 'buy' AS side, ask_px AS px, ask_sz AS sz FROM levels UNION ALL SELECT vec_id, label, level, 'sell', bid_px, bid_sz FROM levels),
  cu AS (SELECT *, SUM(sz) OVER (PARTITION BY vec_id, side ORDER BY level) - sz AS before FROM l2),
  wk AS (SELECT vec_id, label, side, x, SUM(least(greatest(x - before, 0), sz) * px) / x AS av, SUM(sz) AS depth, MAX(CASE WHEN level = 0 THEN sz END) AS touch FROM cu, g GROUP BY vec_id, label, side, x),
  co AS (SELECT *, CASE WHEN depth >= x THEN CASE side WHEN 'buy' THEN av - 99.99 ELSE 99.99 - av END END AS cost FROM wk),
  r AS (SELECT vec_id, label, side, x, cost, unnest(['shares', 'depth', 'volume']) AS size_normalisation, unnest([x, x / touch, x / 1e6]) AS size FROM co),
  lo AS (SELECT *, round(ln(size), 12) AS ls FROM r WHERE cost IS NOT NULL),
  e AS (SELECT label, side, size_normalisation, list_sort(list_distinct(list_transform({_EDGES.format(v='ls', p=_points(20))}, lambda x: round(x, 12)))) AS e FROM lo GROUP BY 1, 2, 3),
  b AS (SELECT lo.*, least(greatest(len(list_filter(e, lambda y: y <= ls)) - 1, 0), len(e) - 2) AS bin FROM lo JOIN e USING (label, side, size_normalisation)),
  t AS (SELECT label, side, size_normalisation, bin, avg(size) AS size, COUNT(*) AS n, avg(cost / 99.99 * 1e4) AS cost_bp, avg(cost / 99.99 / 0.02) AS cost_sigma, avg(cost / 0.01) AS cost_half_spreads, stddev_samp(cost / 99.99 * 1e4) AS cost_sd FROM b GROUP BY 1, 2, 3, 4),
  d AS (SELECT r.label, r.side, r.size_normalisation, r.vec_id, r.x, MAX(CASE WHEN cost IS NULL THEN 0.0 ELSE 1.0 END) AS deep, arg_min(bin, (abs(ln(r.size) - ln(t.size)), bin)) AS bin FROM r JOIN t USING (label, side, size_normalisation) GROUP BY r.label, r.side, r.size_normalisation, r.vec_id, r.x),
  p AS (SELECT label, side, size_normalisation, bin, avg(deep) AS participating FROM d GROUP BY 1, 2, 3, 4)"""


#: The same bins as one table of SQL.
_TABLED = ", tb AS (WITH " + _BINS[2:] + " SELECT * FROM t)"


def _walk_bins(spark, d):
    ladder = V.ladder(spark, d)
    scales = ladder.select("label").distinct().withColumn("sigma", F.lit(0.02)).withColumn("volume", F.lit(1e6))
    return book.session_bins(ladder, _GRID, scales, "sigma", "volume", ["label"], 20)


@query(_with(V.LADDER) + _BINS + """ SELECT CAST(label AS BIGINT) AS label, side, size_normalisation, CAST(bin AS BIGINT) AS bin, round(size, 6) AS size, n, round(cost_bp, 6) AS cost_bp, round(cost_sigma, 6) AS cost_sigma,
  round(cost_half_spreads, 6) AS cost_half_spreads, round(cost_sd, 6) AS cost_sd, round(participating, 6) AS participating FROM t LEFT JOIN p USING (label, side, size_normalisation, bin)""")
def book_walk_bins(spark, d):
    """Binned walking costs of both sides in three units of size, some sizes beyond most books."""
    return _walk_bins(spark, d).select("label", "side", "size_normalisation", "bin", "size", "n", "cost_bp", "cost_sigma", "cost_half_spreads", "cost_sd", "participating")


@query(_with(V.LADDER) + _BINS + " SELECT CAST(label AS BIGINT) AS label, side, size_normalisation, CAST(bin AS BIGINT) AS bin, round(participating, 6) AS participating FROM p WHERE participating >= 0.5")
def participating_bins(spark, d):
    """Book-walk bins that half of all snapshots can fill at the bin's mean size."""
    return book.deep_enough(_walk_bins(spark, d), 0.5).select("label", "side", "size_normalisation", "bin", "participating")


def _panel(spark, d):
    return _walk_bins(spark, d).filter("size_normalisation = 'depth'")


@query()
def form_contest(spark, d):
    """All six forms on the book-walk bins of both sides, with 400 draws of sessions."""
    c = forms.contested(_panel(spark, d), "label", "size", "cost_half_spreads", "n")
    return c.select("form", "exponent", "exponent_low", "exponent_high", "aic", "delta_aic", "left_out", "place")


def _contest_sql(groups: int, draws: int) -> str:
    """The linear form, the power and the power of 0.6, fitted from sums of each session: whole, without each session, and by draws."""
    jobs = [("all", [1] * groups)] + [(f"f{k}", [int(j != k) for j in range(groups)]) for k in range(groups)] + [(f"d{t}", row) for t, row in enumerate(resample.multiplicities(range(groups), draws).tolist())]
    values = ", ".join(f"('{t}', {k}, {m})" for t, row in jobs for k, m in enumerate(row) if m)
    return f""", pn AS (SELECT dense_rank() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS k, ln(size) AS l, cost_half_spreads AS y, n AS w FROM tb WHERE size_normalisation = 'depth'),
  gr AS (SELECT unnest(range(0, 601)) AS j), xx AS (SELECT k, j, w, y, l, exp(l * j * 0.005) AS x FROM pn, gr), own AS (SELECT k, j, SUM(w * x * y) AS a, SUM(w * x * x) AS b, SUM(w * x * y * l) AS da, 2 * SUM(w * x * x * l) AS db, SUM(w * y * y) AS yy, COUNT(*) AS n, SUM(w) AS w FROM xx GROUP BY 1, 2),
  m(job, k, m) AS (VALUES {values}), s AS (SELECT job, j, SUM(m * a) AS a, SUM(m * b) AS b, SUM(m * da) AS da, SUM(m * db) AS db, CAST(SUM(m * n) AS BIGINT) AS n FROM own JOIN m USING (k) GROUP BY 1, 2)
  {_root_sql("job", 0.005)}, fx AS (SELECT job, CASE j WHEN 200 THEN 'linear' ELSE 'athl_beta_0.6' END AS form, j * 0.005 AS d, a / b AS c FROM s WHERE j IN (120, 200)),
  fo AS (SELECT job, form, d, c FROM fx WHERE job NOT LIKE 'd%' UNION ALL SELECT job, 'power', d, c FROM z),
  er AS (SELECT fo.job, form, d, SUM(w * (y - c * exp(l * d)) * (y - c * exp(l * d))) AS wsse FROM fo JOIN pn ON fo.job = 'all' OR fo.job = 'f' || pn.k GROUP BY 1, 2, 3), sz AS (SELECT COUNT(*) AS n, SUM(w) AS w FROM pn),
  al AS (SELECT form, d, wsse, sz.n * ln(wsse / sz.n) + 2 * CASE form WHEN 'power' THEN 2 ELSE 1 END AS aic FROM er, sz WHERE job = 'all'), cv AS (SELECT form, sqrt(SUM(wsse) / MAX(sz.w)) AS left_out FROM er, sz WHERE job LIKE 'f%' GROUP BY 1),
  bd AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM z WHERE job LIKE 'd%')
  SELECT form, CASE WHEN form = 'power' THEN round(d, 6) END AS exponent, CASE WHEN form = 'power' THEN round(lo, 6) END AS exponent_low, CASE WHEN form = 'power' THEN round(hi, 6) END AS exponent_high, round(wsse, 4) AS wsse, round(aic, 4) AS aic,
  round(left_out, 6) AS left_out, row_number() OVER (ORDER BY left_out, form) AS place FROM al JOIN cv USING (form), bd"""


@query(_with(V.LADDER) + _TABLED + """, pn AS (SELECT label || side AS k, ln(size) AS l, cost_half_spreads AS y, n AS w FROM tb WHERE size_normalisation = 'depth'), gr AS (SELECT unnest(range(0, 601)) AS j), xx AS (SELECT k, j, w, y, l, exp(l * j * 0.0025) AS x FROM pn, gr),
  s AS (SELECT k, j, SUM(w * x * y) AS a, SUM(w * x * x) AS b, SUM(w * x * y * l) AS da, 2 * SUM(w * x * x * l) AS db, COUNT(*) AS n FROM xx GROUP BY 1, 2)""" + _root_sql("k") + " SELECT k AS panel, round(c, 6) AS level, round(d, 6) AS exponent FROM z")
def sql_form_fits(spark, d):
    """The power form by book side, fitted by a table function."""
    tables.register(spark)
    _panel(spark, d).select(F.concat("label", "side").alias("panel"), F.col("size").alias("u"), F.col("cost_half_spreads").alias("y"), F.col("n").cast("double").alias("w")).createOrReplaceTempView("tw_panel")
    return spark.sql("SELECT panel, level, exponent FROM form_fit(TABLE(tw_panel) PARTITION BY panel ORDER BY u, form => 'power')")


@query(_with(V.LADDER) + _TABLED + _contest_sql(10, 100))
def form_fits(spark, d):
    """Three of the forms with folds, draws and ranks."""
    c = forms.contested(_panel(spark, d), "label", "size", "cost_half_spreads", "n", (forms.LINEAR, forms.POWER, forms.ATHL_06), 100)
    return c.select("form", "exponent", "exponent_low", "exponent_high", F.round("wsse", 4).alias("wsse"), F.round("aic", 4).alias("aic"), "left_out", "place")


@query(_with(V.LADDER) + "SELECT CAST(label AS BIGINT) AS label, round(median(ask_sz), 6) AS depth FROM levels WHERE level = 0 GROUP BY 1")
def first_depth(spark, d):
    return V.ladder(spark, d).groupBy("label").agg(F.median(X.first_depth(F.col("ask_sz"))).alias("depth"))


# Kernels, models, schedules ---------------------------------------------------------


def _long_bars(spark, d):
    """All sessions of a symbol end to end as one, so that lag fits have enough rows."""
    b = minute_bars(spark, d).withColumn("day", F.datediff("dt", F.lit("2024-01-01")))
    return b.select("symbol", (F.col("day") * 86_400 + F.col("sec")).alias("sec"), "signed_vol", "volume", "mid")


def _lag_sql(deltas, lags, by: str = "symbol", rows: str = "bars", least: int = 50) -> str:
    """Kernels ``ke`` and scores ``fi`` of every shape: sums of lag products, solved by elimination on lists."""
    return f""", f AS (SELECT {by} AS grp, dt, sec, d, ln(mid / lag(mid) OVER w) AS y, sign(signed_vol) * pow(abs(signed_vol), d) AS f FROM {rows}, (SELECT unnest([{', '.join(map(str, deltas))}]) AS d) WINDOW w AS (PARTITION BY symbol, dt, d ORDER BY sec)),
  l AS (SELECT grp, dt, sec, d, y, list_reverse(list(f) OVER (PARTITION BY grp, dt, d ORDER BY sec ROWS BETWEEN {max(lags)} PRECEDING AND CURRENT ROW)) AS x FROM f),
  c AS (SELECT grp, d, k, y, x, row_number() OVER w <= floor(COUNT(*) OVER (PARTITION BY grp, dt, d, k) * 0.7) AS train FROM l, (SELECT unnest([{', '.join(map(str, lags))}]) AS k) WHERE y IS NOT NULL AND len(x) > k WINDOW w AS (PARTITION BY grp, dt, d, k ORDER BY sec)),
  n AS (SELECT grp, d, k, train, COUNT(*) AS n, SUM(y) AS sy, SUM(y * y) AS syy FROM c GROUP BY 1, 2, 3, 4),
  ok AS (SELECT grp, d, k FROM n GROUP BY 1, 2, 3 HAVING COUNT(*) = 2 AND MIN(n) >= {least}), i AS (SELECT c.*, unnest(range(0, k + 1)) AS i FROM c SEMI JOIN ok USING (grp, d, k)),
  b AS (SELECT grp, d, k, train, i, SUM(x[i + 1] * y) AS b FROM i GROUP BY ALL), ij AS (SELECT *, unnest(range(0, k + 1)) AS j FROM i), g AS (SELECT grp, d, k, train, i, j, SUM(x[i + 1] * x[j + 1]) AS g FROM ij GROUP BY ALL),
  r AS (SELECT g.grp, g.d, g.k, g.i, list_append(list(g ORDER BY j), MAX(b)) AS r FROM g JOIN b ON (g.grp, g.d, g.k, g.i) = (b.grp, b.d, b.k, b.i) AND g.train AND b.train GROUP BY 1, 2, 3, 4), m AS (SELECT grp, d, k, list(r ORDER BY i) AS m FROM r GROUP BY 1, 2, 3),
  e AS (SELECT grp, d, k, CAST(1 AS BIGINT) AS p, m FROM m UNION ALL SELECT grp, d, k, p + 1, list_transform(m, lambda row, pos: CASE WHEN pos = p THEN list_transform(row, lambda v: v / row[p]) ELSE list_transform(row, lambda v, j: v - row[p] * m[p][j] / m[p][p]) END) FROM e WHERE p <= k + 1),
  ke AS (SELECT grp, d, k, i, m[i + 1][k + 2] AS c FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM e WHERE p = k + 2)), le AS (SELECT *, SUM(c) OVER (PARTITION BY grp, d, k ORDER BY i) AS level, MAX(CASE WHEN i = 0 THEN c END) OVER (PARTITION BY grp, d, k) AS g0 FROM ke),
  h AS (SELECT grp, d, k, MAX(g0) AS g0, MIN(CASE WHEN i > 0 AND abs(level) <= abs(g0) / 2 THEN i END) AS half_life FROM le GROUP BY 1, 2, 3),
  u AS (SELECT g.grp, g.d, g.k, g.train, SUM(a.c * z.c * g.g) AS q FROM g JOIN ke a ON (a.grp, a.d, a.k, a.i) = (g.grp, g.d, g.k, g.i) JOIN ke z ON (z.grp, z.d, z.k, z.i) = (g.grp, g.d, g.k, g.j) GROUP BY ALL),
  v AS (SELECT b.grp, b.d, b.k, b.train, SUM(b * c) AS s FROM b JOIN ke USING (grp, d, k, i) GROUP BY ALL),
  w AS (SELECT *, 1 - (syy - 2 * s + q) / (syy - sy * sy / n) AS r2 FROM n JOIN u USING (grp, d, k, train) JOIN v USING (grp, d, k, train)),
  o AS (SELECT grp, d, k, MAX(CASE WHEN train THEN r2 END) AS r2_in, MAX(CASE WHEN NOT train THEN r2 END) AS r2_out, CAST(MAX(CASE WHEN train THEN n END) AS BIGINT) AS n_train, CAST(MAX(CASE WHEN NOT train THEN n END) AS BIGINT) AS n_test FROM w GROUP BY 1, 2, 3),
  fi AS (SELECT *, r2_out - MAX(CASE WHEN k = 0 THEN r2_out END) OVER (PARTITION BY grp, d) AS gain, row_number() OVER (PARTITION BY grp ORDER BY r2_out DESC, d, k) = 1 AS best FROM o JOIN h USING (grp, d, k))"""


def _lag_with(deltas=kernels.DELTAS, lags=kernels.LAGS) -> str:
    return _with(V.PRINTS, V.BARS).replace("WITH ", "WITH RECURSIVE ", 1) + _lag_sql(deltas, lags)


@query(_lag_with() + """ SELECT grp AS symbol, CAST(d AS DOUBLE) AS delta, CAST(k AS BIGINT) AS n_lags, round(1000 * g0, 6) AS g0, round(r2_in, 6) AS r2_in, round(r2_out, 6) AS r2_out, CAST(half_life AS DOUBLE) AS half_life, round(gain, 6) AS history_gain, n_train, n_test, best FROM fi""")
def propagator_fit(spark, d):
    """All 28 shapes of the lag fit by symbol, lags kept within sessions."""
    k = kernels.calibrate(minute_bars(spark, d), KEYS, ["symbol"])
    return k.select("symbol", "delta", "n_lags", (1000 * F.col("g0")).alias("g0"), "r2_in", "r2_out", "half_life", "history_gain", "n_train", "n_test", "best")


@query(_lag_with((0.5, 1.0), (0, 5)) + " SELECT grp AS symbol, CAST(d AS DOUBLE) AS delta, i AS lag, round(1000 * c, 6) AS coefficient, round(1000 * level, 6) AS level FROM le WHERE k = 5")
def level_response(spark, d):
    """Level responses of fitted kernels of five lags."""
    k = kernels.by_lag(kernels.calibrate(minute_bars(spark, d), KEYS, ["symbol"], (0, 5), (0.5, 1.0)).filter("n_lags = 5"), ["symbol", "delta"])
    return kernels.levels(k, ["symbol", "delta"]).select("symbol", "delta", "lag", (1000 * F.col("coefficient")).alias("coefficient"), (1000 * F.col("level")).alias("level"))


@query(_lag_with((0.5,), (0, 5)) + " SELECT grp AS symbol, i AS lag, round(c / g0, 4) AS shape FROM le WHERE k = 5")
def kernel_shape(spark, d):
    """Fitted kernels over their coefficient of lag 0."""
    k = kernels.by_lag(kernels.calibrate(minute_bars(spark, d), KEYS, ["symbol"], (0, 5), (0.5,)).filter("n_lags = 5"), ["symbol"])
    return kernels.shape(k, ["symbol"]).select("symbol", "lag", F.round("shape", 4).alias("shape"))


def _contest(spark, d, **options):
    """The contest on the sessions of the driver's tables, with time-of-day shapes of their other sessions."""
    b = minute_bars(spark, d)
    o = V.metaorders(spark, d).withColumn("bucket", X.grid(F.col("at"), 7200))
    shapes = bar.shape_from_mids(b, KEYS, 7200)
    for kind in ("loso", "prior"):
        o = o.join(volatility.donor_profile(shapes, kind).select(*KEYS, "bucket", F.col("multiplier").alias(kind)), [*KEYS, "bucket"], "left")
    start = F.col("at").cast("double")
    o = o.select(*KEYS, "order_id", start.alias("t_start"), (start + F.col("u")).alias("t_end"), "shares", F.lit(1.0).alias("sign"), F.lit(100.0).alias("mid_start"), (100.0 * F.exp("realised")).alias("mid_end"), F.lit(10_000.0).alias("session_volume"), F.lit(0.02).alias("sigma_d"), "loso", "prior")
    return models.contest(b, o, KEYS, least=12, window=7200, **options)


@query()
def ten_models(spark, d):
    """All ten models on every session that is long enough."""
    return _contest(spark, d, lags=(0, 1, 2), least_bars=5).select(*KEYS, "model", "n", "r2_no_refit", "r2_refit", "slope", "mean_realised", "mean_predicted")


_SEVEN = ("sqrt", "sqrt_trailing_sigma", "sqrt_blend", "sqrt_tod_loso", "sqrt_tod_prior", "power_tod_loso", "power_tod_prior")
_SHARED = _SPLIT + _MID + _donor("<>").replace("mine AS", "mine_l AS").replace("FROM mine m", "FROM mine_l m").replace("donor AS", "donor_l AS") + _donor("<") + """, hp AS (SELECT symbol, dt, COUNT(multiplier) AS has FROM donor GROUP BY 1, 2),
  o0 AS (SELECT mo.symbol, mo.dt, order_id, "at", u, q, realised AS y, CASE WHEN "at" >= split THEN 'test' WHEN "at" + u < split THEN 'train' END AS side, CAST(floor(("at" - 34200) / 7200) AS BIGINT) AS bucket FROM mo JOIN sp USING (symbol, dt) WHERE "at" >= sp."first" AND "at" + u <= sp."last"),
  sz AS (SELECT symbol, dt FROM o0 GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE side = 'train') >= 12 AND COUNT(*) FILTER (WHERE side = 'test') >= 12), any_l AS (SELECT mo.symbol, mo.dt, COUNT(a.multiplier) AS has_l, COUNT(b.multiplier) AS has_p FROM mo LEFT JOIN donor_l a ON a.symbol = mo.symbol AND a.dt = mo.dt AND a.bucket = CAST(floor((mo."at" - 34200) / 7200) AS BIGINT) LEFT JOIN donor b ON b.symbol = mo.symbol AND b.dt = mo.dt AND b.bucket = CAST(floor((mo."at" - 34200) / 7200) AS BIGINT) GROUP BY 1, 2),
  o1 AS (SELECT o0.*, CASE WHEN has_l > 0 THEN 0.02 * COALESCE(CASE WHEN l.multiplier > 0 THEN l.multiplier END, 1) END AS sl, CASE WHEN has_p > 0 THEN 0.02 * COALESCE(CASE WHEN p.multiplier > 0 THEN p.multiplier END, 1) END AS spr FROM o0 JOIN sz USING (symbol, dt) JOIN any_l USING (symbol, dt) LEFT JOIN donor_l l USING (symbol, dt, bucket) LEFT JOIN donor p USING (symbol, dt, bucket) WHERE side IS NOT NULL),
  sq AS (SELECT symbol, dt, sec, COALESCE(ret * ret, 0) AS sq FROM mr), tr AS (SELECT o1.symbol, o1.dt, order_id, side, sqrt(COALESCE(SUM(sq), 0) / greatest(COUNT(sq), 1) * 23400) AS raw FROM o1 LEFT JOIN sq ON sq.symbol = o1.symbol AND sq.dt = o1.dt AND sq.sec >= o1."at" - 7200 AND sq.sec < o1."at" GROUP BY 1, 2, 3, 4),
  tm AS (SELECT symbol, dt, side, median(raw) FILTER (WHERE raw > 0) AS mid FROM tr GROUP BY 1, 2, 3), o2 AS (SELECT o1.*, symbol || '|' || dt AS ses, COALESCE(CASE WHEN raw > 0 THEN raw END, mid) AS near FROM o1 JOIN tr USING (symbol, dt, order_id, side) JOIN tm USING (symbol, dt, side)),
  lv AS (SELECT ses, SUM(y * sqrt(q) * 0.02) / SUM(q * 0.0004) AS c1, SUM(y * sqrt(q) * near) / SUM(q * near * near) AS c2, SUM(y * sqrt(q) * sl) / SUM(q * sl * sl) AS c3, SUM(y * sqrt(q) * spr) / SUM(q * spr * spr) AS c4 FROM o2 WHERE side = 'train' GROUP BY 1),
  ag AS (SELECT unnest([""" + ", ".join(repr(float(v)) for v in np.linspace(0, 1, 101)) + """]) AS al), bs AS (SELECT ses, al, SUM(y * pow(0.02, al) * pow(near, 1 - al) * sqrt(q)) AS a, SUM(pow(pow(0.02, al) * pow(near, 1 - al), 2) * q) AS b, SUM(y * y) AS yy FROM o2, ag WHERE side = 'train' AND near > 0 GROUP BY 1, 2),
  bb AS (SELECT ses, arg_min(al, (yy - a * a / b, al)) AS al, arg_min(a / b, (yy - a * a / b, al)) AS c FROM bs GROUP BY 1), jj AS (SELECT unnest(range(0, 301)) AS j), """


def _seven_sql() -> str:
    """Scores of the seven models that sums give in closed form, or by the root of a slope."""
    power = []
    for kind, scale in (("loso", "sl"), ("prior", "spr")):
        own = f"""fk AS (SELECT ses, ln(q) AS l, y, {scale} AS s FROM o2 WHERE side = 'train' AND {scale} > 0), xk AS (SELECT ses, j, y, l, s * exp(l * j * 0.005) AS x FROM fk, jj),
  s AS (SELECT ses, j, SUM(x * y) AS a, SUM(x * x) AS b, SUM(x * y * l) AS da, 2 * SUM(x * x * l) AS db, COUNT(*) AS n FROM xk GROUP BY 1, 2){_root_sql("ses", 0.005)}"""
        power.append(f"pw_{kind} AS (WITH {own} SELECT ses, c, d FROM z)")
    pairs = {"sqrt": "c1 * 0.02 * sqrt(q)", "sqrt_trailing_sigma": "c2 * near * sqrt(q)", "sqrt_blend": "bb.c * pow(0.02, bb.al) * pow(near, 1 - bb.al) * sqrt(q)", "sqrt_tod_loso": "c3 * sl * sqrt(q)", "sqrt_tod_prior": "c4 * spr * sqrt(q)", "power_tod_loso": "pl.c * sl * pow(q, pl.d)", "power_tod_prior": "pp.c * spr * pow(q, pp.d)"}
    names, values = ", ".join(f"'{n}'" for n in pairs), ", ".join(pairs.values())
    return f"""{_SHARED}{', '.join(power)}, pr AS (SELECT symbol, dt, y, unnest([{names}]) AS model, unnest([{values}]) AS p FROM o2 JOIN lv ON lv.ses = o2.ses LEFT JOIN bb ON bb.ses = o2.ses LEFT JOIN pw_loso pl ON pl.ses = o2.ses LEFT JOIN pw_prior pp ON pp.ses = o2.ses WHERE side = 'test')
  SELECT symbol, dt, model, COUNT(*) AS n, round(1 - SUM((y - p) * (y - p)) / regr_syy(y, p), 6) AS r2_no_refit, round(regr_r2(y, p), 6) AS r2_refit, round(regr_slope(y, p), 6) AS slope, round(avg(y), 6) AS mean_realised, round(avg(p), 6) AS mean_predicted FROM pr WHERE p IS NOT NULL GROUP BY 1, 2, 3"""


@query(_with(V.PRINTS, V.BARS, V.ORDERS) + _seven_sql())
def seven_models(spark, d):
    """The models without a kernel or an execution rate, on every session that is long enough."""
    return _contest(spark, d, only=_SEVEN).select(*KEYS, "model", "n", "r2_no_refit", "r2_refit", "slope", "mean_realised", "mean_predicted")


_COST = ", s AS (SELECT order_id, symbol, unnest(range(1, 6)) AS t, shares FROM mo), w AS (SELECT *, 1.0 / (t * t) AS wt, 1.0 AS one FROM s)"


@query(_with(V.ORDERS) + _COST + """, x AS (SELECT *, shares * one / SUM(one) OVER (PARTITION BY order_id) AS a, shares * wt / SUM(wt) OVER (PARTITION BY order_id) AS b FROM w)
  SELECT order_id, round(SUM(t * pow(a, 1.5)) / SUM(a), 6) AS twap, round(SUM(t * pow(b, 1.5)) / SUM(b), 6) AS optimal, round(100 * (1 - (SUM(t * pow(b, 1.5)) / SUM(b)) / (SUM(t * pow(a, 1.5)) / SUM(a))), 4) AS saving FROM x GROUP BY 1""")
def schedule_costs(spark, d):
    s = V.metaorders(spark, d).select("order_id", "shares", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("t")).withColumn("one", F.lit(1.0)).withColumn("best", 1.0 / (F.col("t") * F.col("t")))
    long = None
    for name, weight in (("TWAP", "one"), ("optimal", "best")):
        one = schedule.price(schedule.proportional(s, weight, "shares", ["order_id"], "x"), "t", ["order_id"], "x").withColumn("schedule", F.lit(name))
        long = one if long is None else long.unionByName(one)
    saved = schedule.savings(long, ["order_id"])
    pick = lambda n, c: F.max(F.when(F.col("schedule") == n, F.col(c)))
    return saved.groupBy("order_id").agg(pick("TWAP", "cost").alias("twap"), pick("optimal", "cost").alias("optimal"), F.round(pick("optimal", "saving"), 4).alias("saving"))


@query(_with(V.PRINTS, V.BARS) + """, c AS (SELECT symbol, dt, sec, SUM(volume) OVER (PARTITION BY symbol, dt ORDER BY sec) AS cum, SUM(volume) OVER (PARTITION BY symbol, dt) AS tot FROM bars)
  SELECT symbol, dt, MIN(sec) FILTER (WHERE cum >= 0.5 * tot) AS half_life, round(SUM(tot - cum), 6) AS inventory FROM c GROUP BY 1, 2""")
def inventory_half_life(spark, d):
    w = Window.partitionBy(*KEYS)
    c = minute_bars(spark, d).withColumn("cum", F.sum("volume").over(w.orderBy("sec").rowsBetween(Window.unboundedPreceding, 0))).withColumn("tot", F.sum("volume").over(w))
    return c.groupBy(*KEYS).agg(F.min(F.when(F.col("cum") >= 0.5 * F.col("tot"), F.col("sec"))).alias("half_life"), F.sum(F.col("tot") - F.col("cum")).alias("inventory"))


@query(_with(V.ORDERS) + """, w AS (SELECT unnest([7200, 21600, 43200]) AS width), b AS (SELECT symbol, width, "at" // width AS bucket, COUNT(*) AS n FROM mo, w GROUP BY 1, 2, 3), l AS (SELECT symbol, width, MIN(n) AS least FROM b GROUP BY 1, 2)
  SELECT symbol, MIN(CASE WHEN least >= 30 THEN width END) AS width FROM l GROUP BY 1""")
def bucket_width(spark, d):
    return schedule.bucket_width(V.metaorders(spark, d).withColumn("zero", F.lit(0)), ["symbol"], "at", "zero", (7200, 21600, 43200))


@query()
def averse_schedules(spark, d):
    depth = [r["depth"] for r in V.ladder(spark, d).groupBy("label").agg(F.median(X.first_depth(F.col("ask_sz"))).alias("depth")).orderBy("label").collect()]
    rows = schedule.compare(np.array(depth), 0.01, 0.5, 5000.0, 0.001, (0.0, 1e-5))
    return spark.createDataFrame([(r["schedule"], r["impact_cost"], r["inventory_variance"], r["peak_minute_share"], r["half_life_minutes"]) for r in rows], "schedule string, impact_cost double, inventory_variance double, peak double, half_life long")


@query()
def depth_spline(spark, d):
    m = V.prints(spark, d).withColumn("minute", F.floor(F.col("sec") / 180)).groupBy("minute").agg(F.avg("size").alias("depth")).toPandas()
    f = schedule.smooth_depth(m["minute"].to_numpy(), m["depth"].to_numpy())
    return spark.createDataFrame(list(zip(f["minutes"].tolist(), f["profile"].tolist())), "minute double, depth double")


# Sets, panels, reports ----------------------------------------------------------------


@query(_with(V.ORDERS) + "SELECT CASE WHEN GROUPING(symbol) = 1 THEN 'pooled' ELSE symbol END AS panel, COUNT(*) AS n, round(avg(realised), 6) AS mean, round(median(q), 6) AS middle FROM mo GROUP BY GROUPING SETS ((symbol), ())")
def pooled_and_by_symbol(spark, d):
    return universe.panels(V.metaorders(spark, d), "symbol", [F.count("*").alias("n"), F.avg("realised").alias("mean"), F.median("q").alias("middle")])


@query(_with(V.ORDERS) + """, v AS (SELECT order_id, 'venue' AS variant, q, realised / sigma AS y FROM mo UNION ALL SELECT order_id, 'consolidated_volume', shares / 20000, realised / sigma FROM mo
  UNION ALL SELECT order_id, 'consolidated_sigma', q, realised / 0.03 FROM mo UNION ALL SELECT order_id, 'consolidated_both', shares / 20000, realised / 0.03 FROM mo)
  SELECT variant, COUNT(*) AS n, round(SUM(sqrt(q) * y) / SUM(q), 6) AS c_half FROM v GROUP BY 1""")
def normaliser_variants(spark, d):
    o = V.metaorders(spark, d).select("symbol", F.col("dt").alias("date"), F.col("shares").alias("Q"), F.col("q").alias("participation"), F.col("realised").alias("impact"), F.col("sigma").alias("sigma_d"))
    v = o.select("symbol", "date").distinct().withColumn("volume_crsp", F.lit(20_000.0)).withColumn("sigma_crsp", F.lit(0.03))
    return universe.variants(o, v).groupBy("variant").agg(F.count("*").alias("n"), fits.level(F.col("y"), F.sqrt("size")).alias("c_half"))


@query("SELECT p_partkey::BIGINT AS k FROM part WHERE p_size % 2 = 0 EXCEPT SELECT l_partkey::BIGINT FROM lineitem WHERE l_quantity > 47")
def set_difference(spark, d):
    """Requested symbols that no trade resolves."""
    a = V.table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").cast("long").alias("k")).distinct()
    b = V.table(spark, d, "lineitem").filter("l_quantity > 47").select(F.col("l_partkey").cast("long").alias("k"))
    return a.join(b, "k", "left_anti")


@query("SELECT DISTINCT event_type AS symbol, user_id % 10 AS u FROM events")
def distinct_pairs(spark, d):
    return V.table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 10).alias("u")).distinct()


@query(_with(V.TAPE) + """SELECT CAST(permno AS VARCHAR) AS symbol, COUNT(*) AS days, round(avg(close), 6) AS close, round(avg(volume), 6) AS volume, round(avg(close * volume), 4) AS dollar_volume, round(avg((high - low) / close * 10000), 4) AS range_bp FROM daily GROUP BY 1 HAVING COUNT(*) >= 15""")
def daily_stats(spark, d):
    s = universe.daily_stats(V.daily(spark, d).withColumn("symbol", F.col("permno").cast("string")))
    return s.select("symbol", "days", "close", "volume", F.round("dollar_volume", 4).alias("dollar_volume"), F.round("range_bp", 4).alias("range_bp"))


@query(_with(V.TAPE) + """, r AS (SELECT permno, volume / (volume + date_part('day', date) - 15) AS ratio FROM daily WHERE volume + date_part('day', date) - 15 > 0)
  SELECT CAST(permno AS VARCHAR) AS symbol, COUNT(*) AS n_days, round(quantile_cont(ratio, 0.5), 6) AS median, round(quantile_cont(ratio, 0.05), 6) AS p05, round(quantile_cont(ratio, 0.95), 6) AS p95 FROM r GROUP BY 1""")
def venue_comparison(spark, d):
    a = V.daily(spark, d).select(F.col("permno").cast("string").alias("symbol"), "date", "volume")
    b = a.select("symbol", "date", (F.col("volume") + F.dayofmonth("date") - 15).alias("other"))
    return universe.compare_volumes(a, b, "volume", "other")[0]


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer), b AS (SELECT c_custkey, c_nationkey, c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer)
  SELECT c_custkey, 'c_acctbal' AS "column" FROM a JOIN b USING (c_custkey) WHERE abs(a.c_acctbal - b.c_acctbal) > 1e-6""")
def rebuild_differences(spark, d):
    a = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    b = a.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0))
    return contracts.differences(a, b, ["c_custkey"]).select("c_custkey", "column")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def repeated_keys(spark, d):
    return contracts.repeated(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Compositions ---------------------------------------------------------------------------


@query(_with(V.PRINTS) + _CLOSES + """, v AS (SELECT symbol, dt, CASE WHEN COUNT(*) >= 10 THEN stddev_samp(ret) * sqrt(13.0) END AS sigma FROM r GROUP BY 1, 2), n AS (SELECT symbol, dt, COUNT(*) AS prints FROM prints GROUP BY 1, 2 HAVING COUNT(*) >= 65)
  SELECT symbol, dt, prints, round(sigma, 6) AS sigma FROM n JOIN v USING (symbol, dt) WHERE sigma > 0""")
def usable_sessions(spark, d):
    return studies.usable_sessions(V.prints(spark, d), KEYS, 65, 1800, 13)


@query(_with(V.PRINTS, V.MESSAGES) + """SELECT m.symbol, m.dt, m.seq, m.size, m.event_type, CAST(p.price AS DOUBLE) AS mid, p.side FROM messages m JOIN prints p USING (symbol, dt, seq)""")
def aligned_rows(spark, d):
    """Messages with the book row of the same place; sessions must have as many of both."""
    m, p = V.messages(spark, d), V.prints(spark, d)
    return studies.aligned(m.select(*KEYS, "seq", "size", "event_type"), p.select(*KEYS, "seq", F.col("price").alias("mid"), "side"), KEYS)


@query(_with(V.PRINTS, V.MESSAGES, V.BARS) + """, a AS (SELECT symbol, dt, stddev_samp(mid) AS sigma, SUM(CASE WHEN k % 5 < 3 THEN floor(size * 100) + 1 ELSE 0 END) AS fills FROM (SELECT p.*, b.mid FROM prints p JOIN bars b ON b.symbol = p.symbol AND b.dt = p.dt AND b.sec = p.sec // 60 * 60) GROUP BY 1, 2),
  b AS (SELECT symbol, dt, SUM(size) AS displayed FROM messages WHERE event_type = 4 GROUP BY 1, 2), c AS (SELECT symbol, dt, MAX(price) - MIN(price) AS spread FROM prints GROUP BY 1, 2)
  SELECT symbol, dt, round(sigma, 6) AS sigma, CAST(fills AS BIGINT) AS fills, CAST(displayed AS BIGINT) AS displayed, round(CAST(spread AS DOUBLE), 6) AS spread FROM a JOIN b USING (symbol, dt) JOIN c USING (symbol, dt)""")
def session_scales(spark, d):
    """Volatility, volume and book tables as one row a session; shares of fills are tallied from prints and from messages and must agree."""
    p = V.prints(spark, d)
    b = minute_bars(spark, d).select(*KEYS, F.col("sec").alias("minute"), "mid")
    marked = p.withColumn("minute", F.floor(F.col("sec") / 60) * 60).join(b, [*KEYS, "minute"])
    reference = marked.groupBy(*KEYS).agg(F.stddev_samp("mid").alias("sigma"), F.sum(F.when(F.col("k") % 5 < 3, F.floor(F.col("size") * 100) + 1).otherwise(0)).alias("fills"))
    volumes = V.messages(spark, d).filter("event_type = 4").groupBy(*KEYS).agg(F.sum("size").alias("displayed"))
    return studies.session_scales(reference, volumes, p.groupBy(*KEYS).agg((F.max("price") - F.min("price")).alias("spread")), KEYS)


@query(_with(V.PRINTS, V.BARS) + """, m AS (SELECT symbol, dt, CAST(floor((sec - 34200) / 60) AS BIGINT) AS minute, SUM(volume) AS v FROM bars WHERE sec >= 34200 GROUP BY 1, 2, 3), s AS (SELECT symbol, dt, minute, v / nullif(SUM(v) OVER (PARTITION BY symbol, dt), 0) AS share FROM m),
  t AS (SELECT symbol, dt, median(share) FILTER (WHERE share > 0) AS typical, MAX(minute) AS last FROM s GROUP BY 1, 2), x AS (SELECT symbol, dt, typical, last, unnest(range(0, 360, 30)) AS f FROM t), y AS (SELECT *, f + unnest(range(0, 30)) AS minute FROM x)
  SELECT y.symbol, y.dt, 34200 + f * 60 AS slice_start, round(SUM(CASE WHEN y.minute <= last THEN COALESCE(share, typical, 0) ELSE 0 END), 6) AS share FROM y LEFT JOIN s ON s.symbol = y.symbol AND s.dt = y.dt AND s.minute = y.minute GROUP BY 1, 2, 3""")
def slice_profile(spark, d):
    b = minute_bars(spark, d).filter("sec >= 34200")
    shares = bar.minute_shares(b, KEYS).withColumnRenamed("slice", "minute")
    s = shares.select(*KEYS).distinct().withColumn("from", F.lit(34200)).withColumn("to", F.lit(34200 + 360 * 60))
    return studies.slice_profile(shares, schedule.slices(s, "from", "to", 1800).select(*KEYS, "slice_start"), 1800, KEYS)


def _ofi_like(spark, d):
    return _long_bars(spark, d).withColumn("ofi_integrated", F.col("signed_vol") * 0.5 + F.col("volume"))


@query()
def flow_comparison(spark, d):
    return studies.incremental(studies.compare_flows(_ofi_like(spark, d), keys=("symbol",)), ("symbol",))


def _published_sql(groups: int, draws: int) -> str:
    """Published fits ``pu`` of each panel of ``rel`` (panel, grp, y, q) with intervals over ``groups`` groups a panel."""
    times = [[1] * groups, *resample.multiplicities(range(groups), draws).tolist()]
    values = ", ".join(f"({t}, {k}, {m})" for t, row in enumerate(times) for k, m in enumerate(row) if m)
    band = lambda c, name: ", ".join(f"quantile_cont({c}, {p}) FILTER (WHERE t > 0) AS {name}_{end}" for p, end in ((0.025, "low"), (0.975, "high")))
    return f""", f AS (SELECT panel, grp, ln(q) AS l, y FROM rel WHERE q > 0 AND y IS NOT NULL), gr AS (SELECT unnest(range(0, 301)) AS j), x AS (SELECT panel, grp, j, y, l, exp(l * j * 0.005) AS x FROM f, gr),
  own AS (SELECT panel, grp, j, SUM(x * y) AS a, SUM(x * x) AS b, SUM(x * y * l) AS da, 2 * SUM(x * x * l) AS db, COUNT(*) AS n FROM x GROUP BY 1, 2, 3), m(t, k, m) AS (VALUES {values}),
  ra AS (SELECT *, dense_rank() OVER (PARTITION BY panel ORDER BY grp) - 1 AS k FROM own), s AS (SELECT panel || '#' || t AS pt, j, SUM(m * a) AS a, SUM(m * b) AS b, SUM(m * da) AS da, SUM(m * db) AS db, CAST(SUM(m * n) AS BIGINT) AS n FROM ra JOIN m USING (k) GROUP BY 1, 2)
  {_root_sql("pt", 0.005)}, ha AS (SELECT pt, a / b AS h FROM s WHERE j = 100), al AS (SELECT split_part(z.pt, '#', 1) AS panel, CAST(split_part(z.pt, '#', 2) AS INTEGER) AS t, c, d, h, n FROM z JOIN ha ON z.pt = ha.pt),
  pu AS (SELECT panel, MAX(CASE WHEN t = 0 THEN c END) AS c_free, MAX(CASE WHEN t = 0 THEN d END) AS delta, MAX(CASE WHEN t = 0 THEN h END) AS c_half, MAX(CASE WHEN t = 0 THEN n END) AS n, {band('d', 'delta')}, {band('h', 'c_half')} FROM al GROUP BY 1)"""


_PUBLISHED = "round(c_free, 6) AS c_free, round(delta, 6) AS delta, round(c_half, 6) AS c_half, n, round(delta_low, 6) AS delta_low, round(delta_high, 6) AS delta_high, round(c_half_low, 6) AS c_half_low, round(c_half_high, 6) AS c_half_high"


@query(_with(V.ORDERS) + ", rel AS (SELECT symbol AS panel, dt AS grp, realised / sigma AS y, q FROM mo)" + _published_sql(30, 50) + f""", ed AS (SELECT panel, list_sort({_EDGES.format(v='q', p=_points(20))}) AS e FROM rel GROUP BY 1),
  bi AS (SELECT rel.panel, q, y, greatest(len(list_filter(e, lambda x: x < q)) - 1, 0) AS bin FROM rel JOIN ed ON rel.panel = ed.panel), me AS (SELECT panel, avg(q) AS q, avg(y) AS y, COUNT(*) AS w FROM bi GROUP BY panel, bin),
  li AS (SELECT panel, ln(MIN(q)) AS lo, ln(MAX(q)) AS hi FROM me GROUP BY 1), cg AS (SELECT me.panel, w, y, q, kk, exp(lo + kk * (hi - lo) / 199) AS c FROM me JOIN li ON me.panel = li.panel, (SELECT unnest(range(0, 200)) AS kk)),
  cx AS (SELECT panel, kk, c, w, y, CASE WHEN q <= c THEN q ELSE sqrt(c * q) END AS x FROM cg), cs AS (SELECT panel, kk, MAX(c) AS c, SUM(w * x * y) / SUM(w * x * x) AS a, SUM(w * y * y) - SUM(w * x * y) * SUM(w * x * y) / SUM(w * x * x) AS sse FROM cx GROUP BY 1, 2),
  cr AS (SELECT panel, arg_min(kk, (sse, kk)) AS kk, arg_min(c, (sse, kk)) AS q_star, arg_min(a, (sse, kk)) AS a FROM cs GROUP BY 1), en AS (SELECT panel, COUNT(*) AS n_orders, median(q) AS median_participation FROM rel GROUP BY 1 HAVING COUNT(*) >= 50)
  SELECT pu.panel AS symbol, {_PUBLISHED}, round(q_star, 6) AS q_star, round(a, 6) AS a, kk > 0 AND kk < 199 AS interior, n_orders, round(median_participation, 6) AS median_participation, 0.02::DOUBLE AS sigma, 100.0::DOUBLE AS close, 1e6::DOUBLE AS mean_volume,
  round(a * q_star * 0.02 * 100 / 0.01, 6) AS ticks, delta_low <= 0.5 AND delta_high >= 0.5 AS brackets_half FROM pu JOIN cr ON pu.panel = cr.panel JOIN en ON pu.panel = en.panel""")
def per_symbol_fits(spark, d):
    """Exponents with block intervals over days, and crossovers in ticks, by symbol."""
    o = V.metaorders(spark, d).select("symbol", F.col("dt").alias("date"), F.col("q").alias("participation"), F.col("realised").alias("impact"), F.col("sigma").alias("sigma_d"))
    daily = o.select("symbol", "date").distinct().select("symbol", F.lit(0.02).alias("sigma"), F.lit(100.0).alias("close"), F.lit(1e6).alias("volume"))
    return studies.per_symbol(o, daily, 20, 50, 50)


@query(_with(V.ORDERS) + """, rel AS (SELECT unnest(['venue', 'consolidated_volume', 'consolidated_sigma', 'consolidated_both']) AS panel, symbol || '_' || strftime(dt, '%Y-%m-%d') AS grp,
  unnest([realised / sigma, realised / sigma, realised / (0.02 + 0.001 * day(dt)), realised / (0.02 + 0.001 * day(dt))]) AS y, unnest([q, shares / (15000 + 500 * day(dt)), q, shares / (15000 + 500 * day(dt))]) AS q FROM mo)""" + _published_sql(150, 50) + f" SELECT panel AS variant, {_PUBLISHED} FROM pu")
def variant_fits(spark, d):
    """The published fit under four pairs of volume and volatility, resampled by session."""
    o = V.metaorders(spark, d).select("symbol", F.col("dt").alias("date"), F.col("shares").alias("Q"), F.col("q").alias("participation"), F.col("realised").alias("impact"), F.col("sigma").alias("sigma_d"))
    day = F.dayofmonth("date")
    v = o.select("symbol", "date").distinct().withColumn("volume_crsp", (15_000 + 500 * day).cast("double")).withColumn("sigma_crsp", 0.02 + 0.001 * day)
    return studies.variant_fits(o, v, 50)


@query()
def schedule_evaluation(spark, d):
    b = _long_bars(spark, d)
    o = V.metaorders(spark, d).withColumn("day", F.datediff("dt", F.lit("2024-01-01")))
    start = F.col("day") * 86_400.0 + F.col("at")
    flat = lambda n, x: F.array_repeat(F.lit(x), n)
    o = o.select("symbol", start.alias("t_start"), (start + F.col("u")).alias("t_end"), "shares", F.lit(1.0).alias("sign"), F.lit(100.0).alias("mid_start"), (100.0 * F.exp("realised")).alias("mid_end"), F.lit(10_000.0).alias("session_volume"), F.lit(0.02).alias("sigma_d"), F.lit(10_000.0).alias("adv"), flat(13, 1.0).alias("profile"), flat(390, 1 / 390).alias("shape"))
    return studies.evaluate_schedules(b, o, ("symbol",), width=3600 * 6, least=5)
