"""Queries of scans, sinks, contracts and scalar expressions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X
from tidewright.operators import bars as bar
from tidewright.operators import book, contracts, fits, joins, resample, schedule, universe, volatility
from tidewright.plans import views as V
from tidewright.plans.catalogue import KEYS, minute_bars, query
from tidewright.plans.catalogue import _with as with_views
from tidewright.sources import readers, sinks
from tidewright.sources.scratch import folder
from tidewright.streaming import live

# Sources ----------------------------------------------------------------------


@query("SELECT s_suppkey AS suppkey, round(s_acctbal, 6) AS acctbal, s_name AS name FROM supplier")
def csv_columns(spark, d):
    """A compressed CSV table, left alone by a second build, read by name with required columns."""
    path = folder(spark, "csv")
    s = V.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(1).alias("unused"), F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("acctbal"))
    s.write.options(header=True, compression="gzip").csv(path)
    sinks.table(s.limit(0), path, "csv")
    found = readers.need(spark, path, "tidewright build suppliers")
    return readers.csv(spark, found, "suppkey bigint, acctbal double, name string", columns=["suppkey", "acctbal", "name"])


@query("SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 6) AS bal FROM customer")
def csv_by_place(spark, d):
    """A CSV table without a header: columns by place."""
    path = folder(spark, "csv")
    V.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path)
    return readers.csv(spark, path, "k bigint, name string, bal double", header=False)


@query(with_views(V.PRINTS) + "SELECT symbol, sec, seq FROM prints ORDER BY sec, seq LIMIT 100")
def first_prints(spark, d):
    """A CSV scan in total order, for its first rows."""
    path = folder(spark, "csv")
    sinks.table(V.prints(spark, d).select("symbol", "sec", "seq"), path, "csv")
    return readers.csv(spark, path, "symbol string, sec bigint, seq bigint").orderBy("sec", "seq").limit(100)


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS symbol FROM lineitem WHERE l_quantity > 25 AND CAST(l_shipdate AS DATE) = (SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem)")
def members_at(spark, d):
    """Symbols active at a date, from a Parquet table of memberships."""
    path = folder(spark, "members")
    m = V.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") > 25).alias("active"))
    sinks.table(m, path)
    at = m.agg(F.min("date")).first()[0]
    return readers.members(readers.parquet(spark, path, ["symbol", "date", "active"]), str(at))


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def json_document(spark, d):
    """One JSON document of nested records."""
    path = folder(spark, "json")
    n = V.table(spark, d, "nation").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("nations"))
    n.select(F.to_json(F.struct(F.lit("nations").alias("title"), "nations"))).write.text(path)
    doc = readers.document(spark, path, "title string, nations array<struct<k bigint, name string, region bigint>>")
    return doc.filter("title = 'nations'").select(F.explode("nations").alias("n")).select("n.*")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def csv_tree(spark, d):
    """CSV files in folders, with nanosecond times."""
    path = folder(spark, "tree")
    e = V.table(spark, d, "events")
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    e.select("event_id", nanos.alias("ts_event"), F.col("event_type").alias("kind")).write.partitionBy("kind").option("header", True).csv(path)
    return readers.tree(spark, path, "event_id bigint, ts_event bigint", nanos="ts_event").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(with_views(V.PRINTS) + """, s AS (SELECT symbol, dt FROM prints ORDER BY symbol, dt LIMIT 1) SELECT symbol || '_' || strftime(dt, '%Y-%m-%d') AS session, symbol, dt, seq, CAST(price AS DOUBLE) AS price FROM prints JOIN s USING (symbol, dt)""")
def session_layout(spark, d):
    """One session's table by its path, its key built and taken apart again."""
    p, root = V.prints(spark, d), folder(spark, "sessions")
    one = p.select(*KEYS).orderBy(*KEYS).first()
    path = readers.session_path(root, one["symbol"], str(one["dt"]), "trades")
    sinks.table(p.filter((F.col("symbol") == one["symbol"]) & (F.col("dt") == one["dt"])).select("seq", "price", X.session_key(F.col("symbol"), F.col("dt")).alias("session")), path)
    t = readers.landed(spark, path, "seq bigint, price double, session string")
    return t.select("session", X.session_symbol(F.col("session")).alias("symbol"), X.session_date(F.col("session")).alias("dt"), "seq", "price")


@query(with_views(V.PRINTS) + "SELECT symbol, COUNT(*) AS n, round(SUM(size), 6) AS size, round(MAX(size) / AVG(size), 6) AS peak FROM prints GROUP BY 1")
def shared_scan(spark, d):
    """Two aggregates over one scan that is kept."""
    p = readers.shared(V.prints(spark, d))
    a = p.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    b = p.groupBy("symbol").agg((F.max("size") / F.avg("size")).alias("peak"))
    return a.join(b, "symbol")


@query("""SELECT event_type AS symbol, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS dt, CAST(hour(timezone('America/New_York', timezone('UTC', ts))) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec, round((user_id + 1) / 8.0, 6) AS price,
  CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS BIGINT) AS sign, event_id AS sequence FROM events""")
def prints_from_raw(spark, d):
    """Raw trades: UTC times to exchange seconds, fixed-point prices, side codes."""
    side = F.when(F.col("event_id") % 3 == 0, "B").when(F.col("event_id") % 3 == 1, "A").otherwise("N")
    raw = V.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("user_id") + 1) * 125_000_000).alias("price"), F.col("value").alias("size"), side.alias("side"), F.col("event_id").alias("sequence"))
    p = readers.prints(raw)
    return p.select("symbol", F.col("date").alias("dt"), "sec", "price", F.col("sign").cast("long").alias("sign"), "sequence")


# Sinks ------------------------------------------------------------------------


@query("SELECT s_suppkey AS k, round(CAST(printf('%.5e', s_acctbal / 7) AS DOUBLE), 6) AS x FROM supplier")
def rounded_table(spark, d):
    """A table at six significant digits."""
    path = folder(spark, "rounded")
    sinks.table(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 7).alias("x")), path, "csv", digits=6)
    return readers.csv(spark, path, "k bigint, x double")


@query("SELECT 'k,name' AS line UNION ALL SELECT concat(r_regionkey, ',', r_name) FROM region")
def report_lines(spark, d):
    """A small report as exact text."""
    path = folder(spark, "report") + ".csv"
    sinks.report(V.table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path, ["k"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT CAST(length(r_name) + 1 AS BIGINT) AS bytes, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_manifest(spark, d):
    """Bytes and digest of every file of a table."""
    path = folder(spark, "manifest")
    V.table(spark, d, "region").select("r_name", "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return sinks.manifest(spark, [f"{path}/*"]).select("bytes", "sha256")


# Contracts and sets -------------------------------------------------------------


@query("SELECT k, x FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'new ' || n_name FROM nation WHERE n_nationkey >= 10)")
def appended_members(spark, d):
    """Missing members are appended; a second time changes nothing."""
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    more = n.withColumn("x", F.concat(F.lit("new "), "x"))
    once = readers.appended(n.filter("k < 10"), more, ["k"])
    return readers.appended(once, more, ["k"])


@query("""SELECT n_name AS name, 'left' AS only_in FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_name, 'left' FROM nation WHERE n_nationkey % 7 = 0
  UNION ALL SELECT n_name || '!', 'right' FROM nation WHERE n_nationkey % 5 = 0""")
def unequal_rows(spark, d):
    """Rows with multiplicity that one of two tables lacks, over tables of unlike columns put together."""
    n = V.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    a = readers.union([n, n.filter("k % 7 = 0").select("name")]).select("name")
    b = n.select(F.when(F.col("k") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"))
    return contracts.same_rows(a, b)


@query("""SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0) GROUP BY 1""")
def uncovered_keys(spark, d):
    """Keys of one table that a part of another lacks, with their rows."""
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = V.table(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("k"))
    return c.join(contracts.uncovered(c, s, ["k"]), "k").groupBy("k").agg(F.count("*").alias("n"))


@query(with_views(V.PRINTS) + "SELECT symbol, sec // 3600 AS hour, COUNT(*) - 1 AS missing FROM prints GROUP BY 1, 2")
def conserved_volume(spark, d):
    """Hours whose parts fall short of their total by one row each."""
    p = V.prints(spark, d).select("symbol", F.floor(F.col("sec") / 3600).alias("hour"))
    whole = p.groupBy("symbol", "hour").agg(F.count("*").cast("double").alias("total"))
    parts = whole.select("symbol", "hour", F.lit(1.0).alias("part"))
    broken = contracts.conserved(parts, whole, ["symbol", "hour"], "part", "total")
    # A group of one row is whole.
    return whole.join(broken.select("symbol", "hour", "parts"), ["symbol", "hour"], "left").select("symbol", "hour", (F.col("total") - F.coalesce("parts", "total")).cast("long").alias("missing"))


# Expressions --------------------------------------------------------------------


@query("""SELECT p_partkey AS k, round(CASE WHEN x IN ('NaN', 'Infinity') THEN NULL ELSE TRY_CAST(x AS DOUBLE) END, 6) AS x FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '1e3' WHEN 2 THEN 'NaN' WHEN 3 THEN 'Infinity'
  ELSE CAST(p_size AS VARCHAR) || '.25' END AS x FROM part)""")
def lenient_numbers(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "1e3").when(k % 5 == 2, "NaN").when(k % 5 == 3, "Infinity").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".25")))
    return V.table(spark, d, "part").select(k.alias("k"), X.number(text).alias("x"))


@query("SELECT c_custkey AS k, replace(upper(trim('  ' || c_mktsegment || '.b ')), '.', '-') AS ticker FROM customer")
def tickers(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), X.ticker(F.concat(F.lit("  "), "c_mktsegment", F.lit(".b "))).alias("ticker"))


@query(with_views(V.TAPE) + """SELECT permno, permno % 3 = 0 AS midpoint, round(AVG(close), 6) AS price, round(SUM(volume), 4) AS volume, round(SUM(close * volume) / 1e6, 6) AS millions FROM daily GROUP BY 1""")
def midpoint_prices(spark, d):
    """Negative prices mark midpoints."""
    p = V.daily(spark, d).select("permno", "date", F.when(F.col("permno") % 3 == 0, -F.col("close")).otherwise(F.col("close")).alias("price"), F.col("volume").cast("string").alias("volume"))
    c = universe.consolidated(p)
    return c.groupBy("permno").agg(F.bool_and("price_is_midpoint").alias("midpoint"), F.avg("price_crsp").alias("price"), F.round(F.sum("volume_crsp"), 4).alias("volume"), (F.sum("dollar_volume_crsp") / 1e6).alias("millions"))


@query(with_views(V.TAPE) + """, s AS (SELECT CAST(permno AS VARCHAR) AS symbol, AVG(close) AS close, AVG(close * volume) AS dv, AVG((high - low) / close) AS r, COUNT(*) AS days FROM daily GROUP BY 1)
  SELECT symbol, days, round(ln(0.01 / close), 6) AS log_relative_tick, round(ln(dv), 6) AS log_dollar_volume, round(r * close / 0.01, 4) AS range_ticks FROM s WHERE days >= 15""")
def log_regressors(spark, d):
    s = universe.regressors(universe.daily_stats(V.daily(spark, d).withColumn("symbol", F.col("permno").cast("string"))))
    return s.select("symbol", "days", "log_relative_tick", "log_dollar_volume", F.round("range_ticks", 4).alias("range_ticks"))


@query(with_views(V.ORDERS) + """, f AS (SELECT symbol, regr_slope(ln(realised), ln(q)) AS e, regr_r2(ln(realised), ln(q)) AS r2 FROM mo GROUP BY 1)
  SELECT symbol, printf('exponent %.3f (R2 %.3f): %s', e, r2, CASE WHEN abs(e - 0.5) <= 0.1 THEN 'consistent with a square root' WHEN e < 0.4 THEN 'flatter than a square root' ELSE 'steeper than a square root' END) AS verdict,
  printf('[%.3f, %.3f]', e - 0.1, e + 0.1) AS band FROM f""")
def verdicts(spark, d):
    f = fits.log_log(V.metaorders(spark, d), "q", "realised", ["symbol"])
    return f.select("symbol", X.verdict(F.col("exponent"), F.col("r2")).alias("verdict"), X.band_text(F.col("exponent") - 0.1, F.col("exponent") + 0.1).alias("band"))


@query(with_views(V.ORDERS) + """, s AS (SELECT symbol, AVG(sigma) AS sigma, 1 + AVG(q) AS a, MAX(q) / 10 AS qs, 100.0 AS price FROM mo GROUP BY 1)
  SELECT symbol, round(qs, 6) AS q_star, round(a * qs, 6) AS impact_sigma, round(a * qs * sigma * price, 6) AS impact_money, round(a * qs * sigma * price / 0.01, 6) AS impact_ticks, a * qs * sigma * price / 0.01 > 1 AS above_one_tick FROM s""")
def crossovers_in_ticks(spark, d):
    s = V.metaorders(spark, d).groupBy("symbol").agg(F.avg("sigma").alias("sigma"), (1 + F.avg("q")).alias("a"), (F.max("q") / 10).alias("qs"))
    return s.select("symbol", X.crossover_ticks(F.col("a"), F.col("qs"), F.col("sigma"), F.lit(100.0)).alias("c")).select("symbol", "c.q_star", "c.impact_sigma", "c.impact_money", "c.impact_ticks", "c.above_one_tick")


@query(with_views(V.ORDERS) + "SELECT order_id, round((realised - AVG(realised) OVER (PARTITION BY symbol)) / stddev_pop(realised) OVER (PARTITION BY symbol), 6) AS z FROM mo")
def standard_scores(spark, d):
    return V.metaorders(spark, d).select("order_id", X.z_score(F.col("realised"), Window.partitionBy("symbol")).alias("z"))


# Joins, books and profiles --------------------------------------------------------


@query("""WITH n AS (SELECT replace(upper(p_brand), '#', '-') AS ticker, p_partkey AS permno, CAST(9 + p_size % 5 AS BIGINT) AS shrcd, CASE WHEN p_partkey % 4 = 0 THEN 99 ELSE p_partkey % 3 END AS exchcd,
  CASE WHEN p_partkey % 6 = 0 THEN DATE '1900-01-01' ELSE DATE '2000-01-01' + CAST(p_partkey % 5000 AS INTEGER) END AS a, CASE WHEN p_partkey % 2 = 0 THEN DATE '2100-12-31' ELSE DATE '2010-01-01' + CAST(p_partkey % 900 AS INTEGER) END AS b FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE shrcd WHEN 11 THEN 1 WHEN 10 THEN 2 ELSE 3 END, a DESC, b DESC, exchcd, permno DESC) AS k FROM n WHERE shrcd IN (10, 11, 12) AND a <= DATE '2008-06-02' AND b >= DATE '2008-06-02')
  SELECT ticker, permno, shrcd FROM r WHERE k = 1 AND ticker <> 'BRAND-11'""")
def names_at(spark, d):
    """One security per ticker at a date, among a list of tickers."""
    k = F.col("p_partkey")
    names = V.table(spark, d, "part").select(
        F.concat(F.lit(" "), F.lower(F.translate("p_brand", "#", "."))).alias("ticker"),
        k.alias("permno"),
        (9 + F.col("p_size") % 5).cast("long").alias("shrcd"),
        F.when(k % 4 != 0, k % 3).alias("exchcd"),
        F.when(k % 6 != 0, F.date_add(F.lit("2000-01-01").cast("date"), (k % 5000).cast("int"))).alias("namedt"),
        F.when(k % 2 != 0, F.date_add(F.lit("2010-01-01").cast("date"), (k % 900).cast("int"))).alias("nameendt"),
    )
    tickers_ = [f"Brand.{k}" for k in range(1, 26) if k != 11]
    return joins.resolve_names(names, tickers_, "2008-06-02").select("ticker", "permno", "shrcd")


@query(with_views(V.UNIVERSE) + "SELECT symbol, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN 'stratified' ELSE 'named' END AS role FROM universe WHERE CAST(symbol AS BIGINT) % 3 = 0 OR symbol IN ('1', '2', '3', '4')")
def roles(spark, d):
    u = V.universe(spark, d)
    return universe.roles(u, u.filter(F.col("symbol").cast("long") % 3 == 0), ["1", "2", "3", "4"]).select("symbol", "role")


@query(with_views(V.ORDERS) + "SELECT symbol, dt, CAST(MAX(ceil(user_id_0)) AS DOUBLE) AS scale, COUNT(*) AS n FROM (SELECT *, day(dt) * 0.5 AS user_id_0 FROM mo) GROUP BY 1, 2")
def session_firsts(spark, d):
    o = V.metaorders(spark, d).withColumn("scale", F.ceil(F.dayofmonth("dt") * 0.5).cast("double"))
    return universe.first_of_sessions(o, ["scale"], KEYS)


@query(with_views(V.ORDERS) + """, c AS (SELECT symbol, sec // 21600 AS bucket, AVG(sigma) AS coefficient FROM (SELECT symbol, "at" AS sec, sigma FROM mo) GROUP BY 1, 2)
  SELECT order_id, mo."at" // 21600 AS bucket, round(coefficient, 6) AS coefficient FROM mo JOIN c ON c.symbol = mo.symbol AND c.bucket = mo."at" // 21600""")
def bucket_coefficients(spark, d):
    """Each row with its bucket's coefficient; every bucket must have one."""
    o = V.metaorders(spark, d).withColumn("bucket", F.floor(F.col("at") / 21600))
    c = o.groupBy("symbol", "bucket").agg(F.avg("sigma").alias("coefficient"))
    return schedule.with_bucket(o, c, ["symbol"], "bucket").select("order_id", "bucket", "coefficient")


@query(with_views(V.LADDER) + """, s AS (SELECT vec_id, MAX(CASE WHEN level = 0 THEN bid_px END) AS b, MAX(CASE WHEN level = 0 THEN ask_px + 0.005 * (vec_id % 5 - 3) END) AS a FROM levels GROUP BY 1)
  SELECT vec_id, round(CAST(a - b AS DOUBLE), 6) AS spread FROM s WHERE a > b""")
def uncrossed_books(spark, d):
    """Snapshots whose touch does not cross, some asks being moved below their bids."""
    moved = F.transform("ask_px", lambda x: x + 0.005 * (F.col("vec_id") % 5 - 3))
    s = V.ladder(spark, d).withColumn("ask_px", moved)
    return book.uncrossed(s).select("vec_id", (F.get("ask_px", F.lit(0)) - F.get("bid_px", F.lit(0))).alias("spread"))


@query(with_views(V.LADDER) + """, s AS (SELECT vec_id, vec_id % 1440 AS minute, label AS symbol, CASE WHEN vec_id % 3 = 0 THEN MAX(CASE WHEN level = 1 THEN ask_sz END) ELSE MAX(CASE WHEN level = 0 THEN ask_sz END) END AS depth FROM levels GROUP BY vec_id, label),
  a AS (SELECT symbol, minute - 570 AS minute, AVG(depth) AS depth FROM s GROUP BY 1, 2) SELECT minute, round(AVG(depth), 6) AS depth FROM a GROUP BY 1""")
def minute_depth(spark, d):
    """First positive size of a book by minute: within a session, then across."""
    sizes = F.when(F.col("vec_id") % 3 == 0, F.transform("ask_sz", lambda x, k: F.when(k == 0, F.lit(0.0)).otherwise(x))).otherwise(F.col("ask_sz"))
    one = V.ladder(spark, d).withColumn("sec", (F.col("vec_id") % 1440) * 60).withColumnRenamed("label", "symbol")
    return bar.depth_by_minute(one, sizes, ("symbol",))


@query(with_views(V.PRINTS, V.BARS) + """, v AS (SELECT symbol, dt, sec // 7200 AS bucket, SUM(volume) AS v FROM bars GROUP BY 1, 2, 3), s AS (SELECT *, v / SUM(v) OVER (PARTITION BY symbol, dt) AS share FROM v), k AS (SELECT DISTINCT symbol, dt FROM s),
  m AS (SELECT k.symbol, k.dt, bucket, median(share) AS m, COUNT(*) AS donors FROM k JOIN s ON s.symbol = k.symbol AND s.dt < k.dt GROUP BY 1, 2, 3) SELECT symbol, dt, bucket, donors, round(m / SUM(m) OVER (PARTITION BY symbol, dt), 6) AS share FROM m""")
def donor_volume_shape(spark, d):
    """Median volume share of earlier sessions, brought to a sum of one."""
    v = minute_bars(spark, d).groupBy(*KEYS, F.floor(F.col("sec") / 7200).alias("bucket")).agg(F.sum("volume").alias("volume"))
    return volatility.donor_shares(v, "prior", "volume", "bucket", KEYS)


# Resampled blocks -------------------------------------------------------------------

_DRAWS = 200
#: The five event types of the driver's tables, in order, are the blocks.
_TIMES = ", ".join(f"({t}, {k}, {m})" for t, row in enumerate(resample.multiplicities(range(5), _DRAWS).tolist()) for k, m in enumerate(row))
_MEANS = ", ".join(f"({t}, {k})" for t, row in enumerate(np.random.default_rng(0).integers(0, 5, (_DRAWS, 5)).tolist()) for k in row)


def _picks() -> str:
    rng = np.random.default_rng(0)
    return ", ".join(f"({t}, {k})" for t in range(_DRAWS) for k in rng.choice(5, size=5, replace=True).tolist())


@query(with_views(V.ORDERS) + f""", s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k, SUM(sqrt(q) * realised / sigma) AS a, SUM(q) AS b, COUNT(*) AS n FROM mo GROUP BY symbol),
  m(t, k, m) AS (VALUES {_TIMES}), c AS (SELECT t, SUM(m * a) / SUM(m * b) AS c FROM s JOIN m USING (k) GROUP BY t)
  SELECT round((SELECT SUM(a) / SUM(b) FROM s), 6) AS c_half, round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high, (SELECT CAST(SUM(n) AS BIGINT) FROM s) AS n FROM c""")
def published_half(spark, d):
    """Level at a square root, with its block interval over sessions."""
    r = fits.published(V.metaorders(spark, d), F.col("realised") / F.col("sigma"), "q", "symbol", _DRAWS)
    return spark.createDataFrame([(r["c_half"], r["c_half_low"], r["c_half_high"], r["n"])], "c_half double, low double, high double, n long")


@query(with_views(V.ORDERS) + f""", s AS (SELECT row_number() OVER (ORDER BY symbol) - 1 AS k, AVG(realised) * 1000 AS v FROM mo GROUP BY symbol), m(t, k) AS (VALUES {_MEANS}), c AS (SELECT t, AVG(v) AS c FROM s JOIN m USING (k) GROUP BY t)
  SELECT round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high FROM c""")
def mean_band(spark, d):
    """Bootstrap band of a mean over sessions."""
    v = V.metaorders(spark, d).groupBy("symbol").agg((F.avg("realised") * 1000).alias("v")).orderBy("symbol").collect()
    return spark.createDataFrame([tuple(map(float, resample.band([r["v"] for r in v], _DRAWS)))], "low double, high double")


@query(with_views(V.ORDERS) + f""", s AS (SELECT symbol, dt, AVG(realised) * 1000 AS v FROM mo GROUP BY 1, 2), g AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM mo)), m(t, k) AS (VALUES {_picks()}),
  c AS (SELECT t, median(v) AS c FROM m JOIN g USING (k) JOIN s USING (symbol) GROUP BY t) SELECT round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high FROM c""")
def cluster_band(spark, d):
    """Bootstrap interval of a median over sessions, resampled by whole symbols."""
    v = V.metaorders(spark, d).groupBy("symbol", "dt").agg((F.avg("realised") * 1000).alias("v")).collect()
    return spark.createDataFrame([tuple(map(float, resample.cluster([r["v"] for r in v], [r["symbol"] for r in v], draws=_DRAWS)))], "low double, high double")


@query(with_views(V.ORDERS) + """, p AS (SELECT order_id, t, shares * t AS x, 100 + 0.01 * (u % 7) * t AS m FROM mo, (SELECT unnest(range(0, 5)) AS t)),
  i AS (SELECT a.order_id, 0.5 * SUM(a.x * b.x * CASE abs(a.t - b.t) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END) AS cost FROM p a JOIN p b ON a.order_id = b.order_id GROUP BY 1), z AS (SELECT order_id, SUM(x) AS s, SUM(x * m) AS paid FROM p GROUP BY 1)
  SELECT order_id, round(paid / s - 100, 6) AS drift_per_share, round(CAST(100 * cost / s AS DOUBLE), 6) AS impact_per_share FROM z JOIN i USING (order_id)""")
def replayed_paths(spark, d):
    """Drift and impact of a growing schedule along a mid path, by order."""
    o = V.metaorders(spark, d).select("order_id", "shares", "u", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slice"))
    rows = o.select("order_id", "slice", (F.col("shares") * F.col("slice")).alias("shares"), (100 + 0.01 * (F.col("u") % 7) * F.col("slice")).alias("mid"))
    return schedule.replayed(rows, [1.0, 0.5, 0.25], ["order_id"]).select("order_id", "drift_per_share", "impact_per_share")


@query(with_views(V.ORDERS) + f""", s AS (SELECT row_number() OVER (ORDER BY symbol) - 1 AS k, COUNT(*) AS n, SUM(ln(q)) AS x, SUM(ln(realised)) AS y, SUM(ln(q) * ln(q)) AS xx, SUM(ln(q) * ln(realised)) AS xy FROM mo GROUP BY symbol), m(t, k, m) AS (VALUES {_TIMES}),
  c AS (SELECT t, (SUM(m * n) * SUM(m * xy) - SUM(m * x) * SUM(m * y)) / (SUM(m * n) * SUM(m * xx) - SUM(m * x) * SUM(m * x)) AS c FROM s JOIN m USING (k) GROUP BY t) SELECT round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high FROM c""")
def exponent_band(spark, d):
    """Block interval of a log-log exponent."""
    return spark.createDataFrame([tuple(map(float, fits.log_log_interval(V.metaorders(spark, d), "q", "realised", "symbol", _DRAWS)))], "low double, high double")


# Streams ------------------------------------------------------------------------------


@query(with_views(V.PRINTS) + """, p AS (SELECT prints.*, ts FROM prints JOIN events ON event_id = seq), b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS start, SUM(size) AS volume, SUM(size * sign) AS signed_vol, arg_max(price, (ts, seq)) AS mid FROM p GROUP BY 1, 2)
  SELECT symbol, strftime(start, '%Y-%m-%d %H:%M') AS start, round(volume, 6) AS volume, round(signed_vol, 6) AS signed_vol, CAST(mid AS DOUBLE) AS mid FROM b WHERE start + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 1 MINUTE FROM events)""")
def streamed_bars(spark, d):
    """Bars of a stream of prints, as far as its watermark closes them."""
    source, made = folder(spark, "stream-in"), folder(spark, "stream-out")
    e = V.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    V.prints(spark, d).join(e, "seq").select("symbol", "ts", "seq", "price", "size", "sign").write.parquet(source)
    prints = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = live.bars(prints, "1 hour", "1 minute").writeStream.format("parquet").option("checkpointLocation", made + "-log").trigger(availableNow=True).start(made)
    out.awaitTermination()
    return spark.read.parquet(made).select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "volume", "signed_vol", "mid")


def _streamed(spark, rows, runs):
    """``runs`` of a stream of the files of ``rows``, as far as its watermark closes them."""
    source, made = folder(spark, "stream-in"), folder(spark, "stream-out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = runs(stream).writeStream.format("parquet").option("checkpointLocation", made + "-log").trigger(availableNow=True).start(made)
    out.awaitTermination()
    return spark.read.parquet(made)


@query(with_views(V.PRINTS) + """, n AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS w FROM events WHERE event_id IN (SELECT seq FROM prints WHERE sign <> 0)), p AS (SELECT symbol, dt, seq, sign, size, ts FROM prints JOIN events ON event_id = seq, n WHERE sign <> 0 AND ts < w),
  f AS (SELECT *, SUM(CASE WHEN sign = b THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, dt ORDER BY seq) AS run FROM (SELECT *, lag(sign) OVER (PARTITION BY symbol, dt ORDER BY seq) AS b FROM p)),
  r AS (SELECT symbol, dt, run, MAX(sign) AS sign, SUM(size) AS shares, COUNT(*) AS n_fills, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM f GROUP BY 1, 2, 3), z AS (SELECT *, MAX(run) OVER (PARTITION BY symbol, dt) AS most FROM r)
  SELECT symbol, CAST(sign AS BIGINT) AS sign, round(shares, 6) AS shares, n_fills, first_seq, last_seq FROM z, n WHERE run < most OR dt + INTERVAL 1 DAY <= w""")
def streamed_runs(spark, d):
    """Runs of a stream of fills, ended by a change of sign or by their day."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    fills = V.prints(spark, d).filter("sign <> 0").join(e, "seq").select("symbol", "ts", "seq", F.col("sign").cast("int").alias("sign"), "size")
    return _streamed(spark, fills, live.fill_runs)


@query(with_views(V.PRINTS, V.BARS) + """, b AS (SELECT symbol, dt, sec // 1800 * 1800 AS bin, SUM(signed_vol) AS signed, SUM(volume) AS volume, arg_min(mid, sec) AS a, arg_max(mid, sec) AS z FROM bars GROUP BY 1, 2, 3),
  t AS (SELECT *, dt + to_seconds(bin) AS ts, CASE WHEN abs(signed) / nullif(volume, 0) >= 0.3 AND signed <> 0 THEN sign(signed) ELSE 0 END AS way FROM b), n AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS w FROM t), p AS (SELECT * FROM t, n WHERE ts < w),
  f AS (SELECT *, SUM(CASE WHEN way = l AND bin - k = 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, dt ORDER BY bin) AS run FROM (SELECT *, lag(way) OVER o AS l, lag(bin) OVER o AS k FROM p WINDOW o AS (PARTITION BY symbol, dt ORDER BY bin))),
  r AS (SELECT symbol, dt, run, MAX(way) AS way, SUM(signed) AS net, SUM(volume) AS gross, COUNT(*) AS n_bins, MIN(bin) AS bin_start, MAX(bin) AS last, arg_min(a, bin) AS mid_start, arg_max(z, bin) AS mid_end FROM f WHERE way <> 0 GROUP BY 1, 2, 3), z AS (SELECT r.*, (SELECT MAX(f.run) FROM f WHERE f.symbol = r.symbol AND f.dt = r.dt) AS most FROM r)
  SELECT symbol, CAST(way AS BIGINT) AS sign, round(net, 6) AS net, round(gross, 6) AS gross, n_bins, strftime(dt + to_seconds(bin_start), '%Y-%m-%d %H:%M') AS bin_start, CAST(mid_start AS DOUBLE) AS mid_start, CAST(mid_end AS DOUBLE) AS mid_end
  FROM z, n WHERE run < most OR least(dt + INTERVAL 1 DAY, dt + to_seconds(last + 1800)) < w""")
def streamed_bin_runs(spark, d):
    """Runs of a stream of half-hour bins, ended by a change of direction, a missing bin or their day."""
    b = bar.directional(minute_bars(spark, d), KEYS, 1800)
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("dt").cast("timestamp")) + F.col("bin"))
    bins = b.select("symbol", ts.alias("ts"), "signed", "volume", "mid_first", "mid_last")
    out = _streamed(spark, bins, lambda s: live.bin_runs(s, 1800))
    return out.withColumn("bin_start", F.date_format("bin_start", "yyyy-MM-dd HH:mm"))
