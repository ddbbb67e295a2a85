"""The operators' relations as views over the star-schema tables, in Spark and in SQL.

Each Spark view has a common table expression of the same name for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRINTS = r"""prints AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS dt,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec, event_id AS seq, value AS size,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, 100 + (user_id % 40) * 0.05 AS price,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side,
  CAST(CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS INTEGER) AS sign
  FROM events)"""

MESSAGES = """messages AS (SELECT symbol, dt, seq, CAST(sec AS DOUBLE) AS "time",
  CASE WHEN k % 5 < 3 THEN 4 WHEN k % 5 = 3 THEN 5 ELSE 1 END AS event_type,
  CAST(floor(size * 100) AS BIGINT) + 1 AS size, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction,
  CASE WHEN k % 7 = 0 THEN NULL ELSE price END AS mid FROM prints)"""

BARS = """bars AS (SELECT symbol, dt, sec // 60 * 60 AS sec, SUM(size) AS volume, SUM(size * sign) AS signed_vol,
  arg_max(price, (sec, seq)) AS mid FROM prints GROUP BY symbol, dt, sec // 60 * 60)"""

TAPE = """daily AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice / l_quantity) AS close,
  SUM(l_quantity) AS volume, MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low
  FROM lineitem GROUP BY 1, 2)"""

UNIVERSE = """universe AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, 0.01 / p_retailprice AS relative_tick,
  COALESCE(v, 0) AS dollar_volume FROM part LEFT JOIN (SELECT l_partkey, SUM(l_extendedprice) AS v FROM lineitem GROUP BY 1)
  ON l_partkey = p_partkey)"""

LADDER = """levels AS (SELECT vec_id, label, i AS level, 100 + 0.01 * i AS ask_px, 99.98 - 0.01 * i AS bid_px,
  floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000) + 1 AS ask_sz, floor(abs(CAST(embedding[i + 11] AS DOUBLE)) * 1000) + 1 AS bid_sz
  FROM embeddings, (SELECT unnest(range(0, 10)) AS i))"""

ORDERS = """mo AS (SELECT event_id AS order_id, event_type AS symbol, CAST(ts AS DATE) AS dt,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS "at", value + 1 AS shares, user_id % 40 AS u,
  0.01 * (1 + user_id % 7) * sqrt((value + 1) / 10000.0) AS realised, (value + 1) / 10000.0 AS q,
  0.01 * (1 + event_id % 3) AS sigma, 0.01 * (1 + event_id % 5) AS trail FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clock() -> F.Column:
    return (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    side = F.when(k % 3 == 0, "B").when(k % 3 == 1, "A").otherwise("N")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.to_date("ts").alias("dt"),
        _clock().alias("sec"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("size"),
        k.alias("k"),
        (F.lit(100.0) + (F.col("user_id") % 40) * F.lit(0.05)).alias("price"),
        side.alias("side"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, -1).otherwise(0).alias("sign"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return prints(spark, sf_dir).select(
        "symbol",
        "dt",
        "seq",
        F.col("sec").cast("double").alias("time"),
        F.when(k % 5 < 3, 4).when(k % 5 == 3, 5).otherwise(1).alias("event_type"),
        (F.floor(F.col("size") * 100) + 1).cast("long").alias("size"),
        F.when(k % 2 == 0, 1).otherwise(-1).alias("direction"),
        F.when(k % 7 != 0, F.col("price")).alias("mid"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg(px).alias("close"), F.sum("l_quantity").alias("volume"), F.max(px).alias("high"), F.min(px).alias("low")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    p = table(spark, sf_dir, "part").join(v, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.select(F.col("p_partkey").cast("string").alias("symbol"), (0.01 / F.col("p_retailprice")).alias("relative_tick"), F.coalesce("v", F.lit(0.0)).alias("dollar_volume"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda k: (F.floor(F.abs(F.get("embedding", F.lit(k)).cast("double")) * 1000) + 1).cast("double")
    arrays = {
        "ask_px": [F.lit(100 + 0.01 * k) for k in range(10)],
        "bid_px": [F.lit(99.98 - 0.01 * k) for k in range(10)],
        "ask_sz": [size(k) for k in range(10)],
        "bid_sz": [size(k + 10) for k in range(10)],
    }
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.array(*v).alias(n) for n, v in arrays.items()])


def metaorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shares = F.col("value") + 1
    return e.select(
        F.col("event_id").alias("order_id"),
        F.col("event_type").alias("symbol"),
        F.to_date("ts").alias("dt"),
        _clock().alias("at"),
        shares.alias("shares"),
        (F.col("user_id") % 40).alias("u"),
        (F.lit(0.01) * (1 + F.col("user_id") % 7) * F.sqrt(shares / 10000.0)).alias("realised"),
        (shares / 10000.0).alias("q"),
        (F.lit(0.01) * (1 + F.col("event_id") % 3)).alias("sigma"),
        (F.lit(0.01) * (1 + F.col("event_id") % 5)).alias("trail"),
    )
