"""Joins that plain equality does not express, always with an equality to shuffle by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exprs as X

FIRST, LAST = "1900-01-01", "2100-12-31"
#: Days are counted from here; blocks of up to 2 ** (LEVELS - 1) days hold all dates.
ORIGIN, LEVELS = "0001-01-01", 23
#: Facts of a key from which they are salted.
HOT = 100_000


def day_cells(first: Column, last: Column) -> Column:
    """The fewest blocks of 1, 2, 4 ... days that make up the days from ``first`` to ``last``, as (level, cell)."""
    # From both ends upwards: an end that is no left (right) half of the next larger block is one by itself.
    start = F.struct(first.alias("a"), (last + 1).alias("z"), F.array().cast("array<struct<level:int,cell:int>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        a, z = acc["a"], acc["z"]
        low, high = (a < z) & (a % 2 == 1), (a < z) & (z % 2 == 1)
        # One block left of both ends is the same block.
        high = high & ~(low & (z - 1 == a))
        one = lambda use, cell: F.when(use, F.array(F.struct(level.alias("level"), cell.alias("cell")))).otherwise(F.array())
        out = F.concat(acc["out"], one(low, a), one(high, z - 1))
        return F.struct(F.shiftright(a + low.cast("int"), 1).alias("a"), F.shiftright(z, 1).alias("z"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)["out"]


def valid_at(facts: DataFrame, names: DataFrame, key: str, at: str, start: str, end: str, salts: int = 8) -> DataFrame:
    """Rows of ``names`` valid at each fact's date; open ends reach from 1900 to 2100.

    A name's days are a few blocks of 1, 2, 4 ... days, and a fact's date lies in
    one block of each size; so facts and names meet in equal blocks, each pair
    once, and the join makes no row that is no match. Facts of a key with over
    ``HOT`` of them are dealt out by ``salts``, for which its names are repeated. Both sides are always shuffled:
    estimates know nothing of the repeats, so names would be sent whole to every task.
    """
    day = lambda c: F.datediff(c, F.lit(ORIGIN).cast("date"))
    n = names.withColumn("_from", F.coalesce(F.col(start).cast("date"), F.lit(FIRST).cast("date"))).withColumn("_to", F.coalesce(F.col(end).cast("date"), F.lit(LAST).cast("date")))
    n = n.withColumn("_block", F.explode(day_cells(day("_from"), day("_to")))).drop("_from", "_to")
    hot = F.broadcast(facts.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select(key, F.lit(salts).alias("_salts")))  # one row in HOT facts at most
    n = n.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    # Sizes that no name uses need no block of a fact: one row, LEVELS numbers at most.
    used = n.agg(F.sort_array(F.collect_set("_block.level")).alias("_levels"))
    f = facts.filter(F.col(at).isNotNull()).crossJoin(F.broadcast(used)).join(hot, key, "left")
    blocks = F.transform("_levels", lambda k: F.struct(k.alias("level"), F.floor(day(F.col(at).cast("date")) / F.pow(F.lit(2), k)).cast("int").alias("cell")))
    f = f.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.coalesce("_salts", F.lit(1))).cast("int")).withColumn("_block", F.explode(blocks)).drop("_levels", "_salts")
    return f.hint("merge").join(n.hint("merge"), [key, "_salt", "_block"]).drop("_salt", "_block")


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def resolve_names(names: DataFrame, tickers: Sequence[str], as_of: str, codes: Sequence[int] = (10, 11, 12), priority: Sequence[int] = (11, 10, 12)) -> DataFrame:
    """One security per ticker at a date: by share code, then the latest name, exchange and number."""
    n = names.withColumn("ticker", X.ticker(F.col("ticker"))).filter(F.col("ticker").isin([t.strip().upper().replace(".", "-") for t in tickers]) & F.col("shrcd").isin(list(codes)))
    n = n.withColumn("namedt", F.coalesce("namedt", F.lit(FIRST).cast("date"))).withColumn("nameendt", F.coalesce("nameendt", F.lit(LAST).cast("date")))
    at = F.lit(as_of).cast("date")
    n = n.filter((F.col("namedt") <= at) & (F.col("nameendt") >= at)).withColumn("exchcd", F.coalesce("exchcd", F.lit(99)))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in priority]), F.col("shrcd")), F.lit(0)), F.lit(99))
    return best(n, ["ticker"], [rank.asc(), F.col("namedt").desc(), F.col("nameendt").desc(), F.col("exchcd").asc(), F.col("permno").desc()])


def nearest(size: Column, centers: Column) -> Column:
    """Index of the nearest of ``centers`` (an array of log sizes) in log size, the lower one on ties."""
    apart = F.transform(centers, lambda c, k: F.struct(F.abs(F.ln(size) - c).alias("d"), k.alias("bin")))
    return F.array_min(apart)["bin"]


def nearest_center(points: DataFrame, size: str, centers: Sequence[float]) -> DataFrame:
    """Index of the nearest centre in log size. ``centers``: a short list."""
    return points.filter(F.col(size) > 0).withColumn("bin", nearest(F.col(size), F.array(*[F.lit(float(v)) for v in centers])))


def with_sizes(snapshots: DataFrame, sizes: Sequence[float], name: str = "x") -> DataFrame:
    """Every snapshot with every size of a fixed grid; no shuffle."""
    return snapshots.withColumn(name, F.explode(F.array(*[F.lit(float(s)) for s in sizes])))


def first_sessions_out(sessions: DataFrame, symbol: str = "symbol", date: str = "dt") -> DataFrame:
    """Sessions that have an earlier one of the same symbol."""
    first = sessions.groupBy(F.col(symbol).alias("_s")).agg(F.min(date).alias("_first"))
    return sessions.join(first, (F.col(symbol) == F.col("_s")) & (F.col(date) > F.col("_first")), "left_semi")
