"""Streaming forms of bars and runs; each equals its batch form on complete data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewright.functions import exprs as X

RUNS = "symbol string, sign int, shares double, n_fills long, first_seq long, last_seq long"
BIN_RUNS = "symbol string, sign int, net double, gross double, n_bins long, bin_start timestamp, mid_start double, mid_end double"
#: A row that waits for the watermark, and the run that is open.
WAITING = "at long, seq long, sign int, a double, b double, first double, last double"
OPEN = "sign int, a double, b double, n long, first_seq long, last_seq long, first_at long, last_at long, first double, last double"
DAY = 86_400_000


def bars(prints: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling bars of prints (symbol, ts, seq, price, size, sign); rows later than ``late`` are dropped."""
    return (
        prints.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "symbol")
        .agg(F.sum("size").alias("volume"), F.sum(F.col("size") * F.col("sign")).alias("signed_vol"), F.max_by("price", F.struct("ts", "seq")).alias("mid"))
        .select("symbol", F.col("window.start").alias("start"), "volume", "signed_vol", "mid")
    )


class Runs(StatefulProcessor):
    """Runs of one symbol's day in sequence order, whatever order its rows arrive in.

    Rows wait in a list until the watermark passes them, so none can come before
    them any more, and are then taken in order of ``seq``. A run ends when the sign
    changes, with its day (UTC), and, given ``width`` (milliseconds between rows), at
    a row that is missing; rows of sign 0 belong to no run. Timers stand at the
    first waiting row and at the end of the open run, so that runs close without
    further rows. Runs end with their day, so each day has a state of its own: a timer
    takes the rows of one day at most into memory, also where a first batch holds all.
    """

    def __init__(self, width: int | None = None) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for frame in rows:
            new = [tuple(r) for r in frame[[x.split()[0] for x in WAITING.split(", ")]].itertuples(index=False)]
            new = [(int(at), int(seq), int(sign), float(a), float(b), float(f), float(x)) for at, seq, sign, a, b, f, x in new]
            if new:
                self.waiting.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = sorted((r for r in held if r[0] < now), key=lambda r: r[1]), [r for r in held if r[0] >= now]
        run = tuple(self.open.get()) if self.open.exists() else None
        done: list[tuple] = []
        for at, seq, sign, a, b, first, last in ready:
            if run and (sign != run[0] or at >= self.ends(run)):
                done.append(run)
                run = None
            if sign and run:
                run = (sign, run[1] + a, run[2] + b, run[3] + 1, run[4], seq, run[6], at, run[8], last)
            elif sign:
                run = (sign, a, b, 1, seq, seq, at, at, first, last)
        if run and self.ends(run) <= now:
            done.append(run)
            run = None
        if len(later) < len(held):
            self.waiting.put(later) if later else self.waiting.clear()
        self.open.update(run) if run else self.open.clear()
        ends = ([self.ends(run)] if run else []) + [r[0] + 1 for r in later]
        if ends:
            self.handle.registerTimer(max(min(ends), now + 1))
        if done:
            yield pd.DataFrame([(*key, *r) for r in done], columns=["symbol", "day", *(x.split()[0] for x in OPEN.split(", "))])

    def ends(self, run: tuple) -> int:
        """The first time (ms) that no row of the run can have."""
        day = (run[6] // DAY + 1) * DAY
        return day if self.width is None else min(day, run[7] + self.width + 1)

    def close(self) -> None:
        pass


def _runs(rows: DataFrame, late: str, width: int | None) -> DataFrame:
    # Lists and timers of state need this store.
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    watched = rows.withWatermark("ts", late).withColumn("at", F.unix_millis("ts")).withColumn("day", F.floor(F.col("at") / DAY))
    return watched.groupBy("symbol", "day").transformWithStateInPandas(Runs(width), f"symbol string, day long, {OPEN}", "Append", "EventTime")


def fill_runs(fills: DataFrame, late: str = "1 hour") -> DataFrame:
    """Maximal same-signed runs of fills (symbol, ts, seq, sign, size) per symbol and day.

    A run is given out once the watermark has passed the fill that ends it, or its
    day; fills that come later than ``late`` are dropped.
    """
    size = F.col("size").cast("double")
    rows = fills.select("symbol", "ts", F.col("seq").cast("long").alias("seq"), F.col("sign").cast("int").alias("sign"), size.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"))
    return _runs(rows, late, None).select("symbol", "sign", F.col("a").alias("shares"), F.col("n").alias("n_fills"), "first_seq", "last_seq")


def bin_runs(bins: DataFrame, seconds: int = 30, dominance: float = 0.3, late: str = "1 hour") -> DataFrame:
    """Maximal runs of directional bins of one sign (symbol, ts of the bin's start, signed, volume, mid_first, mid_last).

    A bin that is missing, or that has no direction, ends a run, as does its day.
    """
    share = X.ratio(F.abs("signed"), F.col("volume"))
    sign = F.when((share >= dominance) & (F.col("signed") != 0), F.signum("signed")).otherwise(0).cast("int")
    rows = bins.select("symbol", "ts", F.unix_millis("ts").alias("seq"), sign.alias("sign"), F.col("signed").cast("double").alias("a"), F.col("volume").cast("double").alias("b"), F.col("mid_first").cast("double").alias("first"), F.col("mid_last").cast("double").alias("last"))
    out = _runs(rows, late, seconds * 1000)
    return out.select("symbol", "sign", F.col("a").alias("net"), F.col("b").alias("gross"), F.col("n").alias("n_bins"), F.timestamp_millis("first_at").alias("bin_start"), F.col("first").alias("mid_start"), F.col("last").alias("mid_end"))
