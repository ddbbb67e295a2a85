"""Scans, sinks and the streaming forms."""

import datetime as dt
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import bars, contracts, runs
from tidewright.sources import readers, sinks
from tidewright.streaming import live


def test_csv_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sec,mid,extra\n1,2.5,x\n2,bad,y\n")
    d = readers.csv(spark, str(tmp_path / "a.csv"), "sec long, mid double", columns=["mid", "sec"])
    assert d.columns == ["mid", "sec"] and [tuple(r) for r in d.orderBy("sec").collect()] == [(2.5, 1), (None, 2)]
    with pytest.raises(contracts.ContractError):
        readers.csv(spark, str(tmp_path / "a.csv"), "sec long", columns=["nope"])
    (tmp_path / "h.csv").write_text("34200.5,4,7,10,1000000,-1\n")
    assert readers.csv(spark, str(tmp_path / "h.csv"), "time double, event_type int, order_id long, size long, price long, direction int", header=False).first().direction == -1
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("sec,mid\n1,2\n")
    assert readers.csv(spark, str(tmp_path / "z.csv.gz"), "sec long, mid double").count() == 1
    with pytest.raises(FileNotFoundError, match="make it"):
        readers.need(spark, str(tmp_path / "none.csv"), "make it")


def test_tree_document_landed_and_union(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.csv").write_text(f"symbol,ts_event\nA,{k + 1}000000000\n")
    t = readers.tree(spark, str(tmp_path), "symbol string, ts_event long", nanos="ts_event")
    assert t.count() == 2 and t.select("source_file").distinct().count() == 2
    (tmp_path / "s.json").write_text('{"n": 3,\n "sha": "ab"}')
    assert readers.document(spark, str(tmp_path / "s.json"), "n long, sha string").first().n == 3
    spark.range(3).selectExpr("id", "cast(id as int) v", "1 extra").write.parquet(str(tmp_path / "p"))
    assert readers.landed(spark, str(tmp_path / "p"), "id long, v double").dtypes == [("id", "bigint"), ("v", "double")]
    assert readers.union([spark.range(1).toDF("id"), spark.range(1).withColumn("b", F.lit(1))]).columns == ["id", "b"]
    assert "ReadSchema: struct<id:bigint>" in readers.parquet(spark, str(tmp_path / "p"), ["id"])._jdf.queryExecution().executedPlan().toString()


def test_prints_adaptor_follows_daylight_saving(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.createDataFrame([("A", dt.datetime(2024, 1, 3, 14, 30), 10_500_000_000, 100, "B", 1), ("A", dt.datetime(2024, 7, 3, 13, 30), 1, 5, "N", 2)], "symbol string, ts timestamp, price long, size long, side string, sequence long")
    got = [(r.sec, r.sign) for r in readers.prints(raw).orderBy("sequence").collect()]
    assert got == [(34200, 1), (34200, 0)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 1.23456789, 2), ("a", None, 1)], "k string, v double, n int")
    text = sinks.report(d, str(tmp_path / "r.csv"), ["k"])
    assert text == "k,v,n\na,,1\nb,1.23456789,2\n" and (tmp_path / "r.csv").read_text() == text
    sinks.table(d, str(tmp_path / "t"), digits=3)
    sinks.table(d.limit(0), str(tmp_path / "t"))  # exists: left alone
    kept = spark.read.parquet(str(tmp_path / "t"))
    assert kept.filter("k = 'b'").first().v == 1.23
    m = sinks.manifest(spark, [str(tmp_path / "r.csv")]).first()
    assert (m.bytes, m.sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    sinks.check(d, d, ["k"])
    with pytest.raises(contracts.ContractError):
        sinks.check(d, d.withColumn("n", F.col("n") + 1), ["k"])


START = dt.datetime(2024, 1, 2, 10, 0)


def fills():
    signs = [1, 1, -1, -1, -1, 1, 1, -1]
    return [("A", START + dt.timedelta(seconds=20 * k), k, 10.0 + k, float(k + 1), s) for k, s in enumerate(signs)]


DDL = "symbol string, ts timestamp, seq long, price double, size double, sign int"


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame(fills(), DDL)
    late = [("A", START + dt.timedelta(hours=3), 99, 1.0, 1.0, 1)]
    rows.unionByName(spark.createDataFrame(late, DDL)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.bars(stream, "1 minute").writeStream.format("memory").queryName("live_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start, r.volume, r.signed_vol, r.mid) for r in spark.sql("select * from live_bars").collect())
    batch = bars.from_prints(rows.withColumn("dt", F.to_date("ts")).withColumn("sec", F.unix_timestamp("ts")), width=60)
    want = sorted((r.t, r.volume, r.signed_vol, r.mid) for r in batch.withColumn("t", F.timestamp_seconds("sec")).collect())
    assert got == want


def streamed(spark, tmp_path, parts, schema, make, name):
    """Rows of a stream whose triggers read ``parts`` one after another."""
    source = str(tmp_path / name)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-log")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def shuffled(rows, size, seed=5):
    """Rows in parts, out of order within some places."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + rng.uniform(0, 6))
    return [[rows[k] for k in order[at : at + size]] for at in range(0, len(rows), size)]


def test_streamed_runs_equal_batch_whatever_the_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [("AB"[k % 2], START + dt.timedelta(seconds=200 * k), k, 10.0, float(k % 5 + 1), rng.choice([1, 1, -1])) for k in range(400)]
    end = [(s, START + dt.timedelta(days=3), 900 + k, 1.0, 1.0, 1) for k, s in enumerate("AB")]
    got = sorted((r.symbol, r.first_seq, r.last_seq, r.sign, r.n_fills, r.shares) for r in streamed(spark, tmp_path, [*shuffled(rows, 40), end], DDL, live.fill_runs, "live_runs"))
    m = spark.createDataFrame(rows, DDL).selectExpr("symbol", "to_date(ts) dt", "seq", "cast(seq as double) time", "4 event_type", "cast(size as long) size", "-sign direction", "price mid")
    want = sorted((r.symbol, int(r.t_start), int(r.t_end), int(r.sign), r.n_fills, r.shares) for r in runs.fill_runs(m).collect())
    assert len({r[1].date() for r in rows}) == 2
    assert got == want and len(got) > 50


def test_streamed_bin_runs_equal_batch_and_close_at_a_missing_bin(spark, tmp_path):
    rng, schema = random.Random(2), "symbol string, ts timestamp, signed double, volume double, mid_first double, mid_last double"
    kept = [k for k in range(300) if rng.random() > 0.15]
    rows = [(s, START + dt.timedelta(seconds=1800 * k), rng.choice([5.0, 4.0, -4.0, 1.0]), 10.0, 100.0 + k, 101.0 + k) for k in kept for s in "AB"]
    end = [(s, START + dt.timedelta(days=30), 0.0, 1.0, 1.0, 1.0) for s in "AB"]
    got = streamed(spark, tmp_path, [*shuffled(rows, 50), end], schema, lambda x: live.bin_runs(x, 1800, late="6 hours"), "live_bins")
    b = spark.createDataFrame(rows, schema).selectExpr("symbol", "to_date(ts) dt", "hour(ts) * 3600 + minute(ts) * 60 bin", "signed", "volume", "mid_first", "mid_last", "case when abs(signed) / volume >= 0.3 then cast(sign(signed) as int) else 0 end direction")
    want = sorted((r.symbol, r.dt, r.bin_start, int(r.sign), r.net, r.gross, r.n_bins, r.mid_start, r.mid_end) for r in runs.bin_runs(b, ("symbol", "dt"), 1800).collect())
    assert sorted((r.symbol, r.bin_start.date(), r.bin_start.hour * 3600 + r.bin_start.minute * 60, r.sign, r.net, r.gross, r.n_bins, r.mid_start, r.mid_end) for r in got) == want
    # Without any further bin, the watermark of other symbols closes a run at its missing bin.
    first = [("A", START, 5.0, 10.0, 1.0, 2.0), ("B", START + dt.timedelta(hours=9), 0.0, 1.0, 1.0, 1.0)]
    alone = streamed(spark, tmp_path, [first], schema, lambda x: live.bin_runs(x, 1800, late="1 hour"), "live_alone")
    assert [(r.symbol, r.n_bins) for r in alone] == [("A", 1)]


def test_manifest_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "big.bin", "wb") as file:  # a sparse file
        file.truncate(size)
        file.seek(1 << 30)
        file.write(b"in the middle")
    (tmp_path / "small.bin").write_bytes(b"x")
    sha, left = hashlib.sha256(), size
    with open(tmp_path / "big.bin", "rb") as file:
        while part := file.read(1 << 24):
            sha.update(part)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in sinks.manifest(spark, [str(tmp_path / "*.bin")]).collect()}
    assert got == {"big.bin": (left, sha.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}
