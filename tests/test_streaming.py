"""A stream over the same rows gives what the batch operator gives."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import portfolio as P
from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
TICK = "symbol string, ts timestamp, price double, qty double, seq long"


def spool(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collect(df, spark, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_upsert_keeps_newest(spark, tmp_path):
    s = spool(spark, tmp_path, [[("A", T0, 1.0, 1.0, 1)], [("A", T0, 2.0, 1.0, 2), ("B", T0, 3.0, 1.0, 3)]], TICK)
    jobs.upsert_stream(s, str(tmp_path / "t"), ["symbol"], ["seq"], str(tmp_path / "c")).awaitTermination()
    assert {r.symbol: r.price for r in jobs.current(spark, str(tmp_path / "t")).collect()} == {"A": 2.0, "B": 3.0}


def test_newest_bar_is_withheld(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(hours=h), float(h), 1.0, h) for h in (0, 1, 5, 9, 14)]
    bars = collect(jobs.bar_stream(spool(spark, tmp_path, [rows], TICK)), spark, tmp_path, "bars", "append")
    assert sorted((r.ts.hour, r.open, r.close) for r in bars) == [(0, 0.0, 1.0), (4, 5.0, 5.0), (8, 9.0, 9.0)]


def test_latest_and_once(spark, tmp_path):
    s = spool(spark, tmp_path, [[("A", T0, 1.0, 1.0, 1), ("A", T0, 5.0, 1.0, 1)], [("A", T0 + dt.timedelta(seconds=8), 2.0, 1.0, 2)]], TICK)
    got = collect(jobs.latest_prices(s), spark, tmp_path, "latest", "complete")
    assert got[0].price == 2.0
    assert len(collect(jobs.once(s, "seq", "ts"), spark, tmp_path, "once", "append")) == 2
    x = jobs.with_staleness(spark.table("latest"), "2024-01-01 00:00:13").first()
    assert (x.tier, x.tradeable) == ("stale_warning", True)


def test_hysteresis_stream_equals_batch(spark, tmp_path):
    scores = [0.0, 0.3, 0.2, 0.05, -0.4, None, -0.4, -0.15, 0.5]
    rows = [("A", T0 + dt.timedelta(hours=i), v) for i, v in enumerate(scores)]
    schema = "symbol string, ts timestamp, score double"
    want = [r.position for r in P.hysteresis(spark.createDataFrame(rows, schema), 0.25, 0.1, ["symbol"]).orderBy("ts").collect()]
    assert want == [0, 1, 1, 0, -1, 0, -1, -1, 0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = collect(jobs.hysteresis_stream(spool(spark, tmp_path, [rows[:4], rows[4:]], schema), 0.25, 0.1), spark, tmp_path, "hyst", "append")
    assert [r.position for r in sorted(got, key=lambda r: r.ts)] == want


def test_breaker_recovers_at_half_size(spark, tmp_path):
    rows = [("p", T0 + dt.timedelta(hours=i), lv, rec) for i, (lv, rec) in enumerate([(0, False), (3, False), (0, False), (0, True), (0, False), (0, False)])]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = collect(jobs.breaker_stream(spool(spark, tmp_path, [rows], "portfolio string, ts timestamp, level int, recovered boolean"), 2), spark, tmp_path, "brk", "append")
    assert [r.multiplier for r in sorted(got, key=lambda r: r.ts)] == [1.0, 0.0, 0.0, 0.5, 0.5, 1.0]


def test_asof_stream(spark, tmp_path):
    s = spool(spark, tmp_path, [[("A", T0 + dt.timedelta(hours=2), 1.0, 1.0, 1)]], TICK)
    f = spark.createDataFrame([("A", T0, 7.0)], "symbol string, at timestamp, v double")
    jobs.asof_stream(s, f, ["symbol"], "ts", "at", ["v"], str(tmp_path / "o"), str(tmp_path / "k")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).select(F.max("v")).first()[0] == 7.0
