"""Queries that run a stream to its end and return what it wrote; each equals a batch definition over the same ticks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..sources import market as M
from ..sources.stage import folder
from ..streaming import jobs
from . import base_sql as S
from .book import pnl
from .market import GRID_SQL, grid
from .registry import SQL, query
from .stack import SOFT

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """Stateful operators keep typed state in RocksDB; the session's own store is set again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spooled(df: DataFrame, path: str) -> DataFrame:
    """The rows as a file source for a stream, in the shared folder."""
    df.write.parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Runs an append stream into files until its input is used up, and reads those."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_bars", f"""WITH {S.TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)
SELECT * FROM b WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR""")
def stream_bars(s, d):
    """Bars that the watermark has passed; the newest ones are withheld."""
    path = folder(s, "bars")
    return drained(jobs.bar_stream(spooled(M.ticks(s, d), path)), path)


@query("stream_sliding_counts", f"""WITH {S.TICKS}, e AS (SELECT symbol, unnest(generate_series(time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR, time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 24 HOUR, INTERVAL 4 HOUR)) AS ts FROM ticks)
SELECT symbol, ts, count(*) AS n FROM e WHERE ts <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_sliding_counts(s, d):
    """Ticks of the last day at each step of four hours."""
    path = folder(s, "sliding")
    return drained(jobs.sliding_counts(spooled(M.ticks(s, d), path), "symbol", "1 day", "4 hours"), path)


@query("stream_once", "SELECT event_id AS seq FROM events")
def stream_once(s, d):
    """Every order id once, though each comes twice."""
    path = folder(s, "once")
    twice = M.ticks(s, d).select("ts", "seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return drained(jobs.once(spooled(twice, path), "seq", "ts"), path).select("seq")


@query("stream_positions", f"""WITH RECURSIVE {S.SIGNALS}, rn AS (SELECT symbol, ts, alpha AS s, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM signals),
h AS (SELECT symbol, ts, i, CASE WHEN s > 0.02 THEN 1 WHEN s < -0.02 THEN -1 ELSE 0 END AS p FROM rn WHERE i = 1 UNION ALL SELECT r.symbol, r.ts, r.i,
  CASE WHEN s IS NULL THEN 0 WHEN p = 0 THEN (CASE WHEN s > 0.02 THEN 1 WHEN s < -0.02 THEN -1 ELSE 0 END) WHEN p = 1 THEN (CASE WHEN s < 0.005 THEN 0 ELSE 1 END) ELSE (CASE WHEN s > -0.005 THEN 0 ELSE -1 END) END FROM h JOIN rn r ON r.symbol = h.symbol AND r.i = h.i + 1)
SELECT symbol, ts, p::INT AS position FROM h""")
def stream_positions(s, d):
    """The position automaton, its state kept by the stream."""
    path = folder(s, "positions")
    with state_store(s):
        return drained(jobs.hysteresis_stream(spooled(M.signals(s, d).select("symbol", "ts", F.col("alpha").alias("score")).coalesce(1), path), 0.02, 0.005), path)


@query("stream_band", SQL["no_trade_band"])
def stream_band(s, d):
    """The no-trade band, the weight last traded kept by the stream."""
    path = folder(s, "band")
    with state_store(s):
        return drained(jobs.band_stream(spooled(M.weights(s, d).select("run_id", "symbol", "ts", "w").coalesce(1), path), 0.3), path)


@query("stream_breaker", f"""WITH RECURSIVE {S.WEIGHTS}, {S.pnl_of('weights')}, {S.breaker_of('', SOFT)}, rn AS (SELECT run_id, ts, level, hour(ts) = 12 AS recovered, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM cb),
h AS (SELECT run_id, ts, i, level, level >= 3 AS halted, 0 AS was, 0 AS rest FROM rn WHERE i = 1
  UNION ALL SELECT r.run_id, r.ts, r.i, r.level, r.level >= 3 OR (halted AND NOT recovered), CASE WHEN r.level < 3 AND halted AND recovered THEN 5 WHEN r.level >= 3 OR halted THEN 0 ELSE rest END, CASE WHEN r.level < 3 AND halted AND recovered THEN 4 WHEN r.level >= 3 OR halted THEN 0 ELSE greatest(0, rest - 1) END FROM h JOIN rn r ON r.run_id = h.run_id AND r.i = h.i + 1)
SELECT run_id AS portfolio, ts, CASE WHEN halted THEN 0 WHEN level = 2 THEN 0.5 WHEN was > 0 THEN 0.5 ELSE 1 END::DOUBLE AS multiplier FROM h""")
def stream_breaker(s, d):
    """Levels of the running books; recovery is confirmed at noon and trades at half size for five bars."""
    path = folder(s, "breaker")
    levels = P.breaker(pnl(s, d).select("run_id", "ts", "ret")).select(F.col("run_id").alias("portfolio"), "ts", "level", (F.hour("ts") == 12).alias("recovered"))
    with state_store(s):
        return drained(jobs.breaker_stream(spooled(levels.coalesce(1), path)), path)


@query("stream_asof", f'WITH {GRID_SQL} SELECT grid.symbol, decision_time, funding_rate, f."timestamp" AS funding_time FROM grid ASOF LEFT JOIN funding f ON grid.symbol = f.symbol AND grid.decision_time >= f."timestamp"')
def stream_asof(s, d):
    """Decisions of a stream, each joined as of the slow funding table."""
    path = folder(s, "asof")
    stream = spooled(grid(s, d).select("symbol", "decision_time"), path)
    jobs.asof_stream(stream, M.funding(s, d), ["symbol"], "decision_time", "timestamp", ["funding_rate"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return s.read.parquet(f"{path}/out").select("symbol", "decision_time", "funding_rate", F.col("timestamp").alias("funding_time"))
