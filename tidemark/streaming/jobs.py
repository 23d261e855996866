"""Upserts, bars, snapshots, once-only ids, stateful risk rules and stream-static as-of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.risk import staleness
from ..operators.asof import asof
from ..operators.cleaning import upsert


def upsert_stream(source: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key in the Parquet table `target`, one version folder for each batch.

    A batch reads the newest version before it and writes the next, so a batch that is run again gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = current(spark, target, batch_id - 1)
        new = batch if old is None else upsert(old, batch, keys, order)
        out = new if old is not None else upsert(batch.limit(0), batch, keys, order)
        out.write.mode("overwrite").parquet(f"{target}/v={batch_id}")
        _forget(spark, target, batch_id - 2)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, target: str, version: int) -> None:
    """Removes a version that no batch can need again: the next one reads only the one before it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={version}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def current(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame | None:
    """Newest version of a table kept by `upsert_stream`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    versions = [v for v in versions if upto is None or v <= upto]
    return spark.read.parquet(f"{target}/v={max(versions)}") if versions else None


def bar_stream(ticks: DataFrame, every: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling bars in append mode: a bar comes out once the watermark has passed it, later ticks are dropped."""
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_counts(events: DataFrame, key: str, size: str = "7 days", step: str = "4 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.end").alias("ts"), "n")


def latest_prices(ticks: DataFrame) -> DataFrame:
    """Newest (event_time, price) of each symbol, for update or complete mode."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "seq")).alias("x")).select("symbol", F.col("x.ts").alias("event_time"), F.col("x.price").alias("price"))


def with_staleness(snapshot: DataFrame, now: str) -> DataFrame:
    """Adds age in seconds, tier and whether a symbol may be traded, as of `now`."""
    age = F.unix_micros(F.to_timestamp(F.lit(now))) / 1e6 - F.unix_micros("event_time") / 1e6
    return snapshot.withColumns({"age_s": age, "tier": staleness(age)}).withColumn("tradeable", F.col("tier") != "skip")


def once(orders: DataFrame, id_col: str, ts: str, within: str = "1 day") -> DataFrame:
    return orders.withWatermark(ts, within).dropDuplicatesWithinWatermark([id_col])


def asof_stream(decisions: DataFrame, factors: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of decisions is joined as of the slow factor table and appended to the Parquet table `out`."""

    def join(batch: DataFrame, batch_id: int) -> None:
        asof(batch, factors, keys, left_ts, right_ts, values).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return decisions.writeStream.foreachBatch(join).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HysteresisState(StatefulProcessor):
    """Position automaton of `operators.portfolio.hysteresis`, carried over batches by key."""

    def __init__(self, enter: float, leave: float):
        self.enter, self.leave = enter, leave

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "position int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = int(self.state.get()[0]) if self.state.exists() else 0
        for batch in [pd.concat(list(rows)).sort_values("ts")]:
            out = []
            for s in batch["score"]:
                if pd.isna(s):
                    p = 0
                elif p == 0:
                    p = 1 if s > self.enter else -1 if s < -self.enter else 0
                elif p == 1:
                    p = 0 if s < self.leave else 1
                else:
                    p = 0 if s > -self.leave else -1
                out.append(p)
            self.state.update((p,))
            yield pd.DataFrame({"symbol": batch["symbol"], "ts": batch["ts"], "position": out})

    def close(self) -> None:
        pass


def hysteresis_stream(scores: DataFrame, enter: float, leave: float) -> DataFrame:
    return scores.groupBy("symbol").transformWithStateInPandas(HysteresisState(enter, leave), "symbol string, ts timestamp, position int", "append", "none")


class BandState(StatefulProcessor):
    """The weight last traded, held until the target has moved by more than `band` from it; carried over batches by (run, symbol)."""

    def __init__(self, band: float):
        self.band = band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("traded", "w double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = float(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("ts")
        out = []
        for x in batch["w"].fillna(0.0):
            if last is None or abs(x - last) > self.band:
                last = float(x)
            out.append(last)
        self.state.update((last,))
        yield pd.DataFrame({"run_id": batch["run_id"], "symbol": batch["symbol"], "ts": batch["ts"], "w": out})

    def close(self) -> None:
        pass


def band_stream(weights: DataFrame, band: float) -> DataFrame:
    """`operators.portfolio.no_trade_band` of a stream of (run_id, symbol, ts, w), whose batches come in order of time."""
    return weights.groupBy("run_id", "symbol").transformWithStateInPandas(BandState(band), "run_id string, symbol string, ts timestamp, w double", "append", "none")


class BreakerState(StatefulProcessor):
    """Halts at level 3 until a confirmed recovery, then trades at half size for `periods` rows."""

    def __init__(self, periods: int = 5, reduced: float = 0.5):
        self.periods, self.reduced = periods, reduced

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "halted boolean, left int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        halted, left = self.state.get() if self.state.exists() else (False, 0)
        batch = pd.concat(list(rows)).sort_values("ts")
        out = []
        for level, recovered in zip(batch["level"], batch["recovered"]):
            if level >= 3:
                halted, left = True, 0
            elif halted and recovered:
                halted, left = False, self.periods
            multiplier = 0.0 if halted else 0.5 if level == 2 else self.reduced if left > 0 else 1.0
            left = max(0, left - 1) if not halted else 0
            out.append(multiplier)
        self.state.update((bool(halted), int(left)))
        yield pd.DataFrame({"portfolio": batch["portfolio"], "ts": batch["ts"], "multiplier": out})

    def close(self) -> None:
        pass


def breaker_stream(levels: DataFrame, periods: int = 5) -> DataFrame:
    """(portfolio, ts, multiplier) from (portfolio, ts, level, recovered)."""
    return levels.groupBy("portfolio").transformWithStateInPandas(BreakerState(periods), "portfolio string, ts timestamp, multiplier double", "append", "none")
