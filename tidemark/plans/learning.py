"""Queries over fitted models and streams. SQL cannot express these; tests hold them against their definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof as J
from ..operators import labels as L
from ..operators import models as ML
from ..operators import portfolio as P
from ..operators import statistics as N
from ..sources.stage import staged
from ..sources import market as M
from . import base_sql as S
from .book import barriers
from .market import FEATURES, PIT_SQL, market_features, pit_table
from .registry import query, r6

KEYS = ["symbol", "decision_time"]
SHORT = ["ret_4h", "ret_24h", "vol_96h", "volume_z", "taker_z"]
TREES = 200
HORIZONS = {"fwd_1": 1, "fwd_3": 3, "fwd_6": 6, "fwd_18": 18}


def supervised(s, d):
    """Features, labels, fold roles: (keys, features, y, t0, t1)."""
    lab = barriers(s, d).select(*KEYS, (F.col("label") + 1).cast("double").alias("y"), F.col("entry_time").alias("t0"), F.col("exit_time").alias("t1"), "raw_long")
    return staged(market_features(s, d).select(*KEYS, *FEATURES).join(lab, KEYS))


def folds(x, k: int = 5):
    return staged(L.purged_folds(x.select(*KEYS, "t0", "t1"), ["symbol"], k))


@query("oof_alpha")
def oof_alpha(s, d):
    x = supervised(s, d)
    return r6(ML.out_of_fold(x, FEATURES, "y", folds(x), KEYS, trees=TREES), "alpha")


@query("stage2_meta")
def stage2_meta(s, d):
    """Probability that the traded side's net return is positive, out of fold."""
    x = supervised(s, d).withColumn("y", (F.col("raw_long") * F.signum("ret_24h") > 0.0016).cast("double")).where("ret_24h is not null and ret_24h <> 0")
    return r6(ML.out_of_fold(x, FEATURES, "y", folds(x), KEYS, kind="logistic"), "alpha").withColumnRenamed("alpha", "edge")


def weighted(s, d):
    """`supervised` with each row's pooled uniqueness as its weight."""
    x = supervised(s, d)
    return staged(L.pooled_uniqueness(x, "symbol", "t0", "t1").withColumnRenamed("uniqueness", "weight"))


@query("weighted_alpha")
def weighted_alpha(s, d):
    """Out-of-fold scores learnt with sample weights: overlapping labels and dense symbols count less."""
    x = weighted(s, d)
    return r6(ML.out_of_fold(x, FEATURES, "y", folds(x), KEYS, weight="weight", trees=TREES), "alpha")


@query("meta_diagnostics")
def meta_diagnostics(s, d):
    """Second stage, weighted, then calibrated out of fold: one row of rates and errors before and after."""
    x = weighted(s, d).withColumn("y", (F.col("raw_long") * F.signum("ret_24h") > 0.0016).cast("double")).where("ret_24h is not null and ret_24h <> 0")
    f = folds(x)
    p = ML.out_of_fold(x, FEATURES, "y", f, KEYS, kind="logistic", weight="weight").select(*KEYS, ((F.col("alpha") + 1) / 2).alias("p")).join(x.select(*KEYS, "y"), KEYS)
    return r6(ML.diagnostics(ML.calibrated_out_of_fold(staged(p), f, KEYS, "p", "y"), "y", "p", "calibrated"), "base_rate", "ece_raw", "ece_calibrated", "brier_raw", "brier_calibrated")


@query("batch_scores")
def batch_scores(s, d):
    """A model fitted on the labelled decisions, saved, loaded and applied to every decision of the feature table."""
    from ..sources.stage import folder

    path = folder(s, "bundle")
    ML.save_bundle(supervised(s, d), FEATURES, "y", path, trees=TREES)
    return r6(ML.bundle_scores(market_features(s, d).select(*KEYS, *FEATURES), path, KEYS), "alpha", "p_up")


@query("confident_share")
def confident_share(s, d):
    """Share of names of each time whose out-of-fold probability that the traded side pays is above the threshold."""
    meta = stage2_meta(s, d).select(F.col("decision_time").alias("ts"), ((F.col("edge") + 1) / 2).alias("p"))
    return r6(ML.gross_scalar(meta, "p", 0.55), "scalar")


@query("calibrated_probability")
def calibrated_probability(s, d):
    x = M.table(s, d, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") % 100) / 100).alias("p"))
    return r6(ML.calibrated(ML.calibrator(x, "p", "y"), x).select("doc_id", "calibrated"), "calibrated")


def temporal(s, d):
    """Out of fold: four components of the last 12 closes and a forecast for each horizon."""
    x = staged(L.windows(M.bars_4h(s, d), "close", 12, HORIZONS)).withColumns({"t0": F.col("ts"), "t1": F.timestamp_seconds(F.unix_timestamp("ts") + 18 * 14400), "decision_time": J.shifted(F.col("ts"), 14460)})
    f = staged(L.purged_folds(x.select("symbol", "decision_time", "t0", "t1"), ["symbol"]))
    return ML.temporal(x, f, KEYS, list(HORIZONS))


@query("temporal_forecast")
def temporal_forecast(s, d):
    """The sign of a component is arbitrary, so its absolute values are returned."""
    out = temporal(s, d).withColumns({f"e{i}": F.abs(F.element_at("embedding", i)) for i in (1, 2, 3, 4)}).drop("embedding")
    return r6(out, "e1", "e2", "e3", "e4", *(f"forecast_{h}" for h in HORIZONS))


@query("fusion_alpha")
def fusion_alpha(s, d):
    x = supervised(s, d)
    return r6(ML.fusion(x, folds(x), KEYS, ["ret_24h", "taker_z"], "raw_long"), "alpha")


@query("ablation_table")
def ablation_table(s, d):
    """Feature sets side by side, scored out of fold: information coefficient, and the HAC t, Sharpe ratio with its interval, and deflated Sharpe of trading the score's sign."""
    x = supervised(s, d)
    t = staged(temporal(s, d)).withColumns({f"e{i}": F.element_at("embedding", i) for i in (1, 2, 3, 4)}).drop("embedding")
    x = staged(x.join(t, KEYS))
    f = folds(x)
    parts, forecasts, embedding = None, [f"forecast_{h}" for h in HORIZONS], ["e1", "e2", "e3", "e4"]
    configs = {"tabular": FEATURES, "forecasts": forecasts, "embedding_and_tabular": [*FEATURES, *embedding], "all": [*FEATURES, *embedding, *forecasts]}
    for name, cols in configs.items():
        one = ML.out_of_fold(x, cols, "y", f, KEYS, trees=TREES).join(x.select(*KEYS, "raw_long"), KEYS).withColumns({"run_id": F.lit(name), "n_features": F.lit(len(cols))})
        parts = one if parts is None else parts.unionByName(one)
    parts = staged(parts.where("alpha is not null and raw_long is not null"))
    own = parts.select("run_id", F.struct("decision_time", "symbol").alias("ts"), (F.signum("alpha") * F.col("raw_long")).alias("ret"))
    out = N.rank_ic(parts, ["run_id", "n_features"], "alpha", "raw_long")
    for more in (N.newey_west(own, "run_id", "ts", "ret", 30).select("run_id", "t_stat"), P.metrics(own).select("run_id", "mean_sharpe"), N.bootstrap_sharpe(own, boots=500, block=30), N.deflated_sharpe(own, len(configs)).select("run_id", "dsr")):
        out = out.join(more, "run_id", "left")
    return r6(out, "ic", "t_stat", "mean_sharpe", "low", "high", "dsr")


@query("acceptance_gates", f"WITH {PIT_SQL} SELECT 'no_look_ahead' AS gate, count(*) FILTER (max_feature_available_time > decision_time)::DOUBLE AS value, count(*) FILTER (max_feature_available_time > decision_time) = 0 AS passed FROM pit2 UNION ALL SELECT 'enough_rows', count(*)::DOUBLE, count(*) >= 100 FROM pit2")
def acceptance_gates(s, d):
    from ..operators.cleaning import look_ahead_audit

    a = look_ahead_audit(pit_table(s, d), "decision_time", ["availability_ts", "funding_available_time", "oi_available_time"], KEYS)
    one = F.struct(F.lit("no_look_ahead").alias("gate"), F.col("n_look_ahead").cast("double").alias("value"), (F.col("n_look_ahead") == 0).alias("passed"))
    two = F.struct(F.lit("enough_rows").alias("gate"), F.col("n_rows").cast("double").alias("value"), (F.col("n_rows") >= 100).alias("passed"))
    return a.select(F.explode(F.array(one, two)).alias("g")).select("g.*")


@query("latest_signals", f"WITH {S.SIGNALS} SELECT symbol, ts, round(alpha, 6) AS alpha, CASE WHEN alpha > 0.05 THEN 'long' WHEN alpha < -0.05 THEN 'short' ELSE 'flat' END AS direction FROM signals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def latest_signals(s, d):
    x = M.signals(s, d).groupBy("symbol").agg(F.max_by(F.struct("ts", "alpha"), "ts").alias("x")).select("symbol", "x.ts", "x.alpha")
    return r6(x.withColumn("direction", F.when(F.col("alpha") > 0.05, "long").when(F.col("alpha") < -0.05, "short").otherwise("flat")), "alpha")


def _spool(s, d, name: str):
    """The ticks as a file source for a stream, in the shared folder."""
    from ..sources.stage import folder

    path = folder(s, name)
    M.ticks(s, d).repartition(4).write.parquet(f"{path}/in")
    return s.readStream.schema("symbol string, ts timestamp, price double, qty double, taker_buy_qty double, seq long").parquet(f"{path}/in"), path


@query("stream_latest_prices", """WITH t AS (SELECT event_type AS symbol, ts AS event_time, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1), n AS (SELECT max(ts) AS now FROM events)
SELECT symbol, event_time, price, CASE WHEN epoch(now) - epoch(event_time) > 10 THEN 'skip' WHEN epoch(now) - epoch(event_time) > 3 THEN 'stale_warning' ELSE 'normal' END AS tier FROM t, n""")
def stream_latest_prices(s, d):
    """All ticks through a stream; the snapshot that it leaves, aged at the newest tick."""
    from ..streaming import jobs

    source, path = _spool(s, d, "prices")
    name = f"prices_{uuid.uuid4().hex}"
    q = jobs.latest_prices(source).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    x = s.table(name)
    now = x.agg(F.max("event_time").alias("now"))  # one row
    age = F.unix_micros("now") / 1e6 - F.unix_micros("event_time") / 1e6
    from ..functions.risk import staleness

    return x.crossJoin(F.broadcast(now)).select("symbol", "event_time", "price", staleness(age).alias("tier"))


@query("stream_upsert", "SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, value AS price, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) = 1")
def stream_upsert(s, d):
    """Ticks upserted by (symbol, hour) from a stream, the newest kept."""
    from ..streaming import jobs

    source, path = _spool(s, d, "upsert")
    rows = source.select("symbol", F.date_trunc("hour", "ts").alias("hour"), "price", "seq")
    jobs.upsert_stream(rows, f"{path}/table", ["symbol", "hour"], ["seq"], f"{path}/checkpoint").awaitTermination()
    return jobs.current(s, f"{path}/table").select("symbol", "hour", "price", "seq")
