"""Decision tables: construction, checks, and the risk stacks that turn them into books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from . import portfolio as P
from .bars import ewma


def action(before: Column, after: Column) -> Column:
    """What a decision does to a position that may not flip."""
    return (
        F.when((before == 0) & (after > 0), "open_long").when((before > 0) & (after > 0), "hold_long").when((before > 0) & (after == 0), "close_long")
        .when((before == 0) & (after < 0), "open_short").when((before < 0) & (after < 0), "hold_short").when((before < 0) & (after == 0), "close_short")
        .when((before == 0) & (after == 0), "flat").otherwise("unknown")
    )


def reference_decisions(scores: DataFrame, enter: float = 0.005, leave: float = 0.0, size: float = 0.25) -> DataFrame:
    """(symbol, decision_time, target_position, action, approved, audit_id) from (symbol, ts, score)."""
    pos = P.hysteresis(scores, enter, leave, ["symbol"]).withColumn("target_position", F.col("position") * size)
    before = F.coalesce(F.lag("target_position").over(Window.partitionBy("symbol").orderBy("ts")), F.lit(0.0))
    return pos.select("symbol", F.col("ts").alias("decision_time"), "target_position", action(before, F.col("target_position")).alias("action"), F.lit(True).alias("risk_approved"),
                      F.concat_ws("-", "symbol", F.date_format("ts", "yyyyMMddHH"), F.lit("v1")).alias("audit_id"))


def deployed(alpha: DataFrame, mode: str, closes: DataFrame | None = None, smooth: int = 6, deadband: float = 0.0, cap: float = 0.20, threshold: float = 0.55, most: float = 0.25, gross: float = 1.0, allow_flat: bool = False, band: float = 0.0) -> DataFrame:
    """(ts, symbol, w) of scores (symbol, ts, alpha; meta optional): conviction, its dead band and meta gate, smoothing, then one of three books.

    parity: inverse volatility and a target of the book's (`closes`: symbol, ts, close); simple: conviction times `most`; neutral: demeaned, scaled to
    `gross` (with `allow_flat` times the mean conviction of the time), smoothed again. `band` holds weights until they move by more.
    """
    if mode not in ("parity", "simple", "neutral"):
        raise ValueError(f"unknown mode: {mode}")
    c = risk.conviction(F.coalesce("alpha", F.lit(0.0)), cap)
    c = F.when(F.abs(F.coalesce("alpha", F.lit(0.0))) >= deadband, c).otherwise(0.0)
    if "meta" in alpha.columns:
        c = F.when(F.coalesce("meta", F.lit(0.0)) > threshold, c).otherwise(0.0)
    smoothed = lambda x, name: ewma(x, "symbol", "ts", {name: ("x", 2 / (smooth + 1))}) if smooth > 1 else x.withColumnRenamed("x", name)
    x = smoothed(alpha.select("symbol", "ts", c.alias("x")), "c")
    at = Window.partitionBy("ts")
    if mode == "simple":
        out = x.select("ts", "symbol", (F.col("c") * most).alias("w"))
    elif mode == "parity":
        out = P.signal_weights(closes, x.select("symbol", "ts", F.col("c").alias("signal")), gross=gross)
    else:
        full = risk.clip(F.avg(F.abs("c")).over(at), 0, 1) if allow_flat else F.lit(1.0)
        out = smoothed(P.neutral(x.withColumns({"full": full, "w": F.col("c")}), "w", gross).select("symbol", "ts", (F.col("w") * F.col("full")).alias("x")), "w").select("ts", "symbol", "w")
    if band > 0:
        out = P.no_trade_band(out.select(F.lit("one").alias("run_id"), "symbol", "ts", "w"), band).select("ts", "symbol", "w")
    return out.withColumn("w", F.col("w") - F.avg("w").over(at)) if mode == "neutral" else out


def audit_id(symbol: Column, ts: Column, model: str, data: str, code: str, config: dict) -> Column:
    """A name for a decision that changes with anything it was made of: symbol, time, versions of model, data and code, and the settings."""
    settings = ",".join(f"{k}={config[k]}" for k in sorted(config))
    return F.substring(F.sha2(F.concat_ws("|", symbol, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(model), F.lit(data), F.lit(code), F.lit(settings)), 256), 1, 16)


def gated_funnel(decided: DataFrame) -> DataFrame:
    """One row of counters of `risk.decided` rows: why decisions ended where they did, and at how many times anything is held."""
    why = lambda *names: F.count_if(F.col("reason").isin(*names))
    return decided.agg(
        F.count(F.lit(1)).alias("n_rows"), why("flat", "flat_or_no_meta").alias("flat_or_no_meta"), why("below_threshold").alias("meta_gated"), F.count_if(F.col("reason").startswith("blocked")).alias("zero_size"),
        F.count_if("approved").alias("approved_intents"), F.count_distinct("decision_time").alias("times"), F.count_distinct(F.when(F.col("approved"), F.col("decision_time"))).alias("times_held"),
    )


STANDARD = ("decision_time", "symbol", "agent_name", "action", "target_position", "signal_score", "confidence", "risk_approved", "reason", "audit_log", "created_at")


def validated(decisions: DataFrame) -> DataFrame:
    """The standard columns of a decision table in their types: unknown numbers are 0, confidence is within [0, 1]. A missing column raises."""
    if missing := [c for c in STANDARD if c not in decisions.columns]:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    kinds = {"decision_time": F.col("decision_time").try_cast("timestamp"), "created_at": F.col("created_at").try_cast("timestamp"), "target_position": number("target_position"), "signal_score": number("signal_score"),
             "confidence": risk.clip(number("confidence"), 0, 1), "risk_approved": F.coalesce(F.col("risk_approved").try_cast("boolean"), F.lit(False))}
    return decisions.select(*(kinds.get(c, F.col(c).cast("string")).alias(c) for c in STANDARD))


def loaded(decisions: DataFrame, approved_only: bool = True) -> DataFrame:
    """Decisions to be traded: only approved ones, if wanted, and only those with a key."""
    out = decisions.where("symbol is not null and decision_time is not null")
    return out.where("risk_approved") if approved_only else out


def approved(decisions: DataFrame) -> DataFrame:
    """Positions that count: null is 0, and what risk did not approve is 0 rather than gone, so that nothing is held on."""
    return decisions.withColumn("target_position", F.when(F.col("risk_approved"), F.coalesce("target_position", F.lit(0.0))).otherwise(0.0))


def violations(decisions: DataFrame) -> DataFrame:
    """(check, violations): position above 1, unknown action, missing key, repeated key."""
    known = ["open_long", "hold_long", "close_long", "open_short", "hold_short", "close_short", "flat"]
    one = decisions.agg(F.count_if(F.abs("target_position") > 1).alias("position"), F.count_if(~F.col("action").isin(known)).alias("action"), F.count_if(F.col("symbol").isNull() | F.col("decision_time").isNull()).alias("key"))
    twice = decisions.groupBy("symbol", "decision_time").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return one.unpivot([], one.columns, "check", "violations").union(twice.select(F.lit("repeated"), "n"))


def acceptance(audit: DataFrame, ece: DataFrame, ladder: DataFrame, ablation: DataFrame, pbo: DataFrame, baseline: str, plain: str, enriched: list[str]) -> DataFrame:
    """(gate, value, passed): no look-ahead, calibration error of 0.05 at most, a step with a significant increment, a gain by the enriched feature sets, overfitting under one half, better than the baseline.

    audit: n_look_ahead; ece: ece; ladder: run_id, mean_sharpe, included; ablation: run_id, t_stat; pbo: pbo. A value that is not known passes no gate.
    """
    steps = ladder.agg(
        F.count_if(F.col("included") & (F.col("run_id") != baseline)).cast("double").alias("steps"),
        (F.max(F.when(F.col("run_id") != baseline, F.col("mean_sharpe"))) - F.max(F.when(F.col("run_id") == baseline, F.col("mean_sharpe")))).alias("over"),
    )
    gain = ablation.agg((F.max(F.when(F.col("run_id").isin(enriched), F.col("t_stat"))) - F.max(F.when(F.col("run_id") == plain, F.col("t_stat")))).alias("gain"))
    one = audit.select(F.col("n_look_ahead").cast("double").alias("late")).crossJoin(ece.select("ece")).crossJoin(steps).crossJoin(gain).crossJoin(pbo.select("pbo"))  # one row each
    gates = [("no_look_ahead", "late", F.col("late") == 0), ("calibration", "ece", F.col("ece") <= 0.05), ("increment", "steps", F.col("steps") > 0), ("enriched_features", "gain", F.col("gain") > 0), ("overfitting", "pbo", F.col("pbo") < 0.5), ("beats_baseline", "over", F.col("over") > 0)]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(c).alias("value"), F.coalesce(p, F.lit(False)).alias("passed")) for n, c, p in gates))).alias("g")).select("g.*")


def directional(w: DataFrame, most: float = 0.25, net_cap: float = 1.5, gross_cap: float = 1.0, target_vol: float = 0.25, most_scale: float = 3.0, bars: float = 2190) -> DataFrame:
    """Limits for a book with net exposure, on (run_id, ts, symbol, close, w): per symbol, net (only its common part shrinks), gross, and one volatility scalar a run from its full sample (`uses_full_sample`)."""
    at = Window.partitionBy("run_id", "ts")
    x = w.withColumn("w", risk.clip(F.col("w"), -most, most)).withColumn("net", F.sum("w").over(at))
    x = x.withColumn("w", F.col("w") - F.greatest(F.abs("net") - net_cap, F.lit(0.0)) * F.signum("net") / F.count(F.lit(1)).over(at))
    x = x.withColumn("w", F.col("w") / F.greatest(F.lit(1.0), F.sum(F.abs("w")).over(at) / gross_cap)).drop("net")
    sd = P.pnl(x).groupBy("run_id").agg((F.stddev_samp("ret") * F.sqrt(F.lit(float(bars)))).alias("rv"))
    scale = F.when(F.col("rv") > 1e-9, F.least(target_vol / F.col("rv"), F.lit(most_scale))).otherwise(1.0)
    return x.join(F.broadcast(sd), "run_id").select("run_id", "ts", "symbol", "close", (F.col("w") * scale).alias("w"), F.lit(True).alias("uses_full_sample"))  # one row a run


def neutral_stack(conviction: DataFrame, clusters: DataFrame, most: float = 0.25, gross: float = 1.0, cluster_cap: float = 0.5) -> DataFrame:
    """(run_id, ts, symbol, w): demeaned, scaled to the gross, limited, demeaned, overlaid, and demeaned again, since limits break neutrality."""
    at = Window.partitionBy("run_id", "ts")
    demeaned = lambda x: x.withColumn("w", F.col("w") - F.avg("w").over(at))
    x = demeaned(conviction)
    x = x.withColumn("w", F.when(F.sum(F.abs("w")).over(at) > 1e-12, F.col("w") / F.sum(F.abs("w")).over(at) * gross).otherwise(0.0))
    x = demeaned(x.withColumn("w", risk.clip(F.col("w"), -most, most)))
    return demeaned(P.overlay(x, clusters, most, cluster_cap, gross)).select("run_id", "ts", "symbol", "w")


def breaker_returns(returns: DataFrame) -> DataFrame:
    """A return series under its own breaker: the multiplier of a bar governs the next one's return."""
    b = P.breaker(returns).select("run_id", "ts", F.coalesce(F.lag("multiplier").over(P.by_run()), F.lit(1.0)).alias("m"))
    return returns.join(b, ["run_id", "ts"]).select("run_id", "ts", (F.col("ret") * F.col("m")).alias("ret"))


def funnel(decisions: DataFrame) -> DataFrame:
    """One row of counters: rows, with a position, approved, times with any position."""
    return decisions.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("target_position") != 0).alias("n_with_position"), F.count_if("risk_approved").alias("n_approved"), F.count_distinct(F.when(F.col("target_position") != 0, F.col("decision_time"))).alias("n_times"))


def regime_by_year(returns: DataFrame) -> DataFrame:
    """(year, avg_pair_corr, xs_dispersion, pc1_share, n_symbols): the eigenvalue is taken on each year's small correlation matrix."""
    import numpy as np
    import pandas as pd

    from .statistics import pair_correlations

    x = returns.withColumn("year", F.year("ts"))
    spread = x.groupBy("year", "ts").agg(F.stddev_samp("ret").alias("sd")).groupBy("year").agg(F.avg("sd").alias("xs_dispersion"))

    def first_share(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        m = np.eye(len(names))
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["corr"].fillna(0.0)):
            i, j = names.index(a), names.index(b)
            m[i, j] = m[j, i] = c
        e = np.linalg.eigvalsh(m)
        return pd.DataFrame({"year": [key[0]], "avg_pair_corr": [float(pdf["corr"].mean())], "pc1_share": [float(e[-1] / e.sum())], "n_symbols": [len(names)]})

    pairs = pair_correlations(x, "year").groupBy("year").applyInPandas(first_share, "year int, avg_pair_corr double, pc1_share double, n_symbols int")
    return pairs.join(spread, "year")
