"""The incremental study: a strategy built up one group of features at a time, all steps in one table and one P&L job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions import rolling as R
from ..operators import labels as L
from ..operators import models as ML
from ..operators import portfolio as P
from ..operators import statistics as N
from ..operators.bars import ewma
from ..sources import market as M
from ..sources.stage import staged
from .learning import KEYS, temporal
from .registry import query, r6
from .tables import CHAIN, FACTORS, MODALITIES, SENT, XS, data_set

SMOOTH = 2 / (6 + 1)
#: Fifty forests are fitted here, so each has a quarter of the trees of the other model queries.
TREES = 50


def deployed(alpha: DataFrame, name: str) -> DataFrame:
    """(symbol, decision_time, alpha) to neutral weights: conviction, smoothed, demeaned by time and scaled to gross 1."""
    c = alpha.select("symbol", F.col("decision_time").alias("ts"), risk.conviction(F.coalesce("alpha", F.lit(0.0)), deadband=0.05).alias("c"))
    return P.neutral(ewma(c, "symbol", "ts", {"w": ("c", SMOOTH)}), "w").select(F.lit(name).alias("run_id"), "ts", "symbol", "w")


@query("incremental_ladder")
def incremental_ladder(s, d):
    """A row a step: Sharpe and HAC t, turnover and cost a year, HAC t of the difference to the step before and to the baseline.

    Steps: trend baseline, market features, and in turn cross-sectional, chain, news, event and embedded features, then the
    fusion of single-group scores, its gate by the share of confident names, and its sum with the baseline at equal risk.
    """
    x = data_set(s, d)
    t = temporal(s, d).withColumns({f"e{i}": F.element_at("embedding", i) for i in (1, 2, 3, 4)}).select(*KEYS, "e1", "e2", "e3", "e4")
    x = staged(x.join(t, KEYS, "left").fillna(0.0, ["e1", "e2", "e3", "e4"]).withColumn("y", (F.col("label") + 1).cast("double")))
    f = staged(L.purged_folds(x.select(*KEYS, "t0", "t1"), ["symbol"]))
    score = lambda cols, y="y", kind="forest": staged(ML.out_of_fold(x, cols, y, f, KEYS, kind=kind, trees=TREES).select(*KEYS, "alpha"))
    market = [c for c in MODALITIES["market"] if c not in XS]
    groups = {"1_market": market, "1b_relative": XS, "2_chain": CHAIN, "3_news": SENT, "3b_event": list(FACTORS), "4_embedding": ["e1", "e2", "e3", "e4"]}
    books, own, cols = [], None, []
    for name, group in groups.items():
        cols = [*cols, *group]
        books.append(deployed(score(cols), name))
    for name, group in {"market": market, "relative": XS, "news": SENT, "event": list(FACTORS)}.items():
        one = score(group).withColumnRenamed("alpha", name)
        own = one if own is None else own.join(one, KEYS)
    y = x.select(*KEYS, "raw_long", "t0", "t1")
    fused = staged(ML.fusion(own.join(y, KEYS), f, KEYS, ["market", "relative", "news", "event"], "raw_long").select(*KEYS, "alpha"))
    books.append(deployed(fused, "5_fusion"))
    # whether the fused side pays, out of fold; the book is scaled by the share of names that likely do
    paying = x.join(fused.withColumnRenamed("alpha", "fused"), KEYS).withColumn("pays", (F.when(F.col("fused") > 0, F.col("net_long")).otherwise(F.col("net_short")) > 0).cast("double"))
    meta = ML.out_of_fold(paying, ["ret_24h", "vol_96h", "fused"], "pays", f, KEYS, kind="logistic").select(F.col("decision_time").alias("ts"), ((F.col("alpha") + 1) / 2).alias("p"))
    gross = ML.gross_scalar(meta, "p", 0.55)
    books.append(books[-1].join(gross, "ts", "left").select(F.lit("6_gate").alias("run_id"), "ts", "symbol", (F.col("w") * F.coalesce("scalar", F.lit(0.0))).alias("w")))
    bars = M.bars_4h(s, d).select("symbol", F.timestamp_seconds(F.unix_timestamp("ts") + 14460).alias("ts"), (F.col("close") + 1000).alias("close"))
    trend = P.momentum_weights(bars, lookback=24).select(F.lit("0_trend").alias("run_id"), "ts", "symbol", "w")
    weights = staged(reduce(DataFrame.unionByName, [trend, *books]).join(bars, ["symbol", "ts"]).select("run_id", "ts", "symbol", "close", "w"))
    p = P.pnl(weights).select("run_id", "ts", "turnover", "cost", "ret")
    both = P.sleeves(p.where("run_id = '0_trend'"), p.where("run_id = '5_fusion'")).select(F.lit("7_trend_and_fusion").alias("run_id"), "ts", F.lit(None).cast("double").alias("turnover"), F.lit(None).cast("double").alias("cost"), "ret")
    p = staged(p.unionByName(both))
    order = Window.partitionBy(F.lit(0)).orderBy("run_id")  # one row a step
    before = p.select("run_id").distinct().withColumn("last", F.lag("run_id").over(order))
    against = lambda other: p.join(before, "run_id").join(p.select(F.col("run_id").alias("other"), "ts", F.col("ret").alias("base")), "ts").where(other == F.col("other")).select("run_id", "ts", (F.col("ret") - F.col("base")).alias("ret"))
    out = P.metrics(p).select("run_id", "mean_sharpe").join(N.newey_west(p, "run_id", "ts", "ret", 30).select("run_id", "t_stat"), "run_id")
    out = out.join(p.groupBy("run_id").agg((F.avg("turnover") * 2190).alias("turnover_a_year"), (F.avg("cost") * 2190).alias("cost_a_year")), "run_id")
    out = out.join(N.newey_west(against(F.col("last")), "run_id", "ts", "ret", 30).select("run_id", F.col("t_stat").alias("t_marginal")), "run_id", "left")
    out = out.join(N.newey_west(against(F.lit("0_trend")).where("run_id <> '0_trend'"), "run_id", "ts", "ret", 30).select("run_id", F.col("t_stat").alias("t_vs_baseline")), "run_id", "left")
    return r6(out.withColumn("included", F.coalesce(F.col("t_marginal") > 2, F.lit(False))), "mean_sharpe", "t_stat", "turnover_a_year", "cost_a_year", "t_marginal", "t_vs_baseline")


def overfit_of(x: DataFrame, scores: dict[str, DataFrame], blocks: int = 8) -> DataFrame:
    """One row: overfitting over scored variants (name -> keys, alpha) that trade the sign of their score, and the spread of their edges in basis points."""
    runs = [a.join(x.select(*KEYS, "raw_long"), KEYS).groupBy(F.lit(n).alias("run_id"), F.col("decision_time").alias("ts")).agg(F.avg(F.signum("alpha") * F.col("raw_long")).alias("ret")) for n, a in scores.items()]
    r = staged(reduce(DataFrame.unionByName, runs).where("ret is not null"))
    edge = r.groupBy("run_id").agg((F.avg("ret") * 1e4).alias("edge")).agg((F.max("edge") - F.min("edge")).alias("edge_spread_bps"), F.count(F.lit(1)).alias("n_runs"))
    return r6(N.overfit_probability(r, blocks).crossJoin(F.broadcast(edge)), "pbo", "edge_spread_bps")  # one row each


@query("pbo_over_configurations")
def pbo_over_configurations(s, d):
    """Overfitting over twelve model settings of one feature set: probability, and the spread of their edges in basis points."""
    from .learning import SHORT, folds, supervised

    x = supervised(s, d)
    f = folds(x)
    settings = [(trees, depth, least) for trees in (20, 50) for depth in (2, 4, 6) for least in (1, 10)]
    return overfit_of(x, {f"{t}/{depth}/{least}": ML.out_of_fold(x, SHORT, "y", f, KEYS, trees=t, depth=depth, leaf=least) for t, depth, least in settings})


@query("pbo_over_feature_sets")
def pbo_over_feature_sets(s, d):
    """The same over four sets of features, each of one model."""
    from .learning import FEATURES, SHORT, folds, supervised

    x = supervised(s, d)
    f = folds(x)
    sets = {"all": FEATURES, "short": SHORT, "rest": [c for c in FEATURES if c not in SHORT], "returns": [c for c in FEATURES if c.startswith("ret_")]}
    return overfit_of(x, {n: ML.out_of_fold(x, cols, "y", f, KEYS, trees=TREES) for n, cols in sets.items()})
