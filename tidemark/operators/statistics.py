"""Information coefficients, HAC t-statistics, overfitting and regime diagnostics, keyed so that many runs are one job."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import average_rank


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where either is constant."""
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def rank_ic(df: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Spearman correlation of a and b by key, over rows where both are known."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.withColumns({"_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    return x.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, correlation("_ra", "_rb")).alias("ic"), F.count(F.lit(1)).alias("n"))


def linear_ic(df: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Pearson correlation of a and b by key, over rows where both are known."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return x.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, correlation(a, b)).alias("ic"), F.count(F.lit(1)).alias("n"))


def hac_ic(df: DataFrame, key: str, order: str, a: str, b: str, lags: int) -> DataFrame:
    """(key, ic, n, t_stat): rank correlation as the mean of products of standardised ranks, with the HAC t of that mean over `order`."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_ra": average_rank(a, [key]), "_rb": average_rank(b, [key])})
    own = Window.partitionBy(key)
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(own), F.stddev_pop(c).over(own))
    out = newey_west(x.select(key, order, (z("_ra") * z("_rb")).alias("_p")), key, order, "_p", lags)
    return out.select(key, F.col("mean").alias("ic"), "n", "t_stat")


def newey_west(df: DataFrame, key: str, order: str, x: str, lags: int) -> DataFrame:
    """(key, mean, t): t of the mean with Bartlett weights; lagged pairs meet by row number, not by a theta join."""
    w = Window.partitionBy(key).orderBy(order)
    e = df.where(F.col(x).isNotNull()).select(key, F.col(x).alias("x"), F.row_number().over(w).alias("i"), F.avg(x).over(Window.partitionBy(key)).alias("m")).withColumn("e", F.col("x") - F.col("m"))
    g0 = e.groupBy(key).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"))
    ahead = e.select(key, (F.explode(F.sequence(F.lit(1), F.lit(lags)))).alias("l"), "i", F.col("e").alias("f")).withColumn("i", F.col("i") + F.col("l"))
    cross = ahead.join(e.select(key, "i", "e"), [key, "i"]).groupBy(key).agg(F.sum((1 - F.col("l") / (lags + 1)) * F.col("e") * F.col("f")).alias("gl"))
    var = F.greatest((F.col("g0") + 2 * F.coalesce("gl", F.lit(0.0))) / F.col("n"), F.lit(1e-18))
    return g0.join(cross, key, "left").select(key, "mean", "n", (F.col("mean") / F.sqrt(var / F.col("n"))).alias("t_stat"))


def cross_sectional_ic(df: DataFrame, key: str, ts: str, a: str, b: str) -> DataFrame:
    """(key, mean_ic, t_stat, n_periods): rank correlation by time, then its t over times."""
    by_time = rank_ic(df, [key, ts], a, b, 2).where("ic is not null")
    return by_time.groupBy(key).agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_periods"), F.try_divide(F.avg("ic") * F.sqrt(F.count(F.lit(1))), F.stddev_samp("ic")).alias("t_stat"))


Measure = Callable[[Column, Column, Column], Column]


def sharpe_of_blocks(n: Column, s: Column, q: Column) -> Column:
    """Mean over population deviation, from the counts, sums and sums of squares of blocks."""
    mean = F.sum(s) / F.sum(n)
    return F.try_divide(mean, F.sqrt(F.greatest(F.sum(q) / F.sum(n) - mean * mean, F.lit(0.0))))


def overfit_probability(returns: DataFrame, blocks: int = 8, measure: Measure = sharpe_of_blocks) -> DataFrame:
    """One row (pbo, n_splits): share of half-half splits of time blocks whose in-sample best run ranks in the lower half out of sample.

    Runs and blocks are reduced to count, sum and sum of squares first; all splits then work on those few rows. `measure` is the
    user's: an aggregate of the columns (n, s, q) of a run's blocks in one half, null for blocks of the other half, as built-in
    functions or as a grouped pandas function that drops nulls. No value counts as 0.
    """
    spark = returns.sparkSession
    times = returns.select("ts").distinct().withColumn("block", F.ntile(blocks).over(Window.partitionBy(F.lit(0)).orderBy("ts")))
    parts = returns.join(times, "ts").groupBy("run_id", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    splits = spark.createDataFrame([(i, list(c)) for i, c in enumerate(combinations(range(1, blocks + 1), blocks // 2))], "split int, inside array<int>")
    cells = parts.crossJoin(F.broadcast(splits)).withColumn("is", F.array_contains("inside", F.col("block")))  # C(blocks, blocks / 2) rows
    half = lambda inside: [F.when(F.col("is") == inside, F.col(v)) for v in "nsq"]
    perf = cells.groupBy("split", "run_id").agg(measure(*half(True)).alias("inn"), measure(*half(False)).alias("out")).fillna(0.0, ["inn", "out"])
    by = Window.partitionBy("split")
    ranked = perf.withColumns({"best": F.row_number().over(by.orderBy(F.desc("inn"), "run_id")), "r": F.row_number().over(by.orderBy("out", "run_id")), "n": F.count(F.lit(1)).over(by)}).where("best = 1")
    w = F.col("r") / (F.col("n") + 1)
    return ranked.agg(F.avg((F.ln(w / (1 - w)) <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))


def pair_correlations(returns: DataFrame, period: str) -> DataFrame:
    """(period, a, b, corr, n) of each pair of symbols, rows meeting by equal times."""
    a = returns.select(period, "ts", F.col("symbol").alias("a"), F.col("ret").alias("ra"))
    b = returns.select(period, "ts", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    return a.join(b, [period, "ts"]).where("a < b").groupBy(period, "a", "b").agg(correlation("ra", "rb").alias("corr"), F.count(F.lit(1)).alias("n"))


def rolling_pairs(returns: DataFrame, rows: int) -> DataFrame:
    """(a, b, ts, corr, cov) of each pair of symbols over its last `rows` common times; null before there are as many."""
    a, b = (returns.where("ret is not null").select("ts", F.col("symbol").alias(n), F.col("ret").alias(f"r{n}")) for n in "ab")
    frame = Window.partitionBy("a", "b").orderBy("ts").rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(frame) == rows
    cov = F.covar_samp("ra", "rb").over(frame)
    both = F.nullif(F.stddev_samp("ra").over(frame) * F.stddev_samp("rb").over(frame), F.lit(0.0))
    return a.join(b, "ts").where("a < b").select("a", "b", "ts", F.when(full, F.try_divide(cov, both)).alias("corr"), F.when(full, cov).alias("cov"))


def bootstrap_sharpe(returns: DataFrame, boots: int = 1000, block: int = 20, bars: float = 2190, seed: int = 7) -> DataFrame:
    """(run_id, low, high): 95 % interval of the Sharpe ratio under block resampling; blocks come from prefix sums."""
    w = Window.partitionBy("run_id").orderBy("ts")
    x = returns.withColumns({"i": F.row_number().over(w), "s": F.sum("ret").over(w.rowsBetween(Window.unboundedPreceding, 0)), "q": F.sum(F.col("ret") * F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    n = returns.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(f"n >= {2 * block}")
    draw = n.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))))
    draw = draw.withColumn("i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "run_id", "boot", "k", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long"), F.col("n") - block + 1).cast("int"))
    ends = draw.withColumn("j", F.col("i") + block)
    pre = x.select("run_id", "i", "s", "q").union(n.select("run_id", F.lit(0), F.lit(0.0), F.lit(0.0)))
    got = ends.join(pre, ["run_id", "i"]).join(pre.select("run_id", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("q").alias("q2")), ["run_id", "j"])
    by = got.groupBy("run_id", "boot").agg(F.sum(F.col("s2") - F.col("s")).alias("s"), F.sum(F.col("q2") - F.col("q")).alias("q"), (F.count(F.lit(1)) * block).alias("m"))
    mean = F.col("s") / F.col("m")
    sharpe = F.try_divide(mean * F.sqrt(F.lit(float(bars))), F.sqrt(F.greatest(F.col("q") / F.col("m") - mean * mean, F.lit(0.0))))
    return by.withColumn("sharpe", sharpe).groupBy("run_id").agg(F.percentile("sharpe", F.lit(0.025)).alias("low"), F.percentile("sharpe", F.lit(0.975)).alias("high"))


def deflated_sharpe(returns: DataFrame, trials: int) -> DataFrame:
    """(run_id, dsr) from moments by run; the normal distribution function is applied to the small table of runs."""
    from statistics import NormalDist

    m = returns.groupBy("run_id").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    g = 0.5772156649015329
    normal = NormalDist()
    expected = (1 - g) * normal.inv_cdf(1 - 1 / max(trials, 2)) + g * normal.inv_cdf(1 - 1 / (max(trials, 2) * 2.718281828459045))
    sr = F.try_divide("m", "sd")
    sigma = F.sqrt(F.greatest((1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr) / (F.col("n") - 1), F.lit(1e-18)))

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if pd.isna(v) else NormalDist().cdf(v))

    return m.select("run_id", "n", sr.alias("sharpe"), phi((sr - expected * sigma) / sigma).alias("dsr"))
