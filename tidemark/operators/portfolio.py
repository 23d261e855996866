"""Weights to P&L, trades, metrics and risk overlays. Every table carries `run_id`, so many strategies are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.rolling import series, trailing


def by_run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("ts")


def so_far() -> WindowSpec:
    return by_run().rowsBetween(Window.unboundedPreceding, 0)


def unknown() -> Column:
    return F.lit(None).cast("double")


def normalised(w: DataFrame) -> DataFrame:
    """Rows whose gross weight is above 1 are scaled to 1."""
    gross = F.sum(F.abs("w")).over(Window.partitionBy("run_id", "ts"))
    return w.withColumn("w", F.coalesce(F.col("w") / F.greatest(F.lit(1.0), gross), F.lit(0.0)))


def held(w: DataFrame, lag: int = 1) -> DataFrame:
    """Adds actual (lagged) weight, the one before, asset return and bar number to (run_id, ts, symbol, close, w)."""
    by = series(["run_id", "symbol"], "ts")
    return normalised(w).withColumns({
        "actual": F.coalesce(F.lag("w", lag).over(by), F.lit(0.0)), "before": F.coalesce(F.lag("w", lag + 1).over(by), F.lit(0.0)),
        "asset_return": F.coalesce(F.try_divide("close", F.lag("close").over(by)) - 1, F.lit(0.0)), "n": F.row_number().over(by),
    })


def pnl(w: DataFrame, lag: int = 1, fee: float = 0.0015, slippage: float = 0.0, cash: float = 1e6) -> DataFrame:
    """(run_id, ts, turnover, cost, ret, nav): lagged weights times returns less turnover costs, compounded."""
    by_ts = held(w, lag).groupBy("run_id", "ts").agg(F.sum(F.col("actual") * F.col("asset_return")).alias("gross"), F.sum(F.abs(F.col("actual") - F.col("before"))).alias("turnover"))
    out = by_ts.withColumn("cost", F.col("turnover") * (fee + slippage)).withColumn("ret", F.col("gross") - F.col("cost"))
    return out.select("run_id", "ts", "turnover", "cost", "ret", (cash * F.product(1 + F.col("ret")).over(so_far())).alias("nav"))


def trades(w: DataFrame, lag: int = 1, fee: float = 0.0015, cash: float = 1e6) -> DataFrame:
    """A row for each change of actual weight, valued at the portfolio before it."""
    p = pnl(w, lag, fee, 0.0, cash).select("run_id", "ts", F.coalesce(F.lag("nav").over(by_run()), F.lit(cash)).alias("value_before"), F.lag("ts", lag).over(by_run()).alias("signal_ts"))
    moved = held(w, lag).withColumn("delta", F.col("actual") - F.col("before")).where(F.abs("delta") > 1e-12).join(p, ["run_id", "ts"])
    amount = F.col("delta") * F.col("value_before")
    return moved.where("close > 0").select(
        "run_id", "ts", "signal_ts", "symbol", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), risk.trade_type(F.col("before"), F.col("actual")).alias("trade_type"),
        F.col("close").alias("execution_price"), F.col("before").alias("pre_weight"), F.col("actual").alias("post_weight"), amount.alias("trade_amount"), (amount / F.col("close")).alias("quantity"), (F.abs(amount) * fee).alias("fee"),
    )


def positions(w: DataFrame, lag: int = 1) -> DataFrame:
    p = pnl(w, lag).select("run_id", "ts", "nav")
    return held(w, lag).where("actual <> 0").join(p, ["run_id", "ts"]).select(
        "run_id", "ts", "symbol", F.col("actual").alias("weight"), (F.col("actual") * F.col("nav")).alias("market_value"), (F.col("actual") * F.col("nav") / F.col("close")).alias("quantity"), (F.col("actual") * F.col("asset_return")).alias("contribution"))


def annual(total: Column, n: Column, bars: float) -> Column:
    return F.pow(total, F.lit(bars) / n) - 1


def metrics(returns: DataFrame, bars: float = 2190) -> DataFrame:
    """Return, risk and win statistics by run from (run_id, ts, ret). The total return leaves out the first bar."""
    first = F.min_by("ret", "ts")
    agg = returns.groupBy("run_id").agg(
        F.product(1 + F.col("ret")).alias("growth"), first.alias("first"), F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.count_if(F.col("ret") > 0).alias("profit_count"), F.count_if(F.col("ret") < 0).alias("loss_count"),
        F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("avg_profit"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("avg_loss"),
    )
    root = F.sqrt(F.lit(float(bars)))
    year = annual(F.col("growth"), F.col("n"), bars)
    return agg.select(
        "run_id", F.col("n").alias("n_bars"), (F.col("growth") / (1 + F.col("first")) - 1).alias("total_return"), year.alias("annual_return"), (F.col("sd") * root).alias("volatility"),
        F.try_divide(year, F.col("sd") * root).alias("sharpe"), F.try_divide(F.col("mean") * root, F.col("sd")).alias("mean_sharpe"), F.try_divide(year, F.col("down") * root).alias("sortino"),
        F.try_divide(F.col("profit_count").cast("double"), (F.col("profit_count") + F.col("loss_count")).cast("double")).alias("win_rate"), "profit_count", "loss_count", F.try_divide("avg_profit", F.abs("avg_loss")).alias("profit_loss_ratio"),
    )


def max_drawdown(navs: DataFrame) -> DataFrame:
    """Depth, peak, trough and recovery by run from (run_id, ts, nav). Ties go to the earliest time."""
    x = navs.withColumn("top", F.max("nav").over(so_far())).withColumn("dd", F.col("nav") / F.col("top") - 1)
    trough = x.groupBy("run_id").agg(F.min(F.struct("dd", "ts", "top")).alias("t"), F.max("ts").alias("end"))
    both = x.join(trough, "run_id")
    at = both.groupBy("run_id", F.col("t.dd").alias("max_drawdown"), F.col("t.ts").alias("trough"), "end").agg(
        F.min(F.when((F.col("nav") == F.col("t.top")) & (F.col("ts") <= F.col("t.ts")), F.col("ts"))).alias("peak"), F.min(F.when((F.col("ts") >= F.col("t.ts")) & (F.col("nav") >= F.col("t.top")), F.col("ts"))).alias("recovery"))
    days = F.floor((F.unix_timestamp(F.coalesce("recovery", "end")) - F.unix_timestamp("peak")) / 86400)
    return at.select("run_id", "max_drawdown", "peak", "trough", "recovery", days.alias("days"))


def against_benchmark(returns: DataFrame, benchmark: DataFrame, bars: float = 2190) -> DataFrame:
    """Alpha, beta, tracking error and excess statistics; benchmark has (ts, bench)."""
    x = returns.join(benchmark, "ts").withColumn("excess", F.col("ret") - F.col("bench"))
    a = x.groupBy("run_id").agg(
        F.try_divide(F.covar_samp("ret", "bench"), F.var_samp("bench")).alias("beta"), annual(F.product(1 + F.col("ret")), F.count("ret"), bars).alias("own"), annual(F.product(1 + F.col("bench")), F.count("ret"), bars).alias("theirs"),
        F.avg("excess").alias("excess_mean"), (F.stddev_samp("excess") * F.sqrt(F.lit(float(bars)))).alias("tracking_error"), F.avg((F.col("ret") > F.col("bench")).cast("double")).alias("excess_win_rate"))
    return a.select("run_id", "beta", (F.col("own") - F.col("beta") * F.col("theirs")).alias("alpha"), "excess_mean", "tracking_error", F.try_divide(F.col("excess_mean") * bars, F.col("tracking_error")).alias("information_ratio"), "excess_win_rate")


def monthly(navs: DataFrame) -> DataFrame:
    """(run_id, year, month, ret) from month-end values; the first month has none."""
    ends = navs.groupBy("run_id", F.date_trunc("month", "ts").alias("m")).agg(F.max_by("nav", "ts").alias("nav"))
    out = ends.withColumn("ret", F.try_divide("nav", F.lag("nav").over(Window.partitionBy("run_id").orderBy("m"))) - 1)
    return out.select("run_id", F.year("m").alias("year"), F.month("m").alias("month"), "ret")


def yearly_sharpe(returns: DataFrame, bars: float = 2190) -> DataFrame:
    g = returns.groupBy("run_id", F.year("ts").alias("year")).agg(F.try_divide(F.avg("ret") * F.sqrt(F.lit(float(bars))), F.stddev_samp("ret")).alias("sharpe"), F.count("ret").alias("n"))
    return g


def ex_ante_vol(w: DataFrame, returns: DataFrame, rows: int = 30, bars: float = 2190) -> DataFrame:
    """(run_id, ts, pv): annualised deviation of the weighted return series over the last `rows` complete bars.

    Equal to the root of w' S w without a matrix: weights of t meet returns of s in (t - rows, t] by equality of bar number.
    """
    lags = w.withColumn("_s", F.explode(F.sequence(F.col("bar") - (rows - 1), F.col("bar"))))
    cells = lags.join(returns.select("symbol", F.col("bar").alias("_s"), "ret"), ["symbol", "_s"])
    days = cells.groupBy("run_id", "ts", "_s").agg(F.sum(F.col("w") * F.col("ret")).alias("x"), F.count_if(F.col("ret").isNull()).alias("holes")).where("holes = 0")
    return days.groupBy("run_id", "ts").agg((F.sqrt(F.var_samp("x") * bars)).alias("pv"), F.count(F.lit(1)).alias("n_bars"))


def parity_weights(x: DataFrame, vol_rows: int = 30, target: float = 0.30, most_scale: float = 3.0, gross: float = 1.0, bars: float = 2190) -> DataFrame:
    """(ts, symbol, w) of (ts, symbol, close, dir): direction in [-1, 1] over volatility, scaled to a target volatility of the book, then capped. A null direction holds nothing."""
    by = series("symbol", "ts")
    x = x.withColumn("ret", F.try_divide("close", F.lag("close").over(by)) - 1)
    times = x.select("ts").distinct().withColumn("bar", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")))  # one row a time
    x = x.join(times, "ts")
    frame = trailing(by, vol_rows)
    x = x.withColumn("vol", F.when(F.count("ret").over(frame) >= vol_rows, F.stddev_samp("ret").over(frame)))
    at = Window.partitionBy("ts")
    inv = F.when((F.col("vol") > 1e-12) & F.col("dir").isNotNull(), 1 / F.col("vol"))
    raw = x.withColumn("inv", inv).withColumn("w", F.coalesce(F.col("dir") * F.col("inv") / F.sum("inv").over(at), F.lit(0.0))).withColumn("run_id", F.lit("parity"))
    pv = ex_ante_vol(raw.where("w <> 0").select("run_id", "ts", "bar", "symbol", "w"), x.select("symbol", "ts", "bar", "ret"), vol_rows, bars)
    out = raw.join(pv, ["run_id", "ts"], "left").withColumn("scale", F.when(F.col("pv") > 1e-12, F.least(F.lit(target) / F.col("pv"), F.lit(most_scale))).otherwise(0.0))
    out = out.withColumn("w", F.col("w") * F.col("scale")).withColumn("gross", F.sum(F.abs("w")).over(at))
    return out.select("ts", "symbol", (F.col("w") / F.greatest(F.lit(1.0), F.col("gross") / gross)).alias("w"))


def momentum_weights(bars_: DataFrame, lookback: int = 90, vol_rows: int = 30, band: float = 0.0, **limits) -> DataFrame:
    """`parity_weights` of the sign of the trailing return, 0 within `band` of it."""
    moved = F.try_divide("close", F.lag("close", lookback).over(series("symbol", "ts"))) - 1
    return parity_weights(bars_.select("ts", "symbol", "close", direction(moved, band).alias("dir")), vol_rows, **limits)


def direction(moved: Column, band: float = 0.0) -> Column:
    return F.signum(moved) if band <= 0 else F.when(moved > band, 1.0).when(moved < -band, -1.0).otherwise(0.0)


def multiscale_weights(bars_: DataFrame, lookbacks: tuple[int, ...] = (180, 540, 1080), vol_rows: int = 30, band: float = 0.0, **limits) -> DataFrame:
    """`parity_weights` of the mean sign over several lookbacks; one whose history is too short counts as 0."""
    if not lookbacks or min(lookbacks) < 1:
        raise ValueError("lookbacks have to be positive")
    by = series("symbol", "ts")
    signs = (F.coalesce(direction(F.try_divide("close", F.lag("close", n).over(by)) - 1, band), F.lit(0.0)) for n in lookbacks)
    return parity_weights(bars_.select("ts", "symbol", "close", (sum(signs, F.lit(0.0)) / len(lookbacks)).alias("dir")), vol_rows, **limits)


def signal_weights(bars_: DataFrame, signal: DataFrame, vol_rows: int = 30, **limits) -> DataFrame:
    """`parity_weights` of any signal (symbol, ts, signal), clipped to [-1, 1]; bars without one hold nothing."""
    x = bars_.select("symbol", "ts", "close").join(signal.select("symbol", "ts", risk.clip(F.col("signal"), -1, 1).alias("dir")), ["symbol", "ts"], "left")
    return parity_weights(x.select("ts", "symbol", "close", F.coalesce("dir", F.lit(0.0)).alias("dir")), vol_rows, **limits)


def neutral(df: DataFrame, column: str, gross: float = 1.0) -> DataFrame:
    """Demeaned by time and divided by its gross: sums to 0, absolute values to `gross` (0 where all are equal)."""
    at = Window.partitionBy("ts")
    out = df.withColumn("_x", F.col(column) - F.avg(column).over(at)).withColumn("_g", F.sum(F.abs("_x")).over(at))
    return out.withColumn(column, F.when(F.col("_g") > 1e-12, F.col("_x") / F.col("_g") * gross).otherwise(0.0)).drop("_x", "_g")


def no_trade_band(w: DataFrame, band: float) -> DataFrame:
    """The weight last traded is held until the target has moved by more than `band` from it, by (run_id, symbol).

    The rule carries a real value from bar to bar, so a series is read in order, in batches, with the last weight carried
    from batch to batch: a task holds one batch, however long the series.
    """
    import pyarrow as pa

    def held_on(batches):
        series_, last = None, None
        for batch in batches:
            out = []
            for run, symbol, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                x = 0.0 if x is None else x
                if series_ != (run, symbol) or abs(x - last) > band:
                    series_, last = (run, symbol), x
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.float64())], batch.schema.names)

    rows = w.select(F.col("run_id").cast("string").alias("run_id"), F.col("symbol").cast("string").alias("symbol"), "ts", F.col("w").cast("double").alias("w"))
    return rows.repartition("run_id", "symbol").sortWithinPartitions("run_id", "symbol", "ts").mapInArrow(held_on, rows.schema)


#: States of a hysteresis position, in the order of a map's fields.
STATES = {"m0": 0, "m1": 1, "m2": -1}


def hysteresis(scores: DataFrame, enter: float, leave: float, keys: list[str], block: int = 64, depth: int = 2) -> DataFrame:
    """(keys, ts, position): 0 -> 1 at score > enter, back at score < leave; mirrored for -1; no direct flip; a null score resets.

    A three-state automaton: each row is a map of states to states, and maps compose. Blocks of `block` rows are composed
    to one map each, blocks of blocks likewise (`depth` times), and the states at their starts are handed down again.
    """
    s = F.col("score")

    def after(p: int) -> Column:
        rules = {0: F.when(s > enter, 1).when(s < -enter, -1).otherwise(0), 1: F.when(s < leave, 0).otherwise(1), -1: F.when(s > -leave, 0).otherwise(-1)}
        return F.when(s.isNull(), 0).otherwise(rules[p])

    rows = scores.select(*keys, "ts", "score", (F.row_number().over(series(keys, "ts")) - 1).cast("long").alias("_i"))
    maps = rows.select(*keys, "_i", *(after(p).alias(m) for m, p in STATES.items()))
    states = _states(maps, keys, block, depth)
    return rows.join(states, [*keys, "_i"]).select(*keys, "ts", F.col("_after").alias("position"))


def _applied(p: Column, x: Column) -> Column:
    return F.when(p == 0, x["m0"]).when(p == 1, x["m1"]).otherwise(x["m2"])


def _states(maps: DataFrame, keys: list[str], block: int, depth: int) -> DataFrame:
    """(keys, _i, _before, _after): the states before and after each of the maps numbered `_i`, from state 0 on."""
    at = F.floor(F.col("_i") / block) if depth else F.lit(0).cast("long")
    blocks = maps.groupBy(*keys, at.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", *STATES))).alias("_r"))
    if depth:
        ends = blocks.select(*keys, F.col("_b").alias("_i"), *(F.aggregate("_r", F.lit(p), _applied).alias(m) for m, p in STATES.items()))
        begin = _states(ends, keys, block, depth - 1).select(*keys, F.col("_i").alias("_b"), F.col("_before").alias("_p"))
        blocks = blocks.join(begin, [*keys, "_b"])
    else:
        blocks = blocks.withColumn("_p", F.lit(0))
    path = F.aggregate("_r", F.array("_p"), lambda acc, x: F.concat(acc, F.array(_applied(F.element_at(acc, -1), x))))
    both = F.zip_with("_r", F.arrays_zip(F.slice("_p", F.lit(1), F.size("_r")).alias("a"), F.slice("_p", F.lit(2), F.size("_r")).alias("b")), lambda x, y: F.struct(x["_i"].alias("_i"), y["a"].alias("_before"), y["b"].alias("_after")))
    return blocks.withColumn("_p", path).select(*keys, F.explode(both).alias("x")).select(*keys, "x.*")


def overlay(w: DataFrame, clusters: DataFrame, per_symbol: float = 0.25, cluster_cap: float = 0.50, gross: float = 1.0) -> DataFrame:
    """Cluster cap, gross cap and per-symbol limit, in this order, by run and time; clusters has (symbol, cluster)."""
    x = w.join(clusters, "symbol", "left").withColumn("cluster", F.coalesce("cluster", "symbol"))
    in_cluster = F.sum(F.abs("w")).over(Window.partitionBy("run_id", "ts", "cluster"))
    x = x.withColumn("w", F.col("w") / F.greatest(F.lit(1.0), in_cluster / cluster_cap))
    x = x.withColumn("w", F.col("w") / F.greatest(F.lit(1.0), F.sum(F.abs("w")).over(Window.partitionBy("run_id", "ts")) / gross))
    return x.withColumn("w", risk.clip(F.col("w"), -per_symbol, per_symbol))


def correlation_penalty(w: DataFrame, returns: DataFrame, rows: int = 90, floor: float = 0.30, penalty: float = 0.50) -> DataFrame:
    """(run_id, ts, symbol, penalty) of the active symbols with `rows` known returns: the more their returns go with the other active ones', the less is kept.

    Correlations roll over pairs of symbols that meet by time; a book then reads those of its own pairs by equality.
    """
    known = returns.where("ret is not null")
    full = F.count("ret").over(trailing(series("symbol", "ts"), rows)) == rows
    active = w.where(F.abs("w") > 1e-12).join(returns.select("symbol", "ts", full.alias("full")), ["symbol", "ts"]).where("full").select("run_id", "ts", "symbol")
    frame = trailing(series(["symbol", "other"], "ts"), rows)
    pairs = known.select("ts", "symbol", F.col("ret").alias("x")).join(known.select("ts", F.col("symbol").alias("other"), F.col("ret").alias("y")), "ts").where("symbol <> other")
    rolling = pairs.select("ts", "symbol", "other", F.when(F.count(F.lit(1)).over(frame) == rows, F.abs(F.try_divide(F.covar_samp("x", "y").over(frame), F.nullif(F.stddev_samp("x").over(frame) * F.stddev_samp("y").over(frame), F.lit(0.0))))).alias("c"))
    mean = active.join(active.withColumnRenamed("symbol", "other"), ["run_id", "ts"]).where("symbol <> other").join(rolling, ["ts", "symbol", "other"]).groupBy("run_id", "ts", "symbol").agg(F.avg("c").alias("c"))
    excess = F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0)) - floor)
    return mean.select("run_id", "ts", "symbol", (1 / (1 + penalty * excess / (1 - floor))).alias("penalty"))


def full_overlay(w: DataFrame, clusters: DataFrame, returns: DataFrame, drawdowns: DataFrame, rows: int = 90, per_symbol: float = 0.25, cluster_cap: float = 0.50, gross: float = 1.0, target_vol: float = 0.25, most_scale: float = 1.0, bars: float = 2190) -> DataFrame:
    """(run_id, ts, symbol, w): correlation penalty, cluster cap, gross cap, volatility target (only ever down), drawdown scaler and per-symbol limit.

    returns: (symbol, ts, ret); drawdowns: (run_id, ts, drawdown) as known at the time.
    """
    least = correlation_penalty(w, returns, rows)
    x = w.select("run_id", "ts", "symbol", "w").join(least, ["run_id", "ts", "symbol"], "left").withColumn("w", F.col("w") * F.coalesce("penalty", F.lit(1.0)))
    x = overlay(x, clusters, 1e9, cluster_cap, gross)
    times = returns.select("ts").distinct().withColumn("bar", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")))  # one row a time
    used = x.where("penalty is not null").join(times, "ts").select("run_id", "ts", "bar", "symbol", "w")
    pv = ex_ante_vol(used, returns.join(times, "ts").select("symbol", "bar", "ret"), rows, bars).select("run_id", "ts", "pv")
    scale = F.when(F.col("pv") > target_vol, F.least(F.lit(most_scale), F.lit(target_vol) / F.col("pv"))).otherwise(1.0)
    x = x.join(pv, ["run_id", "ts"], "left").join(drawdowns, ["run_id", "ts"], "left")
    down = risk.drawdown_scaler(F.coalesce("drawdown", F.lit(0.0)))
    return x.select("run_id", "ts", "symbol", risk.clip(F.col("w") * scale * down, -per_symbol, per_symbol).alias("w"))


def under_breaker(w: DataFrame, **options) -> DataFrame:
    """Two passes: the book's own P&L gives a multiplier for each bar, which scales the weights of that bar (held from the next one on)."""
    b = breaker(pnl(w).select("run_id", "ts", "ret"), **options).select("run_id", "ts", "multiplier")
    return w.join(b, ["run_id", "ts"], "left").withColumn("w", F.col("w") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")


def breaker(returns: DataFrame, peak_rows: int = 540, day_rows: int = 6, mean_days: int | None = 120) -> DataFrame:
    """(run_id, ts, drawdown, daily_loss, soft, level, multiplier) from trailing P&L up to each bar; without `mean_days` the soft loss is its least value."""
    x = returns.withColumn("nav", F.product(1 + F.col("ret")).over(so_far()))
    peak = F.max("nav").over(trailing(by_run(), peak_rows))
    frame = trailing(by_run(), day_rows)
    x = x.withColumns({"drawdown": 1 - F.col("nav") / peak, "daily": F.when(F.count("ret").over(frame) >= day_rows, F.product(1 + F.col("ret")).over(frame) - 1)})
    x = x.withColumns({"daily_loss": F.greatest(F.lit(0.0), -F.coalesce("daily", F.lit(0.0))), "typical": F.avg(F.abs("daily")).over(trailing(by_run(), mean_days)) if mean_days else unknown()})
    x = x.withColumn("soft", risk.soft_daily_loss(F.col("typical")))
    level = risk.breaker_level(F.col("drawdown"), F.col("daily_loss"), F.col("soft"))
    return x.withColumn("level", level).select("run_id", "ts", "drawdown", "daily_loss", "soft", "level", (risk.breaker_multiplier(level) * risk.drawdown_scaler(F.col("drawdown"))).alias("multiplier"))


def sleeves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ts, ret): sum of two return series at equal risk; each is divided by its full-sample deviation, then the sum is scaled to the mean of both."""
    sd = lambda x: x.agg(F.stddev_samp("ret").alias("sd"))  # noqa: E731  one row
    both = a.select("ts", F.col("ret").alias("ra")).join(b.select("ts", F.col("ret").alias("rb")), "ts", "full").fillna(0.0)
    s = sd(a).select(F.col("sd").alias("sa")).crossJoin(sd(b).select(F.col("sd").alias("sb")))
    mean = (F.col("sa") + F.col("sb")) / 2
    part = lambda r, d: F.coalesce(F.try_divide(F.col(r), F.col(d)), F.lit(0.0))
    return both.crossJoin(F.broadcast(s)).select("ts", (0.5 * mean * (part("ra", "sa") + part("rb", "sb"))).alias("ret"))
