"""Labels on a decision grid: barriers, meta-labels, uniqueness, folds, windows, calibration error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import roll, series, true_range
from .asof import asof, in_range, interval_sum, next_after, shifted

AMBIGUOUS = "dual_touch_ambiguous"


def touches(bars: DataFrame, grid: DataFrame, mult: float = 1.5, atr_rows: int = 20, vertical_s: int = 5 * 86400, neutral: float = 0.5) -> DataFrame:
    """What the path from the next bar's open meets first: (symbol, decision_time, entry_time, entry, width, up, down, exit_time, exit, label, reason)."""
    w = series("symbol", "ts")
    width = bars.withColumn("tr", true_range(w)).select("symbol", "availability_ts", F.try_divide(mult * roll(F.avg, "tr", w, atr_rows), F.col("close")).alias("width"))
    d = asof(grid.select("symbol", "decision_time"), width, ["symbol"], "decision_time", "availability_ts", ["width"]).where("width > 0").drop("availability_ts")
    d = next_after(d, bars.select("symbol", F.col("ts").alias("entry_time"), F.col("open").alias("entry")), ["symbol"], "decision_time", "entry_time", ["entry"]).where("entry > 0")
    d = d.withColumns({"until": shifted(F.col("entry_time"), vertical_s), "up": F.col("entry") * (1 + F.col("width")), "down": F.col("entry") * (1 - F.col("width"))})
    path = in_range(d, bars.select("symbol", "ts", "high", "low", "close"), ["symbol"], "entry_time", "until", "ts")
    out = path.groupBy("symbol", "decision_time", "entry_time", "entry", "width", "up", "down").agg(first_touch().alias("t"), F.max(F.struct("ts", "close")).alias("last"))
    ret = F.col("last.close") / F.col("entry") - 1
    both = F.col("t.u") & F.col("t.d")
    return out.select(
        "symbol", "decision_time", "entry_time", "entry", "width", "up", "down", F.coalesce("t.ts", "last.ts").alias("exit_time"),
        F.when(both, F.col("t.close")).when(F.col("t.u"), F.col("up")).when(F.col("t.d"), F.col("down")).otherwise(F.col("last.close")).alias("exit"),
        F.when(both, 0).when(F.col("t.u"), 1).when(F.col("t.d"), -1).when(ret > neutral * F.col("width"), 1).when(ret < -neutral * F.col("width"), -1).otherwise(0).alias("label"),
        F.when(both, AMBIGUOUS).when(F.col("t.u"), "upper_touch").when(F.col("t.d"), "lower_touch").when(F.abs(ret) > neutral * F.col("width"), "vertical_directional").otherwise("vertical_neutral").alias("reason"),
    )


def first_touch() -> Column:
    """The first bar (ts, u, d, close) of a group whose high reaches `up` or whose low reaches `down`."""
    hit_up, hit_down = F.col("high") >= F.col("up"), F.col("low") <= F.col("down")
    return F.min(F.when(hit_up | hit_down, F.struct("ts", hit_up.alias("u"), hit_down.alias("d"), "close")))


def refined(labels: DataFrame, finer: Callable[[DataFrame], DataFrame], bar_s: int = 3600) -> DataFrame:
    """Labels of `touches` whose ambiguous bars are settled by finer bars of just those bars' time.

    finer: from the ambiguous (symbol, bar) to finer bars (symbol, ts, high, low, close) of them; it should drop all others
    before it makes bars (a semi join of ticks). A finer bar that touches both, or none that touches, leaves the label as it is.
    """
    bar = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / bar_s) * bar_s)
    open_ = labels.where(F.col("reason") == AMBIGUOUS).select("symbol", "decision_time", "up", "down", F.col("exit_time").alias("bar"))
    fine = finer(open_.select("symbol", "bar").distinct()).withColumn("bar", bar("ts"))
    hit = open_.join(fine.select("symbol", "bar", "ts", "high", "low", "close"), ["symbol", "bar"]).groupBy("symbol", "decision_time").agg(first_touch().alias("f"))
    both = F.col("f.u") & F.col("f.d")
    new = F.col("f.ts").isNotNull() & ~both
    return labels.join(hit, ["symbol", "decision_time"], "left").withColumns({
        "exit": F.when(new & F.col("f.u"), F.col("up")).when(new, F.col("down")).otherwise(F.col("exit")),
        "label": F.when(new & F.col("f.u"), 1).when(new, -1).otherwise(F.col("label")),
        "reason": F.when(new & F.col("f.u"), "upper_touch").when(new, "lower_touch").otherwise(F.col("reason")),
        "exit_time": F.when(new, F.col("f.ts")).otherwise(F.col("exit_time")),
    }).drop("f")


def with_returns(labels: DataFrame, funding: DataFrame | None, cost: float = 16e-4) -> DataFrame:
    """Adds rates (funding paid while held), raw and net returns of both sides; `cost` is charged once for both legs."""
    if funding is not None:
        labels = interval_sum(labels, funding, ["symbol"], "entry_time", "exit_time", "timestamp", "funding_rate", "rates")
    else:
        labels = labels.withColumn("rates", F.lit(0.0))
    raw = F.col("exit") / F.col("entry") - 1
    return labels.withColumns({"raw_long": raw, "raw_short": -raw, "net_long": raw - F.col("rates") - cost, "net_short": -raw + F.col("rates") - cost})


def triple_barrier(bars: DataFrame, grid: DataFrame, funding: DataFrame | None = None, mult: float = 1.5, atr_rows: int = 20, vertical_s: int = 5 * 86400, neutral: float = 0.5, cost: float = 16e-4, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Label of each (symbol, decision_time): which of the two barriers the path from the next bar's open touches first.

    bars: symbol, ts, high, low, open, close and availability_ts (1 h). The barrier's width is the mean true range over the
    close of the newest bar *available* at the decision. A bar that touches both is ambiguous (0) and left at its close, unless `finer`
    bars settle it (`refined`). Without a touch the return at the vertical barrier decides, 0 within `neutral` widths.
    """
    out = touches(bars, grid, mult, atr_rows, vertical_s, neutral)
    if finer is not None:
        out = refined(out, finer)
    return with_returns(out, funding, cost).drop("up", "down")


def meta_label(df: DataFrame, direction: str) -> DataFrame:
    """1 where the chosen side's net return is positive; rows without a direction go."""
    own = F.when(F.col(direction) > 0, F.col("net_long")).otherwise(F.col("net_short"))
    return df.where(F.col(direction) != 0).withColumn("meta", (own > 0).cast("int"))


def running_sum(df: DataFrame, keys: list[str], at: str, value: Column, block: int) -> DataFrame:
    """Adds `_sum`, the sum of `value` up to and at each place `at`: within blocks of `block` places, plus that of all blocks before.

    A key's rows are never in one window, only its blocks (one row each) are.
    """
    x = df.withColumns({"_v": value, "_k": F.floor(F.col(at) / block)})
    totals = x.groupBy(*keys, "_k").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_k", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_k").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_in", F.sum("_v").over(inside)).join(base, [*keys, "_k"]).withColumn("_sum", F.col("_in") + F.col("_base")).drop("_v", "_k", "_in", "_base")


#: 1 / concurrency is kept as a whole number of these parts, so that sums of it are exact in any order.
PARTS = 10**12


def uniqueness(labels: DataFrame, key: str, start: str, end: str, step_s: int = 3600, block: int = 720) -> DataFrame:
    """Adds `uniqueness`: mean of 1 / concurrency over the steps in [start, end); an empty interval has 1.

    Starts and ends are +1 and -1 events, their prefix sum is the concurrency; intervals then read two prefix sums
    of 1 / concurrency by equality, so nothing is compared pairwise. Prefix sums are made in blocks of `block` steps.
    """
    at = lambda c: F.floor(F.unix_timestamp(c) / step_s)
    x = labels.withColumns({"_a": at(start), "_b": at(end)})
    span = x.groupBy(key).agg(F.min("_a").alias("lo"), F.max("_b").alias("hi"))
    steps = span.select(key, F.explode(F.sequence("lo", "hi")).alias("_i"))
    events = x.select(key, F.col("_a").alias("_i"), F.lit(1).alias("e")).union(x.select(key, F.col("_b"), F.lit(-1))).groupBy(key, "_i").agg(F.sum("e").alias("e"))
    running = running_sum(steps.join(events, [key, "_i"], "left"), [key], "_i", F.coalesce("e", F.lit(0)), block)
    part = F.expr(f"{PARTS} div greatest(1, _sum)")
    prefix = running_sum(running.select(key, "_i", part.alias("c")), [key], "_i", F.col("c"), block).select(key, "_i", (F.col("_sum") - F.col("c")).alias("p"))
    out = x.join(prefix.select(key, F.col("_i").alias("_a"), F.col("p").alias("_pa")), [key, "_a"]).join(prefix.select(key, F.col("_i").alias("_b"), F.col("p").alias("_pb")), [key, "_b"])
    mean = (F.col("_pb") - F.col("_pa")) / (F.col("_b") - F.col("_a")) / PARTS
    return out.withColumn("uniqueness", F.when(F.col("_b") > F.col("_a"), mean).otherwise(1.0)).drop("_a", "_b", "_pa", "_pb")


def pooled_uniqueness(labels: DataFrame, symbol: str, start: str, end: str, step_s: int = 3600, normalise: bool = True) -> DataFrame:
    """Adds `uniqueness` over all symbols at once, times all rows / (symbols x the symbol's rows), so that a dense symbol does not prevail; `normalise` makes the weights sum to their number."""
    u = uniqueness(labels.withColumn("_all", F.lit(0)), "_all", start, end, step_s).drop("_all")
    counts = labels.groupBy(symbol).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_symbols"))  # one row
    out = u.join(counts, symbol).crossJoin(F.broadcast(total)).withColumn("uniqueness", F.col("uniqueness") * F.col("_rows") / (F.col("_symbols") * F.col("_n"))).drop("_n", "_symbols")
    if normalise:
        mean = out.agg(F.try_divide(F.sum("uniqueness"), F.count(F.lit(1))).alias("_mean"))  # one row
        out = out.crossJoin(F.broadcast(mean)).withColumn("uniqueness", F.when(F.col("_mean") > 0, F.col("uniqueness") / F.col("_mean")).otherwise(F.col("uniqueness"))).drop("_mean")
    return out.drop("_rows")


def purged_folds(labels: DataFrame, key: list[str], k: int = 5, embargo_s: int = int(5.5 * 86400)) -> DataFrame:
    """(key, decision_time, fold_id, role): test, train, purged or embargo for each row and fold.

    Folds are k blocks of the distinct decision times; a train row is purged if its label interval meets the hull of the
    test intervals, and embargoed for a while after it. Rows meet k fold rows by a broadcast of those.
    """
    times = labels.select("decision_time").distinct().withColumn("block", F.ntile(k).over(Window.partitionBy(F.lit(0)).orderBy("decision_time")))  # one row a time
    x = labels.join(times, "decision_time")
    folds = x.groupBy(F.col("block").alias("fold_id")).agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"))
    role = (
        F.when(F.col("block") == F.col("fold_id"), "test").when((F.col("t0") < F.col("hi")) & (F.col("t1") > F.col("lo")), "purged")
        .when((F.col("decision_time") > F.col("hi")) & (F.col("decision_time") <= shifted(F.col("hi"), embargo_s)), "embargo").otherwise("train")
    )
    return x.crossJoin(F.broadcast(folds)).select(*key, "decision_time", "fold_id", role.alias("role"))  # k rows


def windows(bars: DataFrame, column: str, rows: int, horizons: dict[str, int]) -> DataFrame:
    """(symbol, ts, window, targets): standardised trailing window (population deviation) and forward returns."""
    w = series("symbol", "ts")
    frame = w.rowsBetween(-(rows - 1), 0)
    x = bars.select("symbol", "ts", F.collect_list(column).over(frame).alias("v"), F.avg(column).over(frame).alias("m"), F.stddev_pop(column).over(frame).alias("s"),
                    *((F.try_divide(F.lead(column, n).over(w), F.col(column)) - 1).alias(name) for name, n in horizons.items()))
    return x.where(F.size("v") == rows).select("symbol", "ts", F.transform("v", lambda e: F.coalesce(F.try_divide(e - F.col("m"), F.col("s")), F.lit(0.0))).alias("window"), *horizons)


def channel_windows(bars: DataFrame, channels: list[str], rows: int, horizons: dict[str, int], price: str = "close") -> DataFrame:
    """(symbol, ts, window, targets): the last `rows` bars of several channels as one vector, each channel standardised by itself.

    The vector has the channels of the oldest bar first, then those of the next. Targets are forward returns of the raw price; windows
    that are not full, have a null, or lack a target (or a price other than 0 at the decision) are left out.
    """
    w = series("symbol", "ts")
    frame = w.rowsBetween(-(rows - 1), 0)
    stats = {f"_m{i}": F.avg(c).over(frame) for i, c in enumerate(channels)} | {f"_s{i}": F.stddev_pop(c).over(frame) for i, c in enumerate(channels)}
    ahead = {name: F.try_divide(F.lead(price, n).over(w), F.nullif(F.col(price), F.lit(0.0))) - 1 for name, n in horizons.items()}
    known = F.array(*(F.count(c).over(frame) for c in channels))
    x = bars.select("symbol", "ts", F.collect_list(F.struct(*channels)).over(frame).alias("_v"), F.array_min(known).alias("_n"), *(e.alias(n) for n, e in (stats | ahead).items()))
    x = x.where((F.col("_n") == rows) & F.size("_v").eqNullSafe(rows)).dropna(subset=list(horizons))
    scaled = lambda b: F.array(*((b[c] - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-9) for i, c in enumerate(channels)))
    return x.select("symbol", "ts", F.flatten(F.transform("_v", scaled)).alias("window"), *horizons)


def guarded(train: DataFrame, until: str, *times: str) -> DataFrame:
    """Training rows; one whose decision or label reaches beyond `until` is an error when the rows are read."""
    late = F.greatest(*(F.col(t) for t in times)) > F.lit(until).cast("timestamp") if len(times) > 1 else F.col(times[0]) > F.lit(until).cast("timestamp")
    return train.where(F.when(~F.coalesce(late, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"training rows after {until}")).cast("boolean")))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """One row: expected calibration error over bins of quantiles (repeated edges removed) or, if `strategy` is uniform, of equal width in [0, 1]; the first bin is closed on the left."""
    even = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    edges = df.agg((F.first(even) if strategy == "uniform" else F.array_sort(F.array_distinct(F.percentile(F.col(p), even)))).alias("edges"))
    x = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    bin_ = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(p))))
    g = x.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return g.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_bins"))


def outcome(direction: Column) -> Column:
    return F.when(direction > 0, "long").when(direction < 0, "short").otherwise("flat")
