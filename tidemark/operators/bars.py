"""Bars from ticks, roll-ups, decision grids and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import series


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bin."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_timestamp(c) / seconds) * seconds)


def from_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """symbol, ts (bar open), open, high, low, close, volume, taker_buy_vol; combined before the shuffle. Empty bins have no row."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", floor_to("ts", seconds).alias("bin")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), F.sum("taker_buy_qty").alias("taker_buy_vol"),
    ).withColumnRenamed("bin", "ts")


def roll_up(bars: DataFrame, seconds: int, drop_newest: bool = True) -> DataFrame:
    """Coarser bars from finer ones; the newest bin of a symbol, which may be incomplete, is dropped."""
    out = bars.groupBy("symbol", floor_to("ts", seconds).alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("taker_buy_vol").alias("taker_buy_vol"),
    ).withColumnRenamed("bin", "ts")
    return without_newest(out) if drop_newest else out


def without_newest(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_last", F.max("ts").over(Window.partitionBy("symbol"))).where("ts < _last").drop("_last")


def decision_grid(bars: DataFrame, seconds: int, delay_s: int = 60, availability_s: int = 30) -> DataFrame:
    """Adds ts_close, availability_ts and decision_time."""
    close = F.timestamp_seconds(F.unix_timestamp("ts") + seconds)
    return bars.withColumns({"ts_close": close, "availability_ts": close + F.make_dt_interval(secs=F.lit(availability_s)), "decision_time": close + F.make_dt_interval(secs=F.lit(delay_s))})


def right_edge(ts: Column | str, seconds: int) -> Column:
    """End of the bin that holds ts: what happens at t is known strictly after t."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_timestamp(c) / seconds) * seconds + seconds)


def on_grid(df: DataFrame, step: str, values: list[str], key: str = "symbol", ts: str = "bin") -> DataFrame:
    """A row for every step between a key's first and last bin, missing values as 0."""
    span = df.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    calendar = span.select(key, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(ts))
    return calendar.join(df, [key, ts], "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in values})


def ewma(df: DataFrame, key: str, ts: str, values: dict[str, tuple[str, float]], block: int = 256) -> DataFrame:
    """Exponentially weighted means y = (1 - a) y + a x with y0 = x0, for output name -> (column, a); columns without nulls.

    The recurrence is affine, so blocks of `block` rows are solved by one window sum each, and the few block ends of a
    key are carried over by a fold. No task holds a key's whole history in memory.
    """
    w = series(key, ts)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumns({"_b": F.floor(F.col("_i") / block), "_k": F.col("_i") % block})
    inside = Window.partitionBy(key, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for name, (x, a) in values.items():
        weight = F.when(F.col("_i") == 0, 1.0).otherwise(a)
        parts[f"_{name}"] = F.pow(F.lit(1 - a), F.col("_k") + 1) * F.sum(weight * F.col(x) * F.pow(F.lit(1 - a), -(F.col("_k") + 1))).over(inside)
    rows = rows.withColumns(parts)
    ends = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"), *(F.max_by(f"_{n}", "_k").alias(f"_{n}") for n in values))
    folded = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_b", "n", *(f"_{n}" for n in values)))).alias("e"))

    def fold(name: str, a: float) -> Column:
        return F.aggregate("e", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) * F.pow(F.lit(1 - a), x["n"]) + x[f"_{name}"])))

    carry = folded.withColumns({f"_c_{name}": fold(name, a) for name, (_, a) in values.items()})
    carry = carry.select(key, F.posexplode(F.arrays_zip(*(f"_c_{n}" for n in values)))).select(key, F.col("pos").cast("long").alias("_b"), *(F.col(f"col._c_{n}").alias(f"_c_{n}") for n in values))
    out = rows.join(carry, [key, "_b"])
    return out.withColumns({name: F.col(f"_{name}") + F.col(f"_c_{name}") * F.pow(F.lit(1 - a), F.col("_k") + 1) for name, (_, a) in values.items()}).select(*df.columns, *values)
