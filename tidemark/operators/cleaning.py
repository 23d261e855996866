"""Keys, gaps, imputation and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import carried, series


def joined_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables with unique keys; a key that is repeated in either is an error when the rows are read, not a product."""
    def unique(x: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return x.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"repeated key on the {side}")).cast("boolean"))).drop("_n")

    return unique(left, "left").join(unique(right, "right"), keys)


def keep_one(df: DataFrame, keys: list[str], order: list[Column | str], newest: bool = True) -> DataFrame:
    """One row a key: the last (or first) by `order`. An order column is required, since a table has no order of its own."""
    by = [c.desc() if newest else c.asc() for c in (F.col(c) if isinstance(c, str) else c for c in order)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union by name, newest row of each key."""
    return keep_one(old.unionByName(new, allowMissingColumns=True), keys, order)


def fill_gaps(bars: DataFrame, step: str, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every `step` between a key's first and last bar, with nulls where there was none."""
    span = bars.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    calendar = span.select(key, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(ts))
    return calendar.join(bars, [key, ts], "left")


def panel(df: DataFrame, key: str, ts: str, columns: list[str], complete: bool = True) -> DataFrame:
    """Every key at every time of the table, columns carried forward by key; with `complete`, only times at which every key knows all of them.

    The result has keys x times rows, which is what a panel is; the lists of both are small, its rows are dealt by key and time.
    """
    times, keys = df.select(ts).distinct(), df.select(key).distinct()
    full = times.crossJoin(F.broadcast(keys)).join(df.select(key, ts, *columns), [key, ts], "left")  # keys: one row a symbol
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = full.select(key, ts, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))
    if not complete:
        return out
    holes = F.sum(F.greatest(*(F.col(c).isNull().cast("int") for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNull().cast("int")).over(Window.partitionBy(ts))
    return out.withColumn("_holes", holes).where("_holes = 0").drop("_holes")


def impute(bars: DataFrame, volumes: list[str]) -> DataFrame:
    """Close is carried forward (a null head takes the first close); open, high and low take the close; volumes are 0."""
    w = series("symbol", "ts")
    head = F.min_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).over(Window.partitionBy("symbol"))  # once a key; frames that look ahead to the end are quadratic
    close = F.coalesce(carried("close", w), head)
    out = bars.withColumn("close", close)
    return out.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in volumes})


def repair(bars: DataFrame) -> DataFrame:
    """High and low are swapped where they are crossed; a close of 0 or less voids the bar's prices, which are carried on again."""
    out = bars.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low")})
    out = out.withColumns({c: F.when(F.col("close") > 0, F.col(c)) for c in ("open", "high", "low", "close")})
    return impute(out, [])


def clean_bars(bars: DataFrame, step: str, volumes: list[str]) -> DataFrame:
    return repair(impute(fill_gaps(bars, step), volumes))


def quality_report(df: DataFrame, keys: list[str], prices: list[str]) -> DataFrame:
    """(check, violations): nulls, non-finite, non-positive prices, crossed bars and repeated keys, in one pass and one key count."""
    void = lambda c: F.count_if(F.col(c).isNull())
    checks = [void(c).alias(f"null_{c}") for c in [*keys, *prices]]
    checks += [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"not_finite_{c}") for c in prices]
    checks += [F.count_if(F.col(c) <= 0).alias(f"not_positive_{c}") for c in prices]
    checks += [F.count_if(F.col("high") < F.col("low")).alias("high_below_low"), F.count(F.lit(1)).alias("rows")]
    one = df.agg(*checks)
    names = one.columns
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("repeated_key").alias("check"), F.col("n").alias("violations"))
    return one.unpivot([], names, "check", "violations").union(repeated)


def look_ahead_audit(df: DataFrame, decision: str, available: list[str], keys: list[str]) -> DataFrame:
    """One row: rows, rows with a feature newer than their decision, null decisions, repeated keys."""
    newest = F.greatest(*available) if len(available) > 1 else F.col(available[0])
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(newest > F.col(decision)).alias("n_look_ahead"), F.count_if(F.col(decision).isNull()).alias("n_no_decision"))
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_repeated_keys"))
    return counts.crossJoin(repeated)  # one row each


def long_report(df: DataFrame, keys: list[str], values: list[str], arrival: str) -> DataFrame:
    """(check, violations) of a long table whose keys end with a time: rows, nulls, non-finite values, times that do not rise in order of `arrival` within the other keys, repeated keys."""
    *own, ts = keys
    x = df.withColumn("_before", F.lag(ts).over(Window.partitionBy(*own).orderBy(arrival)))
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    one = x.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in [*keys, *values]), *(F.count_if(bad(c)).alias(f"not_finite_{c}") for c in values), F.count_if(F.col(ts) <= F.col("_before")).alias("not_in_order"))
    repeated = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("repeated_key").alias("check"), F.col("n").alias("violations"))
    return one.unpivot([], one.columns, "check", "violations").union(repeated)


def row_quality(columns: list[str], found: Column | None = None, late: Column | None = None) -> Column:
    """1 - share of nulls; 0 where the row was not `found`, or where a feature is `late` (newer than the decision)."""
    share = _known_share(columns)
    for bad in ((~found) if found is not None else None, late):
        if bad is not None:
            share = F.when(F.coalesce(bad, F.lit(False)), 0.0).otherwise(share)
    return share


def _known_share(columns: list[str]) -> Column:
    return 1 - F.aggregate(F.array(*(F.col(c).isNull().cast("int") for c in columns)), F.lit(0), lambda a, x: a + x) / len(columns)


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_non_null, missing_pct) of every column from one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in df.columns))
    long = one.unpivot(["_rows"], df.columns, "column", "n_non_null")
    names = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return long.select("column", names[F.col("column")].alias("dtype"), F.col("_rows").alias("n_rows"), "n_non_null", (100 * (1 - F.try_divide(F.col("n_non_null"), F.col("_rows")))).alias("missing_pct"))
