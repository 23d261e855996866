"""As-of joins by union and last-value windows: one sort of both sides instead of a range join.

`bucket_s` splits long or hot keys by time: each bucket gets one carried row, the newest one of all earlier buckets, so
a key's history is never in one task. Without it a key's rows are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], seq: str | None = None, bucket_s: int | None = None) -> DataFrame:
    """Every left row with `values` and `right_ts` of the newest right row at or before it (nulls where there is none).

    Equal times match; among right rows of one time the one with the largest `seq` (or values) is taken.
    """
    return asof_many(left, keys, left_ts, [(right, right_ts, values, seq)], bucket_s)


def asof_many(left: DataFrame, keys: list[str], left_ts: str, sources: list[tuple[DataFrame, str, list[str], str | None]], bucket_s: int | None = None) -> DataFrame:
    """Several sources at once: one union, one shuffle and one window, whatever their number."""
    kept = [c for c in left.columns if c not in keys]
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l"))
    for i, (right, ts, values, seq) in enumerate(sources):
        body = F.struct(F.col(ts).alias(ts), *(v for v in values if v != ts))
        order = F.struct(*([seq] if seq else values))
        part = right.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), body.alias(f"_r{i}"), order.alias(f"_o{i}")).where("_t is not null")
        rows = rows.unionByName(part, allowMissingColumns=True)
    found = _newest(rows, keys, len(sources), bucket_s)
    outputs = []
    for i, (_, ts, values, _) in enumerate(sources):
        outputs += [F.col(f"_r{i}.{v}").alias(v) for v in dict.fromkeys([*values, ts])]
    return found.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in kept), *outputs)


def _newest(rows: DataFrame, keys: list[str], n: int, bucket_s: int | None) -> DataFrame:
    """Left rows (_side 1) with the newest non-null _r0 ... of right rows (_side 0) at or before their time _t; ties by _o0 ... ."""
    # the newest of a source may not be hidden by rows of another one: one last-value column for each source
    lasts, orders = [f"_r{i}" for i in range(n)], [f"_o{i}" for i in range(n)]
    by = list(keys)
    if bucket_s:
        rows = rows.withColumn("_b", F.floor(F.unix_timestamp("_t") / bucket_s))
        ends = rows.where("_side = 0").groupBy(*keys, "_b").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_t", o))).alias(c) for c, o in zip(lasts, orders)))
        buckets = rows.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = buckets.select(*keys, "_b", F.lit(-1).alias("_side"), *(F.last(c, ignorenulls=True).over(before).alias(c) for c in lasts))
        rows = rows.unionByName(carried, allowMissingColumns=True)
        by.append("_b")
    w = Window.partitionBy(*by).orderBy(F.col("_side") >= 0, "_t", "_side", *orders).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "_side", "_l", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in lasts)).where("_side = 1")


def carried(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, lags: dict[str, int], bucket_s: int | None = None) -> DataFrame:
    """Every left row with, for each column of `lags`, the newest non-null value that was available: column c of a right row is so `lags[c]` seconds after its time.

    Each column is carried by itself, over right rows where it is null; c_at is the time at which its value became available. One scan of the right side, one
    union and one window, whatever the number of columns and of different lags. Without keys, `bucket_s` is what splits the work.
    """
    names = list(lags)
    kept = [c for c in left.columns if c not in keys]
    cells = F.array(*(F.struct(F.lit(i).alias("m"), (F.col(right_ts) + F.make_dt_interval(secs=F.lit(lags[c]))).alias("t"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)))
    events = right.select(*keys, F.explode(F.filter(cells, lambda e: e["v"].isNotNull() & e["t"].isNotNull())).alias("e"))
    value = lambda i: F.when(F.col("e.m") == i, F.struct(F.col("e.v").alias("v"), F.col("e.t").alias("at")))
    events = events.select(*keys, F.col("e.t").alias("_t"), F.lit(0).alias("_side"), *(value(i).alias(f"_r{i}") for i in range(len(names))), *(F.when(F.col("e.m") == i, F.struct("e.v")).alias(f"_o{i}") for i in range(len(names))))
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l")).unionByName(events, allowMissingColumns=True)
    found = _newest(rows, keys, len(names), bucket_s)
    return found.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in kept), *(e for i, c in enumerate(names) for e in (F.col(f"_r{i}.v").alias(c), F.col(f"_r{i}.at").alias(f"{c}_at"))))


def asof_global(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """As-of without a key: the few distinct left times are matched by range of time, then joined back by equality."""
    month = F.date_trunc("month", F.col("_t"))
    times = left.select(F.col(left_ts).alias("_t")).where("_t is not null").distinct()
    both = times.select("_t", F.lit(1).alias("_side"), F.lit(None).alias("_r")).unionByName(
        right.select(F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_ts).alias(right_ts), *values).alias("_r")).where("_t is not null")
    ).withColumn("_m", month)
    inside = Window.partitionBy("_m").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.where("_side = 0").groupBy("_m").agg(F.max_by("_r", "_t").alias("_e"))
    # months are few: a window over one row for each
    carry = both.select("_m").distinct().join(ends, "_m", "left").select("_m", F.last("_e", ignorenulls=True).over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    hit = both.withColumn("_h", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1").join(carry, "_m").select("_t", F.coalesce("_h", "_c").alias("_h"))
    return left.join(hit, left[left_ts] == hit["_t"], "left").select(*left.columns, *(F.col(f"_h.{v}").alias(v) for v in [*values, right_ts]))


def next_after(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], bucket_s: int = 30 * 86400) -> DataFrame:
    """Every left row with the first right row strictly after it. A task sees a key's rows of one bucket and the first row of the next one that has any."""
    kept = [c for c in left.columns if c not in keys]
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l")).unionByName(
        right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(right_ts, *values).alias("_r")), allowMissingColumns=True
    ).withColumn("_b", F.floor(F.unix_timestamp("_t") / bucket_s))
    # backwards in time, so that the frame grows row by row (one that looks ahead to the end is evaluated anew for each row)
    w = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_n", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    # the least row of each bucket, and for each bucket that of the next one
    heads = rows.groupBy(*keys, "_b").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_h"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, "_b", F.last("_h", ignorenulls=True).over(after).alias("_h"))
    found = found.join(heads, [*keys, "_b"], "left").withColumn("_n", F.coalesce("_n", "_h"))
    return found.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in kept), *(F.col(f"_n.{v}").alias(v) for v in [right_ts, *values]))


def interval_sum(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, right_ts: str, value: str, name: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Sum of `value` over right rows in (start, end], as the difference of two as-of looked-up prefix sums (within buckets, plus those of earlier buckets)."""
    own = right.select(*keys, F.col(right_ts).alias("_at"), F.col(value).alias("_v"), F.floor(F.unix_timestamp(right_ts) / bucket_s).alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t")).select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    sums = own.withColumn("_sum", F.sum("_v").over(inside)).join(base, [*keys, "_b"]).select(*keys, "_at", (F.coalesce("_sum", F.lit(0.0)) + F.col("_base")).alias("_sum")).dropDuplicates([*keys, "_at"])
    one = asof(left, sums, keys, start, "_at", ["_sum"], bucket_s=bucket_s).withColumnRenamed("_sum", "_from").drop("_at")
    two = asof(one, sums, keys, end, "_at", ["_sum"], bucket_s=bucket_s).drop("_at")
    return two.withColumn(name, F.coalesce("_sum", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))).drop("_sum", "_from")


def in_range(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, right_ts: str, bucket_s: int = 86400) -> DataFrame:
    """Pairs with start <= right_ts <= end: left rows are dealt to the buckets they cover, then joined by equality."""
    day = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    spread = left.withColumn("_b", F.explode(F.sequence(day(F.col(start)), day(F.col(end)))))
    return spread.join(right.withColumn("_b", day(F.col(right_ts))), [*keys, "_b"]).where(F.col(right_ts).between(F.col(start), F.col(end))).drop("_b")


def reconcile(internal: DataFrame, exchange: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Full outer join; a missing side counts as 0."""
    a, b = internal.select(key, F.col("q").alias("q_internal")), exchange.select(key, F.col("q").alias("q_exchange"))
    out = a.join(b, key, "full").fillna(0.0, ["q_internal", "q_exchange"])
    return out.withColumn("matches", F.abs(F.col("q_internal") - F.col("q_exchange")) <= tolerance)


def shifted(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds))
