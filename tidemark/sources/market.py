"""Market tables from the given tables: each function reads only the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import cleaning as C

HOUR, FOUR_HOURS, DAY = 3600, 14400, 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All ticks, or those of some symbols and of a time range (start included, end not); filters are on stored columns, so the scan has them."""
    rows = table(spark, sf_dir, "events")
    kind = dict(rows.dtypes)["ts"]
    if symbols is not None:
        rows = rows.where(F.col("event_type").isin(symbols))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast(kind))
    if end is not None:
        rows = rows.where(F.col("ts") < F.lit(end).cast(kind))
    qty = F.get_json_object("props", "$.k").cast("double")
    return rows.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), qty.alias("qty"),
        F.when(F.col("user_id") % 2 == 0, qty).otherwise(0.0).alias("taker_buy_qty"), F.col("event_id").alias("seq"),
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(ticks(spark, sf_dir), HOUR)


def clean_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_bars(bars_1h(spark, sf_dir), "1 hour", ["volume", "taker_buy_vol"])


def bars_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.roll_up(clean_1h(spark, sf_dir), FOUR_HOURS)


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.roll_up(clean_1h(spark, sf_dir), DAY)


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), ((F.col("value") - 50) / 1e5).alias("funding_rate"), F.col("event_id").alias("seq")
    )


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("oi_time"), (F.col("value") * 100).alias("open_interest"), F.col("event_id").alias("seq")
    )


def daily_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("day")).agg(F.sum("l_extendedprice").alias("value"))


def chain_tvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("day"), F.col("o_orderpriority").alias("chain")).agg(F.sum("o_totalprice").alias("tvl_usd"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420).alias("published_at"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420).alias("ts"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "symbol", "ts", (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rolling import roll, series

    w = series("symbol", "ts")
    return bars_4h(spark, sf_dir).select("symbol", "ts", "close", (F.try_divide(F.col("close"), roll(F.avg, "close", w, 20)) - 1).alias("alpha"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that trade the sign of the signal with a lag of one and two bars: (run_id, ts, symbol, close, w).

    Traded prices are the ticks' plus 1000, so that a bar's return is a few per cent, not a multiple.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    s = signals(spark, sf_dir).withColumn("sig", F.coalesce(F.signum("alpha"), F.lit(0.0)) * 0.25)
    lags = s.withColumns({"lag1": F.coalesce(F.lag("sig", 1).over(w), F.lit(0.0)), "lag2": F.coalesce(F.lag("sig", 2).over(w), F.lit(0.0))})
    return lags.withColumn("close", F.col("close") + 1000).unpivot(["symbol", "ts", "close"], ["lag1", "lag2"], "run_id", "w")
