"""Scans of long tables, incremental compaction, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME_NAMES = ("timestamp", "ts", "date", "day", "time", "decision_time")


def time_column(df: DataFrame) -> str:
    """The column of a dated table that holds its time, by name, then by type."""
    names = {c.lower(): c for c in df.columns}
    for n in TIME_NAMES:
        if n in names:
            return names[n]
    for c, kind in df.dtypes:
        if kind in ("timestamp", "timestamp_ntz", "date"):
            return c
    raise ValueError("no time column")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_long(df: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, timeframe: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a long table by symbols, time (start included, end not) and timeframe; filters and columns reach the scan."""
    ts = time_column(df)
    required(df, columns or [])
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end).cast("timestamp"))
    return df.select(*columns) if columns else df


def compaction(main: DataFrame, parts: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged table, one row of counts: main, parts, new and overlapping keys)."""
    from ..operators.cleaning import upsert

    old, new = main.select(*keys).distinct().withColumn("_m", F.lit(1)), parts.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = old.join(new, keys, "full")
    counts = both.agg(F.count("_m").alias("n_main"), F.count("_p").alias("n_parts"), F.count_if(F.col("_m").isNull()).alias("n_new"), F.count_if(F.col("_m").isNotNull() & F.col("_p").isNotNull()).alias("n_overlapping"))
    return upsert(main, parts, keys, order), counts


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities as null: the one missing value."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def model_inputs(df: DataFrame, keys: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """Keys and model columns: each the first known of its names that the table has, infinities as null, incomplete rows dropped."""
    required(df, keys)
    chosen = {}
    for name, names in aliases.items():
        present = [n for n in names if n in df.columns]
        if not present:
            raise ValueError(f"no column for {name}: {names}")
        chosen[name] = F.coalesce(*(F.col(n).cast("double") for n in present))
    return finite(df.select(*keys, *(c.alias(n) for n, c in chosen.items())), list(chosen)).dropna(subset=list(chosen))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that `df` has (Parquet, zstandard)."""
    df.repartition(*by).write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def write_text(df: DataFrame, path: str, kind: str = "json") -> None:
    """CSV with header, or JSON lines."""
    (df.write.mode("overwrite").option("header", True).csv if kind == "csv" else df.write.mode("overwrite").json)(path)
