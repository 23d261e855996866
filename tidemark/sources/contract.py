"""Rules over a table's schema, checked before any plan runs, and reports on its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that only labels have: what happened after the decision.
LABELS = ("label", "tb_label", "meta", "meta_label", "raw_long", "raw_short", "net_long", "net_short", "exit_time", "exit_price", "exit", "t1", "uniqueness", "forward_return")
LABEL_STARTS = ("fwd_", "label_", "target_", "raw_exit_", "net_exit_", "future_")


def label_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.lower() in LABELS or c.lower().startswith(LABEL_STARTS)]


def features(df: DataFrame, keys: tuple[str, ...] = ("symbol", "decision_time"), allowed: tuple[str, ...] = ()) -> DataFrame:
    """`df` as a feature table: its keys are there and no column is a label; else an error that names them, before anything is read."""
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"missing keys: {missing}")
    if leaks := [c for c in label_columns(df.columns) if c not in allowed]:
        raise ValueError(f"labels among the features: {leaks}")
    return df


def availability_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_available_time", "_availability_ts")) or c == "availability_ts"]


def newest_available(df: DataFrame) -> Column:
    """The newest of all availability columns that a schema has; null if it has none."""
    names = [c for c in availability_columns(df) if c not in ("max_feature_available_time", "max_feature_availability_ts")]
    return F.greatest(*names) if len(names) > 1 else F.col(names[0]) if names else F.lit(None).cast("timestamp")


def strict(df: DataFrame, decision: str = "decision_time") -> DataFrame:
    """Adds max_feature_available_time; a row with a feature newer than its decision is an error when the rows are read."""
    newest = newest_available(df)
    late = F.coalesce(newest > F.col(decision), F.lit(False))
    message = F.concat(F.lit("a feature is newer than its decision at "), F.coalesce(F.col(decision).cast("string"), F.lit("?")))
    return df.withColumn("max_feature_available_time", F.when(~late, newest).otherwise(F.raise_error(message).cast("timestamp")))


def feature_view(df: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None, keys: tuple[str, str] = ("symbol", "decision_time")) -> DataFrame:
    """A feature table by symbols and decision times (both ends included) with its keys and the columns asked for; filters and columns reach the scan."""
    from .scan import required

    features(required(df, columns or []), keys)
    if symbols is not None:
        df = df.where(F.col(keys[0]).isin(symbols))
    if start is not None:
        df = df.where(F.col(keys[1]) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(keys[1]) <= F.lit(end).cast("timestamp"))
    return df.select(*dict.fromkeys([*keys, *columns])) if columns else df


def described(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_non_null, missing_pct, sample): one pass; the sample is the least value as text."""
    kinds = dict(df.dtypes)
    text = lambda c: F.col(c).cast("string") if kinds[c] not in ("binary",) and not kinds[c].startswith(("array", "map", "struct")) else F.to_json(F.struct(c))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count(c).alias("n_non_null"), F.min(text(c)).alias("sample")) for c in df.columns)).alias("_c"))
    return one.select("_rows", F.explode("_c").alias("c")).select("c.column", "c.dtype", F.col("_rows").alias("n_rows"), "c.n_non_null", (100 * (1 - F.try_divide(F.col("c.n_non_null"), F.col("_rows")))).alias("missing_pct"), "c.sample")


def pair(x: Column, quote: str = "USDT") -> Column:
    """A market's name without separators and with its quote: BTC, BTC/USDT, btc-usdt and BTCUSDT are BTCUSDT."""
    plain = F.upper(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))
    return F.when(plain.endswith(quote) & (F.length(plain) > len(quote)), plain).otherwise(F.concat(plain, F.lit(quote)))


def slashed(x: Column, quote: str = "USDT") -> Column:
    """The same with a slash: BTC/USDT."""
    return F.concat(base(x, quote), F.lit(f"/{quote}"))


def base(x: Column, quote: str = "USDT") -> Column:
    """The asset of a market: BTC."""
    return F.regexp_replace(pair(x, quote), f"{quote}$", "")


def slug(x: Column) -> Column:
    """A name for files and columns: lower case, separators as one underscore each, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
