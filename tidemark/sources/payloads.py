"""Nested payloads to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chart_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """JSON charts, either [[epoch, value], ...] or [{"date": epoch, <name>: value}, ...], as (keep, ts, value).

    Epochs of 1e10 and more are milliseconds. Of an object, `value` is taken, else the sum of its other numbers.
    """
    item = F.explode(F.from_json(column, "array<string>")).alias("item")
    rows = df.select(*keep, item)
    pair = F.from_json("item", "array<double>")
    named = F.from_json("item", "map<string,double>")
    is_pair = F.col("item").startswith("[")
    epoch = F.when(is_pair, F.get(pair, F.lit(0))).otherwise(F.coalesce(named["date"], named["timestamp"]))
    others = F.aggregate(F.map_values(F.map_filter(named, lambda k, v: ~k.isin("date", "timestamp") & v.isNotNull())), F.lit(0.0), lambda a, x: a + x)
    value = F.when(is_pair, F.get(pair, F.lit(1))).otherwise(F.coalesce(named["value"], others))
    return rows.select(*keep, F.timestamp_millis(F.when(epoch >= 1e10, epoch).otherwise(epoch * 1000).cast("long")).alias("ts"), value.alias("value"))


def feed_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """RSS items and Atom entries of XML payloads as (keep, title, link, published); a link is an element's text or its address."""
    items = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<(item|entry)\b[^>]*>.*?</\1>"), 0)).alias("item")
    parsed = F.from_xml("item", "title string, pubDate string, published string, updated string")
    link = F.coalesce(F.nullif(F.trim(F.regexp_extract("item", r"(?is)<link\b[^>]*>([^<]+)</link>", 1)), F.lit("")), F.nullif(F.regexp_extract("item", r'(?is)<link\b[^>]*\bhref="([^"]*)"', 1), F.lit("")))
    return df.select(*keep, items).select(*keep, link.alias("link"), parsed.alias("p")).select(*keep, "p.title", "link", F.coalesce("p.pubDate", "p.published", "p.updated").alias("published"))


def json_rows(df: DataFrame, column: str, schema: str, numeric: list[str]) -> DataFrame:
    """JSON objects to typed rows; `numeric` strings that are no numbers become null."""
    out = df.select(F.from_json(column, schema).alias("j")).select("j.*")
    return out.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numeric})
