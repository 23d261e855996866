"""Common table expressions of the queries' SQL: the market tables of `sources.market`."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty,
         CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0 END AS taker_buy_qty, event_id AS seq
  FROM events)"""

B1 = f"""{TICKS}, b1 AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (ts, seq)) AS close, sum(qty) AS volume, sum(taker_buy_qty) AS taker_buy_vol
  FROM ticks GROUP BY 1, 2)"""

F1 = f"""{B1}, cal AS (
  SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b1 GROUP BY symbol
), c0 AS (
  SELECT cal.symbol, cal.ts, b1.open, b1.high, b1.low, last_value(b1.close IGNORE NULLS) OVER (PARTITION BY cal.symbol ORDER BY cal.ts ROWS UNBOUNDED PRECEDING) AS close,
         coalesce(b1.volume, 0) AS volume, coalesce(b1.taker_buy_vol, 0) AS taker_buy_vol
  FROM cal LEFT JOIN b1 USING (symbol, ts)
), f1 AS (
  SELECT symbol, ts, coalesce(open, close) AS open, greatest(coalesce(high, close), coalesce(low, close)) AS high,
         least(coalesce(high, close), coalesce(low, close)) AS low, close, volume, taker_buy_vol FROM c0)"""


def rolled(name: str, interval: str) -> str:
    return f"""{name}_all AS (
  SELECT symbol, time_bucket(INTERVAL {interval}, ts) AS bin, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, ts) AS close, sum(volume) AS volume, sum(taker_buy_vol) AS taker_buy_vol FROM f1 GROUP BY 1, 2
), {name} AS (
  SELECT symbol, bin AS ts, open, high, low, close, volume, taker_buy_vol FROM {name}_all
  QUALIFY bin < max(bin) OVER (PARTITION BY symbol))"""


B4 = f"{F1}, {rolled('b4', '4 HOUR')}"
BD = f"{F1}, {rolled('bd', '1 DAY')}"

FUNDING = """funding AS (
  SELECT event_type AS symbol, ts AS "timestamp", (value - 50) / 1e5 AS funding_rate, event_id AS seq FROM events)"""

SIGNALS = f"""{B4}, signals AS (
  SELECT symbol, ts, close, close / nullif(CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END, 0) - 1 AS alpha
  FROM b4 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))"""

WEIGHTS = f"""{SIGNALS}, sg AS (SELECT symbol, ts, close + 1000 AS close, coalesce(sign(alpha), 0)::DOUBLE * 0.25::DOUBLE AS sig FROM signals),
weights AS (
  SELECT 'lag1' AS run_id, symbol, ts, close, coalesce(lag(sig, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) AS w FROM sg
  UNION ALL
  SELECT 'lag2', symbol, ts, close, coalesce(lag(sig, 2) OVER (PARTITION BY symbol ORDER BY ts), 0) FROM sg)"""


def pnl_of(source: str, p: str = "") -> str:
    """P&L of the weights in the table `source` (run_id, symbol, ts, close, w), under names that begin with `p`."""
    return f"""{p}wn AS (
  SELECT run_id, symbol, ts, close, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts)) AS w FROM {source}
), {p}lagged AS (
  SELECT *, coalesce(lag(w, 1) OVER o, 0) AS actual, coalesce(lag(w, 2) OVER o, 0) AS held, coalesce(close / nullif(lag(close) OVER o, 0) - 1, 0) AS asset_return
  FROM {p}wn WINDOW o AS (PARTITION BY run_id, symbol ORDER BY ts)
), {p}sums AS (
  SELECT run_id, ts, sum(actual * asset_return) AS gross, sum(abs(actual - held)) AS turnover FROM {p}lagged GROUP BY 1, 2
), {p}pnl AS (SELECT run_id, ts, turnover, gross - turnover * 0.0015 AS ret FROM {p}sums)"""


def breaker_of(p: str, soft: str = "0.02") -> str:
    """Drawdown, daily loss, level and multiplier of each bar of the table `p`pnl, as `p`cb; `soft` may use avg(abs(daily)) as `typical`."""
    return f"""{p}nv AS (SELECT run_id, ts, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY run_id ORDER BY ts)) AS nv, CASE WHEN count(ret) OVER w6 >= 6 THEN exp(sum(ln(1 + ret)) OVER w6) - 1 END AS daily FROM {p}pnl WINDOW w6 AS (PARTITION BY run_id ORDER BY ts ROWS 5 PRECEDING)
), {p}dl AS (SELECT run_id, ts, 1 - nv / max(nv) OVER (PARTITION BY run_id ORDER BY ts ROWS 539 PRECEDING) AS dd, greatest(0, -coalesce(daily, 0)) AS loss, avg(abs(daily)) OVER (PARTITION BY run_id ORDER BY ts ROWS 119 PRECEDING) AS typical FROM {p}nv
), {p}sf AS (SELECT *, {soft} AS soft FROM {p}dl
), {p}lv AS (SELECT *, CASE WHEN loss > 3 * soft OR dd > 0.3 THEN 3 WHEN loss > 2 * soft OR dd > 0.25 THEN 2 WHEN loss > soft OR dd > 0.2 THEN 1 ELSE 0 END AS level FROM {p}sf
), {p}cb AS (SELECT *, CASE WHEN level >= 3 THEN 0 WHEN level = 2 THEN 0.5 ELSE 1 END * least(greatest((0.2 - dd) / 0.1, 0), 1) AS multiplier FROM {p}lv)"""


PNL = f"""{WEIGHTS}, wn AS (
  SELECT run_id, symbol, ts, close, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts)) AS w FROM weights
), lagged AS (
  SELECT *, coalesce(lag(w, 1) OVER o, 0) AS actual, coalesce(lag(w, 2) OVER o, 0) AS held,
         coalesce(close / nullif(lag(close) OVER o, 0) - 1, 0) AS asset_return, row_number() OVER o AS n
  FROM wn WINDOW o AS (PARTITION BY run_id, symbol ORDER BY ts)
), pnl0 AS (
  SELECT run_id, ts, sum(actual * asset_return) AS gross, sum(abs(actual - held)) AS turnover FROM lagged GROUP BY 1, 2
), pnl AS (
  SELECT run_id, ts, turnover, turnover * 0.0015 AS cost, gross - turnover * 0.0015 AS ret,
         1e6 * exp(sum(ln(1 + gross - turnover * 0.0015)) OVER (PARTITION BY run_id ORDER BY ts)) AS nav
  FROM pnl0)"""
