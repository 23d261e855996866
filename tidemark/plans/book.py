"""Queries over labels, weights, P&L, risk and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions import rolling as R
from ..operators import decisions as D
from ..operators import labels as L
from ..operators import portfolio as P
from ..operators import statistics as N
from ..operators.bars import decision_grid, ewma, from_ticks
from ..sources import market as M
from . import base_sql as S
from .market import grid, market_features, pit_table, MARKET_SQL, PIT_SQL, ewma_sql
from .registry import SQL, query, r6

BARRIER_SQL = f"""{S.B4}, {S.FUNDING}, grid AS (SELECT symbol, ts + INTERVAL 4 HOUR + INTERVAL 1 MINUTE AS decision_time FROM b4),
tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr FROM f1 WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
wd AS (SELECT symbol, ts + INTERVAL 1 HOUR + INTERVAL 30 SECOND AS avail, 1.5 * CASE WHEN count(tr) OVER w >= 20 THEN avg(tr) OVER w END / close AS width FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
d0 AS (SELECT grid.symbol, decision_time, width FROM grid ASOF LEFT JOIN wd ON grid.symbol = wd.symbol AND grid.decision_time >= wd.avail),
d1 AS (SELECT d0.symbol, decision_time, width, f1.ts AS entry_time, f1.open AS entry FROM d0 ASOF JOIN f1 ON d0.symbol = f1.symbol AND d0.decision_time < f1.ts WHERE width > 0),
pa AS (SELECT d1.*, f1.ts, f1.close, high >= entry * (1 + width) AS u, low <= entry * (1 - width) AS dn FROM d1 JOIN f1 ON f1.symbol = d1.symbol AND f1.ts BETWEEN entry_time AND entry_time + INTERVAL 5 DAY),
ag AS (SELECT symbol, decision_time, entry_time, entry, width, min(struct_pack(ts := ts, u := u, d := dn, close := close)) FILTER (u OR dn) AS t, max(ts) AS last_ts, arg_max(close, ts) AS last_close FROM pa GROUP BY ALL),
tb AS (SELECT symbol, decision_time, entry_time, entry, width, coalesce(t.ts, last_ts) AS exit_time,
  CASE WHEN t.u AND t.d THEN t.close WHEN t.u THEN entry * (1 + width) WHEN t.d THEN entry * (1 - width) ELSE last_close END AS exit_price,
  CASE WHEN t.u AND t.d THEN 0 WHEN t.u THEN 1 WHEN t.d THEN -1 WHEN last_close / entry - 1 > 0.5 * width THEN 1 WHEN last_close / entry - 1 < -0.5 * width THEN -1 ELSE 0 END AS label,
  CASE WHEN t.u AND t.d THEN 'dual_touch_ambiguous' WHEN t.u THEN 'upper_touch' WHEN t.d THEN 'lower_touch' WHEN abs(last_close / entry - 1) > 0.5 * width THEN 'vertical_directional' ELSE 'vertical_neutral' END AS reason FROM ag),
tbl AS (SELECT tb.*, exit_price / entry - 1 AS raw_long, coalesce((SELECT sum(funding_rate) FROM funding f WHERE f.symbol = tb.symbol AND f."timestamp" > tb.entry_time AND f."timestamp" <= tb.exit_time), 0) AS rates FROM tb)"""


def barriers(s, d):
    bars = decision_grid(M.clean_1h(s, d), M.HOUR).drop("decision_time")
    return L.triple_barrier(bars, grid(s, d), M.funding(s, d))


@query("triple_barrier", f"WITH {BARRIER_SQL} SELECT symbol, decision_time, entry_time, exit_time, label, reason, round(width, 6) AS width, round(raw_long, 6) AS raw_long, round(raw_long - rates - 0.0016, 6) AS net_long, round(-raw_long + rates - 0.0016, 6) AS net_short FROM tbl")
def triple_barrier(s, d):
    return r6(barriers(s, d).select("symbol", "decision_time", "entry_time", "exit_time", "label", "reason", "width", "raw_long", "net_long", "net_short"), "width", "raw_long", "net_long", "net_short")


FINE_SQL = f"""{BARRIER_SQL}, am AS (SELECT symbol, decision_time, exit_time AS bar, entry * (1 + width) AS up, entry * (1 - width) AS dn FROM tb WHERE reason = 'dual_touch_ambiguous'),
m1 AS (SELECT symbol, date_trunc('minute', ts) AS ts, max(price) AS high, min(price) AS low FROM ticks GROUP BY 1, 2),
fh AS (SELECT am.symbol, decision_time, min(struct_pack(ts := ts, u := high >= up, d := low <= dn)) AS f FROM am JOIN m1 ON m1.symbol = am.symbol AND date_trunc('hour', ts) = bar WHERE high >= up OR low <= dn GROUP BY 1, 2),
tf AS (SELECT tb.* REPLACE (CASE WHEN f.u <> f.d THEN f.ts ELSE exit_time END AS exit_time, CASE WHEN f.u <> f.d THEN CASE WHEN f.u THEN entry * (1 + width) ELSE entry * (1 - width) END ELSE exit_price END AS exit_price,
  CASE WHEN f.u <> f.d THEN CASE WHEN f.u THEN 1 ELSE -1 END ELSE label END AS label, CASE WHEN f.u <> f.d THEN CASE WHEN f.u THEN 'upper_touch' ELSE 'lower_touch' END ELSE reason END AS reason) FROM tb LEFT JOIN fh ON fh.symbol = tb.symbol AND fh.decision_time = tb.decision_time),
tfl AS (SELECT tf.*, exit_price / entry - 1 AS raw_long, coalesce((SELECT sum(funding_rate) FROM funding f WHERE f.symbol = tf.symbol AND f."timestamp" > tf.entry_time AND f."timestamp" <= tf.exit_time), 0) AS rates FROM tf)"""


@query("triple_barrier_fine", f"WITH {FINE_SQL} SELECT symbol, decision_time, entry_time, exit_time, label, reason, round(raw_long, 6) AS raw_long, round(raw_long - rates - 0.0016, 6) AS net_long FROM tfl")
def triple_barrier_fine(s, d):
    """Ambiguous hours settled by bars of a minute, made only of the ticks of those hours."""
    hour = F.date_trunc("hour", "ts")
    finer = lambda bars: from_ticks(M.ticks(s, d).withColumn("bar", hour).join(bars, ["symbol", "bar"], "left_semi").drop("bar"), 60)
    bars = decision_grid(M.clean_1h(s, d), M.HOUR).drop("decision_time")
    x = L.triple_barrier(bars, grid(s, d), M.funding(s, d), finer=finer)
    return r6(x.select("symbol", "decision_time", "entry_time", "exit_time", "label", "reason", "raw_long", "net_long"), "raw_long", "net_long")


@query("meta_label", f"""WITH {BARRIER_SQL}, sg AS (SELECT symbol, ts + INTERVAL 4 HOUR + INTERVAL 1 MINUTE AS decision_time, sign(close / nullif(CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END, 0) - 1) AS direction FROM b4 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, decision_time, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, (CASE WHEN direction > 0 THEN raw_long - rates - 0.0016 ELSE -raw_long + rates - 0.0016 END > 0)::INT AS meta FROM tbl JOIN sg USING (symbol, decision_time) WHERE direction <> 0""")
def meta_label(s, d):
    sig = decision_grid(M.signals(s, d), M.FOUR_HOURS).select("symbol", "decision_time", F.signum("alpha").alias("direction"))
    x = L.meta_label(barriers(s, d).join(sig, ["symbol", "decision_time"]), "direction")
    return x.select("symbol", "decision_time", L.outcome(F.col("direction")).alias("side"), "meta")


LABELS_SQL = "lb AS (SELECT user_id % 7 AS symbol, event_id, date_trunc('hour', ts) AS t0, date_trunc('hour', ts) + to_hours((user_id % 30)::INT) AS t1, date_trunc('hour', ts) AS decision_time FROM events)"


def intervals(s, d):
    t0 = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return M.table(s, d, "events").select((F.col("user_id") % 7).alias("symbol"), "event_id", t0.alias("t0"), (t0 + F.make_dt_interval(hours=(F.col("user_id") % 30).cast("int"))).alias("t1"), t0.alias("decision_time"))


@query("avg_uniqueness", f"""WITH {LABELS_SQL}, ev AS (SELECT symbol, t, sum(e) AS e FROM (SELECT symbol, t0 AS t, 1 AS e FROM lb UNION ALL SELECT symbol, t1, -1 FROM lb) GROUP BY 1, 2),
st AS (SELECT symbol, unnest(generate_series(min(t0), max(t1), INTERVAL 1 HOUR)) AS t FROM lb GROUP BY symbol), cc AS (SELECT symbol, t, greatest(1, sum(coalesce(e, 0)) OVER (PARTITION BY symbol ORDER BY t)) AS c FROM st LEFT JOIN ev USING (symbol, t)),
pp AS (SELECT symbol, t, coalesce(sum(1000000000000 // c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM cc)
SELECT lb.symbol, lb.event_id, round(CASE WHEN t1 > t0 THEN (b.p - a.p)::DOUBLE / date_diff('hour', t0, t1) / 1e12 ELSE 1 END, 6)::DOUBLE AS uniqueness FROM lb JOIN pp a ON a.symbol = lb.symbol AND a.t = t0 JOIN pp b ON b.symbol = lb.symbol AND b.t = t1""")
def avg_uniqueness(s, d):
    return r6(L.uniqueness(intervals(s, d), "symbol", "t0", "t1").select("symbol", "event_id", "uniqueness"), "uniqueness")


@query("pooled_uniqueness", f"""WITH {LABELS_SQL}, ev AS (SELECT t, sum(e) AS e FROM (SELECT t0 AS t, 1 AS e FROM lb UNION ALL SELECT t1, -1 FROM lb) GROUP BY 1),
st AS (SELECT unnest(generate_series((SELECT min(t0) FROM lb), (SELECT max(t1) FROM lb), INTERVAL 1 HOUR)) AS t), cc AS (SELECT t, greatest(1, sum(coalesce(e, 0)) OVER (ORDER BY t)) AS c FROM st LEFT JOIN ev USING (t)),
pp AS (SELECT t, coalesce(sum(1000000000000 // c) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM cc),
u AS (SELECT lb.symbol, lb.event_id, CASE WHEN t1 > t0 THEN (b.p - a.p)::DOUBLE / date_diff('hour', t0, t1) / 1e12 ELSE 1 END * count(*) OVER () / ((SELECT count(DISTINCT symbol) FROM lb) * count(*) OVER (PARTITION BY lb.symbol)) AS w FROM lb JOIN pp a ON a.t = t0 JOIN pp b ON b.t = t1)
SELECT symbol, event_id, round(w / avg(w) OVER (), 5) AS uniqueness FROM u""")
def pooled_uniqueness(s, d):
    return L.pooled_uniqueness(intervals(s, d), "symbol", "t0", "t1").select("symbol", "event_id", F.round("uniqueness", 5).alias("uniqueness"))


@query("purged_folds", f"""WITH {LABELS_SQL}, tm AS (SELECT decision_time, ntile(5) OVER (ORDER BY decision_time) AS block FROM (SELECT DISTINCT decision_time FROM lb)), x AS (SELECT * FROM lb JOIN tm USING (decision_time)),
fo AS (SELECT block AS fold_id, min(t0) AS lo, max(t1) AS hi FROM x GROUP BY 1)
SELECT fold_id::INT AS fold_id, CASE WHEN block = fold_id THEN 'test' WHEN t0 < hi AND t1 > lo THEN 'purged' WHEN decision_time > hi AND decision_time <= hi + INTERVAL 132 HOUR THEN 'embargo' ELSE 'train' END AS role, event_id, decision_time FROM x, fo""")
def purged_folds(s, d):
    return L.purged_folds(intervals(s, d), ["event_id"])


@query("temporal_windows", f"""WITH {S.B4}, x AS (SELECT symbol, ts, list(close) OVER w AS v, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd, count(*) OVER w AS n, lead(close, 1) OVER o / nullif(close, 0) - 1 AS fwd_1, lead(close, 6) OVER o / nullif(close, 0) - 1 AS fwd_6 FROM b4 WINDOW o AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING))
SELECT symbol, ts, round(coalesce((v[1] - m) / nullif(sd, 0), 0), 6) AS first_value, round(coalesce((v[12] - m) / nullif(sd, 0), 0), 6) AS last_value, len(v)::INT AS n, round(fwd_1, 6) AS fwd_1, round(fwd_6, 6) AS fwd_6 FROM x WHERE n = 12""")
def temporal_windows(s, d):
    x = L.windows(M.bars_4h(s, d), "close", 12, {"fwd_1": 1, "fwd_6": 6})
    return r6(x.select("symbol", "ts", F.element_at("window", 1).alias("first_value"), F.element_at("window", -1).alias("last_value"), F.size("window").alias("n"), "fwd_1", "fwd_6"), "first_value", "last_value", "fwd_1", "fwd_6")


CHANNELS, AHEAD = ["close", "volume", "taker_buy_vol", "high"], {"fwd_1": 1, "fwd_3": 3, "fwd_6": 6, "fwd_18": 18}
_ROWS = 12


@query("channel_windows", f"""WITH {S.B4}, x AS (SELECT symbol, ts, {', '.join(f'list({c}) OVER w AS v{i}, avg({c}) OVER w AS m{i}, stddev_pop({c}) OVER w AS s{i}' for i, c in enumerate(CHANNELS))}, count(*) OVER w AS n, {', '.join(f'lead(close, {n}) OVER o / nullif(close, 0) - 1 AS {a}' for a, n in AHEAD.items())}
 FROM b4 WINDOW o AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS {_ROWS - 1} PRECEDING)), y AS (SELECT * FROM x WHERE n = {_ROWS} AND {' AND '.join(f'{a} IS NOT NULL' for a in AHEAD)})
SELECT symbol, ts, {len(CHANNELS) * _ROWS}::INT AS n, {', '.join(f'round((v{i}[1] - m{i}) / (s{i} + 1e-9), 5) AS first_{c}, round((v{i}[{_ROWS}] - m{i}) / (s{i} + 1e-9), 5) AS last_{c}' for i, c in enumerate(CHANNELS))}, {', '.join(f'round({a}, 6) AS {a}' for a in AHEAD)} FROM y""")
def channel_windows(s, d):
    """Windows of four channels and twelve bars with four horizons."""
    x = L.channel_windows(M.bars_4h(s, d), CHANNELS, _ROWS, AHEAD)
    at = lambda i: F.round(F.element_at("window", i), 5)
    ends = [e for i, c in enumerate(CHANNELS) for e in (at(i + 1).alias(f"first_{c}"), at((_ROWS - 1) * len(CHANNELS) + i + 1).alias(f"last_{c}"))]
    return r6(x.select("symbol", "ts", F.size("window").alias("n"), *ends, *AHEAD), *AHEAD)


@query("ece_uniform", """WITH x AS (SELECT quality AS y, (doc_id % 100) / 100.0::DOUBLE AS p FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL), b AS (SELECT greatest(1, len([i FOR i IN range(0, 11) IF i / 10.0 < p])) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM x GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS ece, sum(n)::BIGINT AS n_rows, count(*) AS n_bins FROM b""")
def ece_uniform(s, d):
    x = M.table(s, d, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 100) / 100).alias("p"))
    return r6(L.calibration_error(x, "y", "p", strategy="uniform"), "ece")


@query("ece", """WITH x AS (SELECT quality AS y, (doc_id % 100) / 100.0::DOUBLE AS p FROM labels), e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM x),
b AS (SELECT greatest(1, len([v FOR v IN edges IF v < p])) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM x, e GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, sum(n)::BIGINT AS n_rows, count(*) AS n_bins FROM b""")
def ece(s, d):
    x = M.table(s, d, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 100) / 100).alias("p"))
    return r6(L.calibration_error(x, "y", "p"), "ece")


def w(s, d):
    return M.weights(s, d)


def pnl(s, d):
    return P.pnl(w(s, d))


@query("pnl_series", f"WITH {S.PNL} SELECT run_id, ts, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(ret, 6) AS ret, round(nav, 2) AS nav FROM pnl")
def pnl_series(s, d):
    return r6(pnl(s, d).withColumn("nav", F.round("nav", 2)), "turnover", "cost", "ret")


@query("trade_records", f"""WITH {S.PNL}, v AS (SELECT run_id, ts, coalesce(lag(nav) OVER o, 1e6) AS value_before, lag(ts) OVER o AS signal_ts FROM pnl WINDOW o AS (PARTITION BY run_id ORDER BY ts))
SELECT run_id, ts, signal_ts, symbol, CASE WHEN actual > held THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN held = 0 AND actual > 0 THEN 'OPEN_LONG' WHEN held > 0 AND actual = 0 THEN 'CLOSE_LONG' WHEN held > 0 AND actual > 0 THEN (CASE WHEN actual > held THEN 'INCREASE_LONG' ELSE 'REDUCE_LONG' END)
  WHEN held = 0 AND actual < 0 THEN 'OPEN_SHORT' WHEN held < 0 AND actual = 0 THEN 'CLOSE_SHORT' WHEN held < 0 AND actual < 0 THEN (CASE WHEN actual < held THEN 'INCREASE_SHORT' ELSE 'REDUCE_SHORT' END) WHEN held > 0 AND actual < 0 THEN 'FLIP_LONG_TO_SHORT' WHEN held < 0 AND actual > 0 THEN 'FLIP_SHORT_TO_LONG' ELSE 'UNKNOWN' END AS trade_type,
  close AS execution_price, round(held, 6) AS pre_weight, round(actual, 6) AS post_weight, round((actual - held) * value_before, 2) AS trade_amount, round((actual - held) * value_before / close, 4) AS quantity, round(abs((actual - held) * value_before) * 0.0015, 4) AS fee FROM lagged JOIN v USING (run_id, ts) WHERE abs(actual - held) > 1e-12""")
def trade_records(s, d):
    t = P.trades(w(s, d)).withColumns({"trade_amount": F.round("trade_amount", 2), "quantity": F.round("quantity", 4), "fee": F.round("fee", 4)})
    return r6(t, "pre_weight", "post_weight")


@query("position_records", f"WITH {S.PNL} SELECT run_id, ts, symbol, round(actual, 6) AS weight, round(actual * nav, 2) AS market_value, round(actual * nav / close, 4) AS quantity, round(actual * asset_return, 6) AS contribution FROM lagged JOIN pnl USING (run_id, ts) WHERE actual <> 0")
def position_records(s, d):
    return r6(P.positions(w(s, d)).withColumns({"market_value": F.round("market_value", 2), "quantity": F.round("quantity", 4)}), "weight", "contribution")


METRICS = ["total_return", "annual_return", "volatility", "sharpe", "mean_sharpe", "sortino", "win_rate", "profit_loss_ratio"]


@query("run_metrics", f"""WITH {S.PNL}, a AS (SELECT run_id, exp(sum(ln(1 + ret))) AS growth, arg_min(ret, ts) AS f, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS down, count(*) FILTER (ret > 0) AS pc, count(*) FILTER (ret < 0) AS lc, avg(ret) FILTER (ret > 0) AS ap, avg(ret) FILTER (ret < 0) AS al FROM pnl GROUP BY 1),
b AS (SELECT *, growth ** (2190.0 / n) - 1 AS yr, sqrt(2190.0) AS r FROM a)
SELECT run_id, n AS n_bars, round(growth / (1 + f) - 1, 6) AS total_return, round(yr, 6) AS annual_return, round(sd * r, 6) AS volatility, round(yr / nullif(sd * r, 0), 6) AS sharpe, round(m * r / nullif(sd, 0), 6) AS mean_sharpe, round(yr / nullif(down * r, 0), 6) AS sortino, round(pc / nullif(pc + lc, 0), 6)::DOUBLE AS win_rate, pc AS profit_count, lc AS loss_count, round(ap / nullif(abs(al), 0), 6) AS profit_loss_ratio FROM b""")
def run_metrics(s, d):
    return r6(P.metrics(pnl(s, d)), *METRICS)


@query("max_drawdown", f"""WITH {S.PNL}, x AS (SELECT run_id, ts, nav, max(nav) OVER (PARTITION BY run_id ORDER BY ts) AS top FROM pnl), t AS (SELECT run_id, min(nav / top - 1) AS dd, max(ts) AS fin FROM x GROUP BY 1),
t2 AS (SELECT run_id, dd, fin, min(ts) AS trough, min_by(top, ts) AS top FROM x JOIN t USING (run_id) WHERE nav / top - 1 = dd GROUP BY 1, 2, 3),
t3 AS (SELECT t2.run_id, dd, fin, trough, min(ts) FILTER (nav = t2.top AND ts <= trough) AS peak, min(ts) FILTER (ts >= trough AND nav >= t2.top) AS recovery FROM t2 JOIN x ON x.run_id = t2.run_id GROUP BY ALL)
SELECT run_id, round(dd, 6) AS max_drawdown, peak, trough, recovery, floor(epoch(coalesce(recovery, fin) - peak) / 86400)::BIGINT AS days FROM t3""")
def max_drawdown(s, d):
    return r6(P.max_drawdown(pnl(s, d)), "max_drawdown")


@query("benchmark_metrics", f"""WITH {S.PNL}, bm AS (SELECT ts, avg(asset_return) AS bench FROM lagged WHERE run_id = 'lag1' GROUP BY 1), x AS (SELECT *, ret - bench AS ex FROM pnl JOIN bm USING (ts)),
a AS (SELECT run_id, covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, exp(sum(ln(1 + ret))) ** (2190.0 / count(*)) - 1 AS own, exp(sum(ln(1 + bench))) ** (2190.0 / count(*)) - 1 AS th, avg(ex) AS em, stddev_samp(ex) * sqrt(2190.0) AS te, avg((ret > bench)::INT) AS wr FROM x GROUP BY 1)
SELECT run_id, round(beta, 6) AS beta, round(em, 6) AS excess_mean, round(te, 6) AS tracking_error, round(em * 2190 / nullif(te, 0), 6) AS information_ratio, round(wr, 6) AS excess_win_rate FROM a""")
def benchmark_metrics(s, d):
    bench = P.held(w(s, d)).where("run_id = 'lag1'").groupBy("ts").agg(F.avg("asset_return").alias("bench"))
    return r6(P.against_benchmark(pnl(s, d), bench).drop("alpha"), "beta", "excess_mean", "tracking_error", "information_ratio", "excess_win_rate")


@query("monthly_returns", f"""WITH {S.PNL}, e AS (SELECT run_id, date_trunc('month', ts) AS m, arg_max(nav, ts) AS nav FROM pnl GROUP BY 1, 2) SELECT run_id, year(m)::INT AS "year", month(m)::INT AS "month", round(nav / nullif(lag(nav) OVER (PARTITION BY run_id ORDER BY m), 0) - 1, 6) AS ret FROM e""")
def monthly_returns(s, d):
    return r6(P.monthly(pnl(s, d)), "ret")


@query("yearly_sharpe", f"""WITH {S.PNL} SELECT run_id, year(ts)::INT AS "year", round(avg(ret) * sqrt(2190.0) / nullif(stddev_samp(ret), 0), 6) AS sharpe, count(*) AS n FROM pnl GROUP BY 1, 2""")
def yearly_sharpe(s, d):
    return r6(P.yearly_sharpe(pnl(s, d)), "sharpe")


@query("rolling_sharpe", f"""WITH {S.PNL} SELECT run_id, ts, round(CASE WHEN count(ret) OVER w >= 60 THEN avg(ret) OVER w * sqrt(2190.0) / nullif(stddev_samp(ret) OVER w, 0) END, 4) AS sharpe FROM pnl WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS 59 PRECEDING)""")
def rolling_sharpe(s, d):
    by = P.by_run()
    return pnl(s, d).select("run_id", "ts", F.round(F.try_divide(R.roll(F.avg, "ret", by, 60) * F.sqrt(F.lit(2190.0)), R.roll(F.stddev_samp, "ret", by, 60)), 4).alias("sharpe"))


@query("trading_metrics", f"WITH {S.PNL}, g AS (SELECT run_id, ts, sum(abs(actual)) AS gross, sum(actual) AS net FROM lagged GROUP BY 1, 2) SELECT run_id, round(avg(turnover), 6) AS mean_turnover, round(sum(cost), 6) AS total_cost, round(avg(gross), 6) AS mean_gross, round(avg(net), 6) AS mean_net FROM pnl JOIN g USING (run_id, ts) GROUP BY 1")
def trading_metrics(s, d):
    g = P.held(w(s, d)).groupBy("run_id", "ts").agg(F.sum(F.abs("actual")).alias("gross"), F.sum("actual").alias("net"))
    out = pnl(s, d).join(g, ["run_id", "ts"]).groupBy("run_id").agg(F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost"), F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"))
    return r6(out, "mean_turnover", "total_cost", "mean_gross", "mean_net")


def parity_sql(x: str) -> str:
    """Weights pw(ts, symbol, w) of the bars and directions (symbol, ts, close, ret, dir) that `x` selects."""
    return f"""x AS ({x}), tm AS (SELECT ts, row_number() OVER (ORDER BY ts) AS bar FROM (SELECT DISTINCT ts FROM b4)), y AS (SELECT x.*, bar, CASE WHEN count(ret) OVER w >= 30 THEN stddev_samp(ret) OVER w END AS vol FROM x JOIN tm USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)),
i AS (SELECT *, CASE WHEN vol > 1e-12 AND dir IS NOT NULL THEN 1 / vol END AS inv FROM y), r AS (SELECT *, coalesce(dir * inv / sum(inv) OVER (PARTITION BY ts), 0) AS w FROM i),
q AS (SELECT r.ts, y.bar, sum(r.w * y.ret) AS v, count(*) FILTER (y.ret IS NULL) AS holes FROM r JOIN y ON y.symbol = r.symbol AND y.bar BETWEEN r.bar - 29 AND r.bar WHERE r.w <> 0 GROUP BY 1, 2), pv AS (SELECT ts, sqrt(var_samp(v) * 2190) AS pv FROM q WHERE holes = 0 GROUP BY 1),
z AS (SELECT r.ts, symbol, w * CASE WHEN pv > 1e-12 THEN least(0.3 / pv, 3) ELSE 0 END AS w FROM r LEFT JOIN pv USING (ts)), pw AS (SELECT ts, symbol, w / greatest(1, sum(abs(w)) OVER (PARTITION BY ts)) AS w FROM z)"""


def _moved(*lookbacks: int) -> str:
    signs = [f"sign(close / nullif(lag(close, {n}) OVER o, 0) - 1)" for n in lookbacks]
    d = signs[0] if len(signs) == 1 else f"({' + '.join(f'coalesce({x}, 0)' for x in signs)}) / {len(signs)}.0::DOUBLE"
    return f"SELECT symbol, ts, close, close / nullif(lag(close) OVER o, 0) - 1 AS ret, {d} AS dir FROM b4 WINDOW o AS (PARTITION BY symbol ORDER BY ts)"


@query("multiscale_weights", f"WITH {S.B4}, {parity_sql(_moved(6, 18, 54))} SELECT ts, symbol, round(w, 6) AS w FROM pw")
def multiscale_weights(s, d):
    """Three lookbacks of a day, three days and nine, as these tables hold a month."""
    return r6(P.multiscale_weights(M.bars_4h(s, d), (6, 18, 54)), "w")


@query("tsmom_weights", f"WITH {S.B4}, {parity_sql(_moved(24))} SELECT ts, symbol, round(w, 6) AS w FROM pw")
def tsmom_weights(s, d):
    return r6(P.momentum_weights(M.bars_4h(s, d), lookback=24), "w")


A = 2 / (12 + 1)


@query("xs_neutral_weights", f"""WITH RECURSIVE {S.SIGNALS}, cv AS (SELECT symbol, ts, sign(coalesce(alpha, 0)) * least(abs(coalesce(alpha, 0)) / 0.2, 1) AS c FROM signals), {ewma_sql('cv', 'symbol', 'ts', {'e': ('c', A)})},
n1 AS (SELECT symbol, ts, e - avg(e) OVER (PARTITION BY ts) AS x FROM ew) SELECT symbol, ts, round(CASE WHEN sum(abs(x)) OVER (PARTITION BY ts) > 1e-12 THEN x / sum(abs(x)) OVER (PARTITION BY ts) ELSE 0 END, 6) AS w FROM n1""")
def xs_neutral_weights(s, d):
    c = M.signals(s, d).select("symbol", "ts", risk.conviction(F.coalesce("alpha", F.lit(0.0))).alias("c"))
    return r6(P.neutral(ewma(c, "symbol", "ts", {"w": ("c", A)}), "w").select("symbol", "ts", "w"), "w")


A7 = 2 / (6 + 1)
_META = "1 / (1 + exp(-8 * abs(coalesce(alpha, 0))))"


@query("deployed_books", f"""WITH RECURSIVE {S.SIGNALS}, cv AS (SELECT symbol, ts, CASE WHEN abs(coalesce(alpha, 0)) >= 0.02 AND {_META} > 0.55 THEN sign(alpha) * least(abs(alpha) / 0.2, 1) ELSE 0 END::DOUBLE AS c FROM signals), {ewma_sql('cv', 'symbol', 'ts', {'e': ('c', A7)})},
n1 AS (SELECT symbol, ts, e - avg(e) OVER t AS x, least(avg(abs(e)) OVER t, 1) AS full_ FROM ew WINDOW t AS (PARTITION BY ts)), n2 AS (SELECT symbol, ts, CASE WHEN sum(abs(x)) OVER t > 1e-12 THEN x / sum(abs(x)) OVER t ELSE 0 END * full_ AS x FROM n1 WINDOW t AS (PARTITION BY ts)),
rn2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM n2), ew2 AS (SELECT symbol, ts, i, x AS e FROM rn2 WHERE i = 1 UNION ALL SELECT r.symbol, r.ts, r.i, (1 - {A7!r}) * e.e + {A7!r} * r.x FROM ew2 e JOIN rn2 r ON r.symbol = e.symbol AND r.i = e.i + 1),
{parity_sql("SELECT b4.symbol, b4.ts, close, close / nullif(lag(close) OVER (PARTITION BY b4.symbol ORDER BY b4.ts), 0) - 1 AS ret, coalesce(e, 0) AS dir FROM b4 LEFT JOIN ew ON ew.symbol = b4.symbol AND ew.ts = b4.ts")}
SELECT 'simple' AS mode, symbol, ts, round(e * 0.25, 5) AS w FROM ew UNION ALL SELECT 'parity', symbol, ts, round(w, 5) FROM pw UNION ALL SELECT 'neutral', symbol, ts, round(e - avg(e) OVER (PARTITION BY ts), 5) FROM ew2""")
def deployed_books(s, d):
    """One score with a dead band and a meta gate as three books."""
    x = M.signals(s, d).select("symbol", "ts", "close", "alpha", (1 / (1 + F.exp(-8 * F.abs(F.coalesce("alpha", F.lit(0.0)))))).alias("meta"))
    books = [D.deployed(x, mode, x.select("symbol", "ts", "close"), deadband=0.02, allow_flat=True).select(F.lit(mode).alias("mode"), "symbol", "ts", F.round("w", 5).alias("w")) for mode in ("simple", "parity", "neutral")]
    return books[0].unionByName(books[1]).unionByName(books[2])


@query("no_trade_band", f"""WITH RECURSIVE {S.WEIGHTS}, rn AS (SELECT *, row_number() OVER (PARTITION BY run_id, symbol ORDER BY ts) AS i FROM weights), b AS (SELECT run_id, symbol, ts, i, w FROM rn WHERE i = 1
  UNION ALL SELECT r.run_id, r.symbol, r.ts, r.i, CASE WHEN abs(r.w - b.w) > 0.3 THEN r.w ELSE b.w END FROM b JOIN rn r ON r.run_id = b.run_id AND r.symbol = b.symbol AND r.i = b.i + 1) SELECT run_id, symbol, ts, w FROM b""")
def no_trade_band(s, d):
    return P.no_trade_band(w(s, d), 0.3)


@query("hysteresis_positions", f"""WITH RECURSIVE {S.SIGNALS}, rn AS (SELECT symbol, ts, alpha AS s, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM signals),
h AS (SELECT symbol, ts, i, CASE WHEN s > 0.02 THEN 1 WHEN s < -0.02 THEN -1 ELSE 0 END AS p FROM rn WHERE i = 1 UNION ALL SELECT r.symbol, r.ts, r.i,
  CASE WHEN s IS NULL THEN 0 WHEN p = 0 THEN (CASE WHEN s > 0.02 THEN 1 WHEN s < -0.02 THEN -1 ELSE 0 END) WHEN p = 1 THEN (CASE WHEN s < 0.005 THEN 0 ELSE 1 END) ELSE (CASE WHEN s > -0.005 THEN 0 ELSE -1 END) END FROM h JOIN rn r ON r.symbol = h.symbol AND r.i = h.i + 1)
SELECT symbol, ts, p::INT AS position FROM h""")
def hysteresis_positions(s, d):
    return P.hysteresis(M.signals(s, d).withColumnRenamed("alpha", "score"), 0.02, 0.005, ["symbol"])


@query("portfolio_overlay", f"""WITH {S.WEIGHTS}, x AS (SELECT run_id, symbol, ts, w * 2 AS w, CASE WHEN symbol IN ('click', 'view') THEN 'majors' ELSE symbol END AS cluster FROM weights),
a AS (SELECT *, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts, cluster) / 0.5) AS w1 FROM x), b AS (SELECT *, w1 / greatest(1, sum(abs(w1)) OVER (PARTITION BY run_id, ts)) AS w2 FROM a) SELECT run_id, symbol, ts, round(least(greatest(w2, -0.25), 0.25), 6)::DOUBLE AS w FROM b""")
def portfolio_overlay(s, d):
    x = w(s, d).withColumn("w", F.col("w") * 2)
    clusters = x.select("symbol").distinct().withColumn("cluster", F.when(F.col("symbol").isin("click", "view"), "majors").otherwise(F.col("symbol")))
    return r6(P.overlay(x, clusters).select("run_id", "symbol", "ts", "w"), "w")


@query("breaker_multiplier", f"""WITH {S.PNL}, n AS (SELECT run_id, ts, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY run_id ORDER BY ts)) AS nv, CASE WHEN count(ret) OVER w6 >= 6 THEN exp(sum(ln(1 + ret)) OVER w6) - 1 END AS daily FROM pnl WINDOW w6 AS (PARTITION BY run_id ORDER BY ts ROWS 5 PRECEDING)),
x AS (SELECT run_id, ts, 1 - nv / max(nv) OVER (PARTITION BY run_id ORDER BY ts ROWS 539 PRECEDING) AS dd, greatest(0, -coalesce(daily, 0)) AS dl, greatest(0.02, coalesce(1.5 * avg(abs(daily)) OVER (PARTITION BY run_id ORDER BY ts ROWS 119 PRECEDING), 0)) AS soft FROM n),
y AS (SELECT *, CASE WHEN dl > 3 * soft OR dd > 0.3 THEN 3 WHEN dl > 2 * soft OR dd > 0.25 THEN 2 WHEN dl > soft OR dd > 0.2 THEN 1 ELSE 0 END AS level FROM x)
SELECT run_id, ts, round(dd, 6) AS drawdown, level::INT AS level, round(CASE WHEN level >= 3 THEN 0 WHEN level = 2 THEN 0.5 ELSE 1 END * least(greatest((0.2 - dd) / 0.1, 0), 1), 5)::DOUBLE AS multiplier FROM y""")
def breaker_multiplier(s, d):
    return r6(P.breaker(pnl(s, d)).select("run_id", "ts", "drawdown", "level", F.round("multiplier", 5).alias("multiplier")), "drawdown")


@query("sleeve_combine", f"""WITH {S.PNL}, a AS (SELECT ts, ret FROM pnl WHERE run_id = 'lag1'), b AS (SELECT ts, ret FROM pnl WHERE run_id = 'lag2'), s AS (SELECT (SELECT stddev_samp(ret) FROM a) AS sa, (SELECT stddev_samp(ret) FROM b) AS sb)
SELECT coalesce(a.ts, b.ts) AS ts, round(0.5 * (sa + sb) / 2 * (coalesce(coalesce(a.ret, 0) / nullif(sa, 0), 0) + coalesce(coalesce(b.ret, 0) / nullif(sb, 0), 0)), 6) AS ret FROM a FULL JOIN b ON a.ts = b.ts, s""")
def sleeve_combine(s, d):
    p = pnl(s, d)
    return r6(P.sleeves(p.where("run_id = 'lag1'"), p.where("run_id = 'lag2'")), "ret")


@query("risk_sizing", f"""WITH {PIT_SQL}, x AS (SELECT symbol, decision_time, coalesce(ret_24h, 0) AS alpha, vol_96h AS vol, 1 - (funding_rate IS NULL)::INT * 0.5 AS dq FROM pit2),
y AS (SELECT *, (dq + 1 + 0) / 3.0 AS conf, sign(alpha) AS sg, least(greatest(abs(alpha) / 0.2, 0), 1) AS edge, vol * sqrt(2190.0) AS rv FROM x)
SELECT symbol, decision_time, round(coalesce(least(greatest(0.25 * edge * sg * CASE WHEN rv > 1e-12 THEN least(0.3 / rv, 3) ELSE 0 END * least(1, conf / 0.8), -0.25), 0.25), 0), 6)::DOUBLE AS position FROM y""")
def risk_sizing(s, d):
    x = pit_table(s, d).select("symbol", "decision_time", F.coalesce("ret_24h", F.lit(0.0)).alias("alpha"), F.col("vol_96h").alias("vol"), (1 - F.col("funding_rate").isNull().cast("int") * 0.5).alias("dq"))
    sure = risk.confidence(F.col("dq"), F.col("alpha"), P.unknown(), P.unknown())
    return r6(x.select("symbol", "decision_time", risk.sized(F.col("alpha"), P.unknown(), F.col("vol"), sure, F.lit(0), use_meta=False).alias("position")), "position")


IC_SQL = f"{S.SIGNALS}, fx AS (SELECT symbol, ts, alpha, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS fwd FROM signals)"


def forward(s, d):
    return M.signals(s, d).withColumn("fwd", F.try_divide(F.lead("close").over(R.series("symbol", "ts")), "close") - 1)


def rank_sql(x: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


@query("spearman_ic", f"WITH {IC_SQL}, r AS (SELECT symbol, {rank_sql('alpha', 'symbol')} AS a, {rank_sql('fwd', 'symbol')} AS b FROM fx WHERE alpha IS NOT NULL AND fwd IS NOT NULL) SELECT symbol, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1")
def spearman_ic(s, d):
    return r6(N.rank_ic(forward(s, d), ["symbol"], "alpha", "fwd"), "ic")


@query("newey_west", f"""WITH {S.PNL}, e AS (SELECT run_id, ret, ret - avg(ret) OVER (PARTITION BY run_id) AS e, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM pnl), g AS (SELECT run_id, avg(ret) AS m, count(*) AS n, sum(e * e) AS g0 FROM e GROUP BY 1),
c AS (SELECT a.run_id, sum((1 - (a.i - b.i) / 7.0) * a.e * b.e) AS gl FROM e a JOIN e b ON a.run_id = b.run_id AND a.i - b.i BETWEEN 1 AND 6 GROUP BY 1) SELECT run_id, round(m, 8) AS mean, n, round(m / sqrt(greatest((g0 + 2 * gl) / n, 1e-18) / n), 6) AS t_stat FROM g JOIN c USING (run_id)""")
def newey_west(s, d):
    return r6(N.newey_west(pnl(s, d), "run_id", "ts", "ret", 6).withColumn("mean", F.round("mean", 8)), "t_stat")


@query("pearson_ic", f"WITH {IC_SQL} SELECT symbol, round(corr(alpha, fwd), 6) AS ic, count(*) AS n FROM fx WHERE alpha IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def pearson_ic(s, d):
    return r6(N.linear_ic(forward(s, d), ["symbol"], "alpha", "fwd").select("symbol", "ic", "n"), "ic")


@query("xs_ic", f"""WITH {IC_SQL}, r AS (SELECT ts, {rank_sql('alpha', 'ts')} AS a, {rank_sql('fwd', 'ts')} AS b FROM fx WHERE alpha IS NOT NULL AND fwd IS NOT NULL), c AS (SELECT ts, corr(a, b) AS ic FROM r GROUP BY 1 HAVING count(*) >= 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT 'all' AS k, round(avg(ic), 6) AS mean_ic, count(*) AS n_periods, round(avg(ic) * sqrt(count(*)) / nullif(stddev_samp(ic), 0), 6) AS t_stat FROM c""")
def xs_ic(s, d):
    return r6(N.cross_sectional_ic(forward(s, d).withColumn("k", F.lit("all")), "k", "ts", "alpha", "fwd"), "mean_ic", "t_stat")


@query("pbo", f"""WITH {S.B4}, x AS (SELECT symbol AS run_id, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4), tm AS (SELECT ts, ntile(6) OVER (ORDER BY ts) AS block FROM (SELECT DISTINCT ts FROM x WHERE ret IS NOT NULL)),
p AS (SELECT run_id, block, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM x JOIN tm USING (ts) WHERE ret IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT a.i * 10000 + b.i * 100 + c.i AS split, [a.i, b.i, c.i] AS ins FROM range(1, 7) a(i), range(1, 7) b(i), range(1, 7) c(i) WHERE a.i < b.i AND b.i < c.i),
f AS (SELECT split, run_id, sum(n) FILTER (list_contains(ins, block)) AS n1, sum(s) FILTER (list_contains(ins, block)) AS s1, sum(q) FILTER (list_contains(ins, block)) AS q1, sum(n) FILTER (NOT list_contains(ins, block)) AS n0, sum(s) FILTER (NOT list_contains(ins, block)) AS s0, sum(q) FILTER (NOT list_contains(ins, block)) AS q0 FROM p, sp GROUP BY 1, 2),
h AS (SELECT split, run_id, coalesce(s1 / n1 / nullif(sqrt(greatest(q1 / n1 - (s1 / n1) ** 2, 0)), 0), 0) AS inn, coalesce(s0 / n0 / nullif(sqrt(greatest(q0 / n0 - (s0 / n0) ** 2, 0)), 0), 0) AS out FROM f),
k AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY inn DESC, run_id) AS best, row_number() OVER (PARTITION BY split ORDER BY out, run_id) AS r, count(*) OVER (PARTITION BY split) AS n FROM h)
SELECT round(avg((ln((r / (n + 1.0)) / (1 - r / (n + 1.0))) <= 0)::INT), 6)::DOUBLE AS pbo, count(*) AS n_splits FROM k WHERE best = 1""")
def pbo(s, d):
    x = M.bars_4h(s, d).select(F.col("symbol").alias("run_id"), "ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret")).where("ret is not null")
    return r6(N.overfit_probability(x, 6), "pbo")


@query("pbo_worst_block", SQL["pbo"].replace("SELECT split, run_id, coalesce(s1 / n1", "SELECT split, run_id, coalesce(m1, 0) AS inn, coalesce(m0, 0) AS out FROM (SELECT split, run_id, min(s / n) FILTER (list_contains(ins, block)) AS m1, min(s / n) FILTER (NOT list_contains(ins, block)) AS m0 FROM p, sp GROUP BY 1, 2)), unused AS (SELECT coalesce(s1 / n1"))
def pbo_worst_block(s, d):
    """The same by another measure of the user: the mean return of a run's worst block."""
    x = M.bars_4h(s, d).select(F.col("symbol").alias("run_id"), "ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret")).where("ret is not null")
    return r6(N.overfit_probability(x, 6, lambda n, s, q: F.min(F.try_divide(s, n))), "pbo")


@query("pair_corr_by_year", f"""WITH {S.B4}, x AS (SELECT symbol, ts, year(ts)::INT AS "year", close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4) SELECT x."year", x.symbol AS a, y.symbol AS b, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n FROM x JOIN x y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2, 3""")
def pair_corr_by_year(s, d):
    x = M.bars_4h(s, d).select("symbol", "ts", F.year("ts").alias("year"), R.pct_change("close", R.series("symbol", "ts")).alias("ret")).where("ret is not null")
    return r6(N.pair_correlations(x, "year"), "corr")


@query("bootstrap_sharpe", f"""WITH {S.PNL}, r AS (SELECT run_id, row_number() OVER o AS i, sum(ret) OVER o AS s, sum(ret * ret) OVER o AS q FROM pnl WINDOW o AS (PARTITION BY run_id ORDER BY ts)), n AS (SELECT run_id, count(*) AS n FROM pnl GROUP BY 1 HAVING count(*) >= 40),
pre AS (SELECT run_id, i, s, q FROM r UNION ALL SELECT run_id, 0, 0, 0 FROM n), dr AS (SELECT n.run_id, b.i AS boot, ('0x' || substr(md5(n.run_id || ':' || b.i || ':' || k.i || ':7'), 1, 8))::BIGINT % (n - 19) AS i FROM n, range(1, 1001) b(i), range(1, 10001) k(i) WHERE k.i <= ceil(n / 20.0)),
g AS (SELECT dr.run_id, boot, sum(z.s - a.s) AS s, sum(z.q - a.q) AS q, count(*) * 20 AS m FROM dr JOIN pre a ON a.run_id = dr.run_id AND a.i = dr.i JOIN pre z ON z.run_id = dr.run_id AND z.i = dr.i + 20 GROUP BY 1, 2),
h AS (SELECT run_id, s / m * sqrt(2190.0) / nullif(sqrt(greatest(q / m - (s / m) ** 2, 0)), 0) AS sharpe FROM g) SELECT run_id, round(quantile_cont(sharpe, 0.025), 6) AS low, round(quantile_cont(sharpe, 0.975), 6) AS high FROM h GROUP BY 1""")
def bootstrap_sharpe(s, d):
    return r6(N.bootstrap_sharpe(pnl(s, d)), "low", "high")


@query("deflated_sharpe")
def deflated_sharpe(s, d):
    return N.deflated_sharpe(pnl(s, d), trials=10)


@query("value_distribution", f"WITH {BARRIER_SQL} SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM tbl GROUP BY 1")
def value_distribution(s, d):
    c = barriers(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return r6(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())), "share")


@query("close_matrix", f"WITH {S.B4} SELECT ts, max(close) FILTER (symbol = 'click') AS click, max(close) FILTER (symbol = 'error') AS error, max(close) FILTER (symbol = 'view') AS view FROM b4 WHERE symbol IN ('click', 'error', 'view') GROUP BY 1")
def close_matrix(s, d):
    names = ["click", "error", "view"]
    return M.bars_4h(s, d).where(F.col("symbol").isin(names)).groupBy("ts").pivot("symbol", names).agg(F.max_by("close", "ts"))
