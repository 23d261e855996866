"""Queries over the whole risk stack: costs, regimes, gated sizing, breaker flags, overlay and books under a breaker."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions import rolling as R
from ..operators import decisions as D
from ..operators import portfolio as P
from ..operators.bars import ewma
from ..sources import market as M
from . import base_sql as S
from .book import BARRIER_SQL, barriers, pnl, w
from .market import PIT_SQL, ewma_sql, pit_table
from .registry import SQL, query, r6

SOFT = "greatest(0.02, coalesce(1.5 * typical, 0))"
CLUSTERS = {"click": "majors", "view": "majors", "error": "rest", "purchase": "rest", "signup": "rest"}


def clusters(s):
    return s.createDataFrame(list(CLUSTERS.items()), "symbol string, cluster string")


def returns(s, d):
    """(symbol, ts, ret) of the traded prices."""
    return M.bars_4h(s, d).select("symbol", "ts", (F.try_divide(F.col("close") + 1000, F.lag(F.col("close") + 1000).over(R.series("symbol", "ts"))) - 1).alias("ret"))


def known_drawdowns(s, d):
    """(run_id, ts, drawdown) as known before each bar."""
    b = P.breaker(pnl(s, d).select("run_id", "ts", "ret"))
    return b.select("run_id", "ts", F.coalesce(F.lag("drawdown").over(P.by_run()), F.lit(0.0)).alias("drawdown"))


@query("full_overlay", f"""WITH {S.WEIGHTS}, {S.pnl_of('weights')}, {S.breaker_of('', SOFT)}, dds AS (SELECT run_id, ts, coalesce(lag(dd) OVER (PARTITION BY run_id ORDER BY ts), 0) AS dd FROM cb),
x AS (SELECT run_id, symbol, ts, w * 2 AS w, CASE WHEN symbol IN ('click', 'view') THEN 'majors' ELSE 'rest' END AS cluster FROM weights),
rt AS (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM weights WHERE run_id = 'lag1'), fu AS (SELECT symbol, ts, count(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 89 PRECEDING) = 90 AS full_ FROM rt),
act AS (SELECT x.* FROM x JOIN fu USING (symbol, ts) WHERE abs(w) > 1e-12 AND full_),
pc AS (SELECT a.ts, a.symbol AS s1, b.symbol AS s2, CASE WHEN count(*) OVER v = 90 THEN abs(corr(a.ret, b.ret) OVER v) END AS c FROM rt a JOIN rt b ON a.ts = b.ts AND a.symbol <> b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL WINDOW v AS (PARTITION BY a.symbol, b.symbol ORDER BY a.ts ROWS 89 PRECEDING)),
hc AS (SELECT p.run_id, p.ts, p.symbol, avg(c) AS c FROM act p JOIN act q ON p.run_id = q.run_id AND p.ts = q.ts AND p.symbol <> q.symbol JOIN pc ON pc.ts = p.ts AND s1 = p.symbol AND s2 = q.symbol GROUP BY 1, 2, 3),
a1 AS (SELECT x.*, hc.symbol IS NOT NULL AS used, x.w / (1 + 0.5 * greatest(0, coalesce(c, 0) - 0.3) / 0.7) AS w1 FROM x LEFT JOIN hc USING (run_id, ts, symbol)),
a2 AS (SELECT *, w1 / greatest(1, sum(abs(w1)) OVER (PARTITION BY run_id, ts, cluster) / 0.5) AS w2 FROM a1), a3 AS (SELECT *, w2 / greatest(1, sum(abs(w2)) OVER (PARTITION BY run_id, ts)) AS w3 FROM a2),
tm AS (SELECT ts, row_number() OVER (ORDER BY ts) AS bar FROM (SELECT DISTINCT ts FROM rt)), rb AS (SELECT symbol, ret, bar FROM rt JOIN tm USING (ts)), ub AS (SELECT a3.*, bar FROM a3 JOIN tm USING (ts) WHERE used),
q AS (SELECT ub.run_id, ub.ts, rb.bar, sum(w3 * ret) AS v, count(*) FILTER (ret IS NULL) AS holes FROM ub JOIN rb ON rb.symbol = ub.symbol AND rb.bar BETWEEN ub.bar - 89 AND ub.bar GROUP BY 1, 2, 3), pv AS (SELECT run_id, ts, sqrt(var_samp(v) * 2190) AS pv FROM q WHERE holes = 0 GROUP BY 1, 2)
SELECT run_id, ts, symbol, round(least(greatest(w3 * CASE WHEN pv > 0.25 THEN least(1, 0.25 / pv) ELSE 1 END * least(greatest((0.2 - coalesce(dd, 0)) / 0.1, 0), 1), -0.25), 0.25), 5)::DOUBLE AS w FROM a3 LEFT JOIN pv USING (run_id, ts) LEFT JOIN dds USING (run_id, ts)""")
def full_overlay(s, d):
    x = w(s, d).withColumn("w", F.col("w") * 2)
    out = P.full_overlay(x, clusters(s), returns(s, d), known_drawdowns(s, d))
    return out.withColumn("w", F.round("w", 5))


@query("panel_breaker", f"WITH {S.WEIGHTS}, {S.pnl_of('weights')}, {S.breaker_of('')} SELECT run_id, ts, symbol, close, round(w * coalesce(multiplier, 1), 5) AS w FROM weights LEFT JOIN cb USING (run_id, ts)")
def panel_breaker(s, d):
    return P.under_breaker(w(s, d), mean_days=None).select("run_id", "ts", "symbol", "close", F.round("w", 5).alias("w"))


DIRECTIONAL_SQL = f"""{S.WEIGHTS}, d1 AS (SELECT run_id, symbol, ts, close, least(greatest(w * 3, -0.25), 0.25) AS w FROM weights), d2 AS (SELECT *, sum(w) OVER t AS net, count(*) OVER t AS n FROM d1 WINDOW t AS (PARTITION BY run_id, ts)),
d3 AS (SELECT run_id, symbol, ts, close, w - greatest(abs(net) - 0.5, 0) * sign(net) / n AS w FROM d2), d4 AS (SELECT run_id, symbol, ts, close, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts)) AS w FROM d3), {S.pnl_of('d4', 'a_')},
rv AS (SELECT run_id, stddev_samp(ret) * sqrt(2190.0) AS rv FROM a_pnl GROUP BY 1), d5 AS (SELECT run_id, symbol, ts, close, w * CASE WHEN rv > 1e-9 THEN least(0.25 / rv, 3) ELSE 1 END AS w FROM d4 JOIN rv USING (run_id))"""


@query("directional_book", f"WITH {DIRECTIONAL_SQL} SELECT run_id, symbol, ts, round(w, 5) AS w, true AS uses_full_sample FROM d5")
def directional_book(s, d):
    """Convictions three times the weights, so that all limits bind."""
    return D.directional(w(s, d).withColumn("w", F.col("w") * 3), net_cap=0.5).drop("close").withColumn("w", F.round("w", 5))


@query("directional_backtest", f"WITH {DIRECTIONAL_SQL}, {S.pnl_of('d5', 'b_')}, {S.breaker_of('b_')}, d6 AS (SELECT d5.run_id, symbol, ts, close, w * coalesce(multiplier, 1) AS w FROM d5 LEFT JOIN b_cb USING (run_id, ts)), {S.pnl_of('d6', 'c_')} SELECT run_id, ts, round(turnover, 5) AS turnover, round(ret, 6) AS ret FROM c_pnl")
def directional_backtest(s, d):
    """The book under its own breaker, and what it earns."""
    book = D.directional(w(s, d).withColumn("w", F.col("w") * 3), net_cap=0.5).drop("uses_full_sample")
    return P.pnl(P.under_breaker(book, mean_days=None)).select("run_id", "ts", F.round("turnover", 5).alias("turnover"), F.round("ret", 6).alias("ret"))


@query("breaker_on_returns", f"WITH {S.WEIGHTS}, {S.pnl_of('weights')}, {S.breaker_of('', SOFT)} SELECT run_id, ts, round(pnl.ret * coalesce(lag(multiplier) OVER (PARTITION BY run_id ORDER BY ts), 1), 6) AS ret FROM pnl JOIN cb USING (run_id, ts)")
def breaker_on_returns(s, d):
    return r6(D.breaker_returns(pnl(s, d).select("run_id", "ts", "ret")), "ret")


@query("breaker_reasons", f"""WITH {S.WEIGHTS}, {S.pnl_of('weights')}, {S.breaker_of('', SOFT)}, f AS (SELECT cb.*, hour(ts) <> 20 OR day(ts) % 9 <> 0 AS con, turnover < 2 AS rec, day(ts) = 17 AS kill FROM cb JOIN pnl USING (run_id, ts))
SELECT run_id, ts, greatest(level, CASE WHEN NOT con OR kill THEN 3 WHEN NOT rec THEN 2 ELSE 0 END)::INT AS level, CASE WHEN r = '' THEN 'ok' ELSE r END AS reason FROM (SELECT *, concat_ws(',', CASE WHEN NOT con THEN 'connection_anomaly' END, CASE WHEN NOT rec THEN 'reconciliation_drift' END, CASE WHEN kill THEN 'kill_switch' END,
  CASE WHEN dd > 0.3 THEN 'drawdown>30%' WHEN dd > 0.25 THEN 'drawdown>25%' WHEN dd > 0.2 THEN 'drawdown>20%' END, CASE WHEN loss > 3 * soft THEN 'daily_loss>hard' WHEN loss > soft THEN 'daily_loss>soft' END) AS r FROM f)""")
def breaker_reasons(s, d):
    """Levels with operating flags; the flags are made of the bars' times and turnover, so that each occurs."""
    p = pnl(s, d)
    x = P.breaker(p.select("run_id", "ts", "ret")).join(p.select("run_id", "ts", "turnover"), ["run_id", "ts"])
    flags = ((F.hour("ts") != 20) | (F.dayofmonth("ts") % 9 != 0), F.col("turnover") < 2, F.dayofmonth("ts") == 17)
    return x.select("run_id", "ts", risk.breaker_flags(F.col("level"), *flags).alias("level"), risk.breaker_reason(F.col("drawdown"), F.col("daily_loss"), F.col("soft"), *flags).alias("reason"))


@query("risk_decisions", f"""WITH {PIT_SQL}, {S.SIGNALS.split('), signals AS (', 1)[1] and 'signals AS (' + S.SIGNALS.split('signals AS (', 1)[1]}, {S.WEIGHTS.split('sg AS (', 1)[1] and 'sg AS (' + S.WEIGHTS.split('sg AS (', 1)[1]}, {S.pnl_of('weights')}, {S.breaker_of('', SOFT)},
x AS (SELECT symbol, decision_time, ts, ret_24h AS alpha, 1 / (1 + exp(-2 * ret_24h)) AS meta, vol_96h AS vol, ret_96h AS fc, 1 - (funding_rate IS NULL)::INT * 0.5 AS dq, range_pct AS width FROM pit2),
y AS (SELECT x.*, coalesce(level, 0)::INT AS lv, (dq + CASE WHEN fc IS NULL OR alpha = 0 OR sign(fc) = sign(alpha) THEN 1 ELSE 0.5 END + abs(coalesce(meta, 0.5) - 0.5) * 2) / 3.0 AS conf FROM x LEFT JOIN (SELECT ts, level FROM cb WHERE run_id = 'lag1') b USING (ts)),
z AS (SELECT *, least(greatest(0.25 * least(greatest((meta - 0.55) / 0.2, 0), 1) * sign(alpha) * CASE WHEN vol * sqrt(2190.0) > 1e-12 THEN least(0.3 / (vol * sqrt(2190.0)), 3) ELSE 0 END * least(1, conf / 0.8), -0.25), 0.25) AS size, coalesce(nullif(width, 0), 0.02) AS bw, alpha IS NULL OR alpha = 0 OR meta IS NULL AS none_ FROM y),
v AS (SELECT *, coalesce(size, 0) * CASE WHEN lv >= 3 THEN 0 WHEN lv = 2 THEN 0.5 ELSE 1 END AS pos, NOT none_ AND meta <= 0.55 AS low_ FROM z), u AS (SELECT *, abs(pos) > 1e-9 AND NOT none_ AND NOT low_ AS ok FROM v)
SELECT symbol, decision_time, round(CASE WHEN ok THEN pos ELSE 0 END, 6)::DOUBLE AS position, ok AS approved, CASE WHEN none_ THEN 'none' WHEN low_ THEN 'low' WHEN ok THEN 'medium' ELSE 'blocked' END AS risk_level,
  round(CASE WHEN none_ OR low_ THEN 0 ELSE 1.5 * bw END, 6)::DOUBLE AS stop_loss, round(CASE WHEN none_ OR low_ THEN 0 ELSE 1.5 * bw END, 6)::DOUBLE AS take_profit, CASE WHEN none_ THEN 'flat_or_no_meta' WHEN low_ THEN 'below_threshold' WHEN ok THEN 'edge' ELSE 'blocked cb=' || lv END AS reason FROM u""")
def risk_decisions(s, d):
    """Gated sizes with forecasts, a calibrated probability and the breaker of the running book."""
    level = P.breaker(pnl(s, d).where("run_id = 'lag1'").select("run_id", "ts", "ret")).select("ts", "level")
    x = pit_table(s, d).join(level, "ts", "left").withColumns({"alpha": F.col("ret_24h"), "meta": 1 / (1 + F.exp(-2 * F.col("ret_24h"))), "dq": 1 - F.col("funding_rate").isNull().cast("int") * 0.5, "level": F.coalesce("level", F.lit(0))})
    sure = risk.confidence(F.col("dq"), F.col("alpha"), F.col("ret_96h"), F.col("meta"))
    out = x.select("symbol", "decision_time", risk.decided(F.col("alpha"), F.col("meta"), F.col("vol_96h"), sure, F.col("level"), F.col("range_pct")).alias("x"))
    return r6(out.select("symbol", "decision_time", "x.*"), "position", "stop_loss", "take_profit")


@query("gated_funnel", f"""WITH rd AS ({SQL['risk_decisions']}) SELECT count(*) AS n_rows, count(*) FILTER (reason = 'flat_or_no_meta') AS flat_or_no_meta, count(*) FILTER (reason = 'below_threshold') AS meta_gated, count(*) FILTER (reason LIKE 'blocked%') AS zero_size,
 count(*) FILTER (approved) AS approved_intents, count(DISTINCT decision_time) AS times, count(DISTINCT decision_time) FILTER (approved) AS times_held FROM rd""")
def gated_funnel(s, d):
    return D.gated_funnel(risk_decisions(s, d))


@query("decision_contract", f"""WITH rd AS ({SQL['risk_decisions']}), x AS (SELECT CASE WHEN day(decision_time) <> 8 THEN symbol END AS symbol, decision_time, coalesce(CASE WHEN day(decision_time) = 5 THEN 1.5 WHEN day(decision_time) <> 6 THEN position END, 0) AS p, CASE WHEN day(decision_time) = 7 THEN 'sell everything' WHEN position > 0 THEN 'open_long' WHEN position < 0 THEN 'open_short' ELSE 'flat' END AS action, approved FROM rd),
y AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE day(decision_time) = 9) SELECT 'position' AS "check", count(*) FILTER (abs(p) > 1) AS violations FROM y UNION ALL SELECT 'action', count(*) FILTER (action = 'sell everything') FROM y UNION ALL SELECT 'key', count(*) FILTER (symbol IS NULL) FROM y
UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM y GROUP BY symbol, decision_time HAVING count(*) > 1) UNION ALL SELECT 'loaded', count(*) FILTER (approved AND symbol IS NOT NULL) FROM y""")
def decision_contract(s, d):
    """Decisions as an agent would hand them in (as text, some damaged), validated, checked, and those that load."""
    day = F.dayofmonth("decision_time")
    x = risk_decisions(s, d).select(
        F.when(day != 8, F.col("symbol")).alias("symbol"), F.col("decision_time").cast("string").alias("decision_time"), F.lit("agent").alias("agent_name"),
        F.when(day == 7, "sell everything").when(F.col("position") > 0, "open_long").when(F.col("position") < 0, "open_short").otherwise("flat").alias("action"),
        F.when(day == 5, "1.5").when(day == 6, "none").otherwise(F.col("position").cast("string")).alias("target_position"), F.lit("x").alias("signal_score"), F.lit("7").alias("confidence"), F.col("approved").cast("string").alias("risk_approved"),
        "reason", F.lit("{}").alias("audit_log"), F.col("decision_time").cast("string").alias("created_at"),
    )
    x = D.validated(x.unionByName(x.where(F.dayofmonth(F.col("decision_time").cast("timestamp")) == 9)))
    return D.violations(x).union(D.loaded(x).agg(F.lit("loaded").alias("check"), F.count(F.lit(1)).alias("n")))


@query("regime_flags", f"""WITH {PIT_SQL}, z AS (SELECT symbol, decision_time, vol_96h AS v, CASE WHEN count(ret_24h) OVER w >= 6 THEN (ret_24h - avg(ret_24h) OVER w) / (stddev_samp(ret_24h) OVER w + 1e-12) END AS m, CASE WHEN count(funding_rate) OVER w >= 10 THEN (funding_rate - avg(funding_rate) OVER w) / (stddev_samp(funding_rate) OVER w + 1e-12) END AS f FROM pit2 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING))
SELECT symbol, decision_time, CASE WHEN abs(f) > 2 THEN 'funding_overheated' WHEN v IS NULL OR m IS NULL THEN 'range_bound' WHEN v > 1.0 AND m > 0.5 THEN 'high_volatility_uptrend' WHEN v > 1.0 AND m < -0.5 THEN 'panic_selloff' WHEN m > 0.5 THEN 'low_volatility_uptrend' WHEN m < -0.5 THEN 'low_volatility_downtrend' ELSE 'range_bound' END AS regime FROM z""")
def regime_flags(s, d):
    """Ticks' prices are as volatile as they are made, so the volatility that counts as high is set for them."""
    by = R.series("symbol", "ts")
    x = pit_table(s, d).withColumns({"m": R.zscore("ret_24h", by, 30, 6), "f": R.zscore("funding_rate", by, 30, 10)})
    return x.select("symbol", "decision_time", risk.regime(F.col("vol_96h"), F.col("m"), F.col("f"), high=1.0).alias("regime"))


_OVERLAY = SQL["full_overlay"].replace("x AS (SELECT run_id, symbol, ts, w * 2 AS w,", "x AS (SELECT 'lag1' AS run_id, symbol, decision_time - INTERVAL 241 MINUTE AS ts, position AS w,").replace("ELSE 'rest' END AS cluster FROM weights)", "ELSE 'rest' END AS cluster FROM rd)")
SETTINGS = {"target_vol": 0.3, "threshold": 0.55, "most": 0.25}


@query("portfolio_decisions", f"""WITH rd AS MATERIALIZED ({SQL['risk_decisions']}), ov AS MATERIALIZED ({_OVERLAY}), rg AS MATERIALIZED ({SQL['regime_flags']}), la AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY decision_time DESC) = 1)
SELECT la.symbol, la.decision_time, rg.regime, CASE WHEN approved AND abs(ov.w) > 1e-9 THEN CASE WHEN ov.w > 0 THEN 'long' ELSE 'short' END ELSE 'flat' END AS action, round(CASE WHEN approved THEN ov.w ELSE 0 END, 4)::DOUBLE AS target_position, round(position, 4) AS target_position_pre_portfolio,
 round(stop_loss, 4) AS stop_loss, round(take_profit, 4) AS take_profit, risk_level, reason, substr(sha256(la.symbol || '|' || strftime(la.decision_time, '%Y-%m-%dT%H:%M:%S') || '|oof|bars|v1|most=0.25,target_vol=0.3,threshold=0.55'), 1, 16) AS audit_id
FROM la JOIN ov ON ov.symbol = la.symbol AND ov.ts = la.decision_time - INTERVAL 241 MINUTE JOIN rg ON rg.symbol = la.symbol AND rg.decision_time = la.decision_time""")
def portfolio_decisions(s, d):
    """The current book: the newest decision of each symbol, sized, gated, after the overlay, as structured rows."""
    x = risk_decisions(s, d).withColumn("ts", F.col("decision_time") - F.expr("interval 241 minutes"))
    newest = x.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("decision_time")))).where("n = 1").drop("n")
    # the overlay of a time needs all its positions, so whole times are taken
    at = x.join(newest.select("ts").distinct(), "ts", "left_semi").select(F.lit("lag1").alias("run_id"), "ts", "symbol", F.lit(None).cast("double").alias("close"), F.col("position").alias("w"))
    after = P.full_overlay(at, clusters(s), returns(s, d), known_drawdowns(s, d)).select("symbol", "ts", F.round("w", 5).alias("w"))
    out = newest.join(after, ["symbol", "ts"]).join(regime_flags(s, d), ["symbol", "decision_time"])
    held = F.col("approved") & (F.abs("w") > 1e-9)
    return out.select(
        "symbol", "decision_time", "regime", F.when(held, F.when(F.col("w") > 0, "long").otherwise("short")).otherwise("flat").alias("action"), F.round(F.when(F.col("approved"), F.col("w")).otherwise(0.0), 4).alias("target_position"),
        F.round("position", 4).alias("target_position_pre_portfolio"), F.round("stop_loss", 4).alias("stop_loss"), F.round("take_profit", 4).alias("take_profit"), "risk_level", "reason",
        D.audit_id(F.col("symbol"), F.col("decision_time"), "oof", "bars", "v1", SETTINGS).alias("audit_id"),
    )


@query("depth_slippage", f"""WITH {S.B4}, x AS (SELECT symbol, ts, close, volume, quantile_cont(volume, 0.5) OVER w AS med, count(volume) OVER w AS n, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4 WINDOW w AS (PARTITION BY symbol, hour(ts) ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
y AS (SELECT *, CASE WHEN n >= 10 THEN 0.1 * med END AS depth, CASE WHEN count(ret) OVER f >= 6 THEN stddev_samp(ret) OVER f * 1e4 END AS fast, CASE WHEN count(ret) OVER g >= 42 THEN stddev_samp(ret) OVER g * 1e4 END AS slow FROM x WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING), g AS (PARTITION BY symbol ORDER BY ts ROWS 41 PRECEDING)),
z AS (SELECT *, 3 + coalesce(CASE WHEN slow > 0 THEN 2 * greatest(0, (fast - slow) / slow) ELSE 0 END, 0) + 10 * CASE WHEN depth > 0 THEN volume * 0.01 / depth ELSE 1 END AS bps FROM y)
SELECT symbol, ts, round(depth, 6)::DOUBLE AS depth, round(bps, 6)::DOUBLE AS slippage_bps, NOT coalesce(depth > 0 AND volume * 0.01 <= 0.1 * depth, false) AS large_order, round(close * (1 + bps / 1e4), 6) AS buy_price, round(close * (1 - bps / 1e4), 6) AS sell_price FROM z""")
def depth_slippage(s, d):
    """An order of a hundredth of each bar's volume: depth, cost, whether it is to be sliced, and the prices that it gets."""
    by = R.series("symbol", "ts")
    past = Window.partitionBy("symbol", F.hour("ts")).orderBy(F.unix_timestamp("ts")).rangeBetween(-30 * 86400, -1)
    x = M.bars_4h(s, d).select("symbol", "ts", "close", (F.col("volume") * 0.01).alias("order"), F.when(F.count("volume").over(past) >= 10, 0.1 * F.percentile("volume", F.lit(0.5)).over(past)).alias("depth"), R.pct_change("close", by).alias("ret"))
    x = x.withColumns({"fast": R.roll(F.stddev_samp, "ret", by, 6) * 1e4, "slow": R.roll(F.stddev_samp, "ret", by, 42) * 1e4})
    x = x.withColumn("slippage_bps", risk.slippage_bps(F.col("fast"), F.col("slow"), F.col("order"), F.col("depth")))
    price = lambda is_long: risk.executable_price(F.col("close"), F.lit(is_long), F.lit(True), F.col("slippage_bps"))
    return r6(x.select("symbol", "ts", "depth", "slippage_bps", risk.large_order(F.col("order"), F.col("depth")).alias("large_order"), price(True).alias("buy_price"), price(False).alias("sell_price")), "depth", "slippage_bps", "buy_price", "sell_price")


@query("net_returns", f"WITH {BARRIER_SQL} SELECT symbol, decision_time, round(raw_long - rates - 2 * (4 + 1 + 3 + 10 * width) / 1e4, 6) AS net_long, round(-raw_long + rates - 2 * (4 + 1 + 3 + 10 * width) / 1e4, 6) AS net_short, round(-rates, 9) AS funding_long FROM tbl")
def net_returns(s, d):
    """Both sides' returns after signed funding and costs whose impact grows with the barrier's width."""
    impact = 3 + 10 * F.col("width")
    x = barriers(s, d)
    return x.select("symbol", "decision_time", F.round(risk.net_return(F.col("raw_long"), -F.col("rates"), impact=impact), 6).alias("net_long"), F.round(risk.net_return(F.col("raw_short"), F.col("rates"), impact=impact), 6).alias("net_short"), F.round(-F.col("rates"), 9).alias("funding_long"))


A = 2 / (6 + 1)
NEUTRAL_SQL = f"""{S.WEIGHTS}, cv AS (SELECT run_id || '/' || symbol AS k, ts, w FROM weights), {ewma_sql('cv', 'k', 'ts', {'e': ('w', A)})}, n0 AS (SELECT split_part(k, '/', 1) AS run_id, split_part(k, '/', 2) AS symbol, ts, e AS w FROM ew),
n1 AS (SELECT run_id, symbol, ts, w - avg(w) OVER (PARTITION BY run_id, ts) AS w FROM n0), n2 AS (SELECT run_id, symbol, ts, CASE WHEN sum(abs(w)) OVER t > 1e-12 THEN w / sum(abs(w)) OVER t ELSE 0 END AS w FROM n1 WINDOW t AS (PARTITION BY run_id, ts)),
n3 AS (SELECT run_id, symbol, ts, least(greatest(w, -0.25), 0.25) AS w FROM n2), n4 AS (SELECT run_id, symbol, ts, w - avg(w) OVER (PARTITION BY run_id, ts) AS w, CASE WHEN symbol IN ('click', 'view') THEN 'majors' ELSE 'rest' END AS c FROM n3),
n5 AS (SELECT run_id, symbol, ts, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts, c) / 0.3) AS w FROM n4), n6 AS (SELECT run_id, symbol, ts, w / greatest(1, sum(abs(w)) OVER (PARTITION BY run_id, ts)) AS w FROM n5),
n7 AS (SELECT run_id, symbol, ts, least(greatest(w, -0.25), 0.25) AS w FROM n6), n8 AS (SELECT run_id || '/' || symbol AS k, ts, w - avg(w) OVER (PARTITION BY run_id, ts) AS w FROM n7), {ewma_sql('n8', 'k', 'ts', {'e': ('w', A)}).replace('rn AS', 'rn2 AS').replace('ew AS', 'ew2 AS').replace(' rn ', ' rn2 ').replace(' ew ', ' ew2 ')},
n9 AS (SELECT split_part(k, '/', 1) AS run_id, split_part(k, '/', 2) AS symbol, ts, e AS w FROM ew2)"""


@query("neutral_book", f"WITH RECURSIVE {NEUTRAL_SQL} SELECT run_id, symbol, ts, round(w - avg(w) OVER (PARTITION BY run_id, ts), 5) AS w FROM n9")
def neutral_book(s, d):
    """Smoothed convictions, the neutral stack with clusters that bind, smoothed again and demeaned."""
    key = F.concat_ws("/", "run_id", "symbol")
    apart = lambda x: x.select(F.split_part("k", F.lit("/"), F.lit(1)).alias("run_id"), F.split_part("k", F.lit("/"), F.lit(2)).alias("symbol"), "ts", "w")
    smooth = lambda x: apart(ewma(x.select(key.alias("k"), "ts", F.col("w").alias("x")), "k", "ts", {"w": ("x", A)}))
    x = smooth(D.neutral_stack(smooth(w(s, d)), clusters(s), cluster_cap=0.3))
    return x.withColumn("w", F.round(F.col("w") - F.avg("w").over(Window.partitionBy("run_id", "ts")), 5))
