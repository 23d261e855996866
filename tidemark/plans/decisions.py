"""Queries over decision tables, scans and the remaining statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions import rolling as R
from ..operators import cleaning as C
from ..operators import decisions as D
from ..operators import portfolio as P
from ..operators import rules
from ..operators import statistics as N
from ..operators import text as T
from ..operators.bars import floor_to, right_edge
from ..sources import market as M
from ..sources import scan
from . import base_sql as S
from .book import IC_SQL, forward, intervals, pnl, w, LABELS_SQL
from .market import MARKET_SQL, METRICS, METRICS_SQL, chain_metrics, market_features
from .registry import SQL, query, r6

DEC_SQL = f"""{S.SIGNALS}, rn AS (SELECT symbol, ts, alpha AS s, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM signals),
h AS (SELECT symbol, ts, i, CASE WHEN s > 0.005 THEN 1 WHEN s < -0.005 THEN -1 ELSE 0 END AS p FROM rn WHERE i = 1 UNION ALL SELECT r.symbol, r.ts, r.i,
  CASE WHEN s IS NULL THEN 0 WHEN p = 0 THEN (CASE WHEN s > 0.005 THEN 1 WHEN s < -0.005 THEN -1 ELSE 0 END) WHEN p = 1 THEN (CASE WHEN s < 0 THEN 0 ELSE 1 END) ELSE (CASE WHEN s > 0 THEN 0 ELSE -1 END) END FROM h JOIN rn r ON r.symbol = h.symbol AND r.i = h.i + 1),
q AS (SELECT symbol, ts, p * 0.25::DOUBLE AS pos, coalesce(lag(p) OVER (PARTITION BY symbol ORDER BY ts), 0) AS b, p FROM h),
dec AS (SELECT symbol, ts AS decision_time, pos AS target_position, CASE WHEN b = 0 AND p > 0 THEN 'open_long' WHEN b > 0 AND p > 0 THEN 'hold_long' WHEN b > 0 AND p = 0 THEN 'close_long' WHEN b = 0 AND p < 0 THEN 'open_short' WHEN b < 0 AND p < 0 THEN 'hold_short' WHEN b < 0 AND p = 0 THEN 'close_short' WHEN b = 0 AND p = 0 THEN 'flat' ELSE 'unknown' END AS action,
  symbol || '-' || strftime(ts, '%Y%m%d%H') || '-v1' AS audit_id FROM q)"""


def decisions(s, d):
    return D.reference_decisions(M.signals(s, d).withColumnRenamed("alpha", "score"))


@query("reference_decisions", f"WITH RECURSIVE {DEC_SQL} SELECT * FROM dec")
def reference_decisions(s, d):
    return decisions(s, d).drop("risk_approved")


@query("decision_checks", f"WITH RECURSIVE {DEC_SQL} SELECT 'position' AS \"check\", count(*) FILTER (abs(target_position) > 1) AS violations FROM dec UNION ALL SELECT 'action', count(*) FILTER (action = 'unknown') FROM dec UNION ALL SELECT 'key', count(*) FILTER (symbol IS NULL OR decision_time IS NULL) FROM dec UNION ALL SELECT 'repeated', 0::BIGINT")
def decision_checks(s, d):
    return D.violations(decisions(s, d))


@query("decision_funnel", f"WITH RECURSIVE {DEC_SQL} SELECT count(*) AS n_rows, count(*) FILTER (target_position <> 0) AS n_with_position, count(*) AS n_approved, count(DISTINCT decision_time) FILTER (target_position <> 0) AS n_times FROM dec")
def decision_funnel(s, d):
    return D.funnel(decisions(s, d))


@query("decision_backtest", f"""WITH RECURSIVE {DEC_SQL}, weights AS (SELECT 'decisions' AS run_id, dec.symbol, decision_time AS ts, s.close + 1000 AS close, target_position AS w FROM dec JOIN signals s ON s.symbol = dec.symbol AND s.ts = dec.decision_time),
{S.PNL.split('), wn AS (', 1)[0] and 'wn AS (' + S.PNL.split('wn AS (', 1)[1]} SELECT run_id, ts, round(turnover, 6) AS turnover, round(ret, 6) AS ret, round(nav, 2) AS nav FROM pnl""")
def decision_backtest(s, d):
    x = D.approved(decisions(s, d)).join(M.bars_4h(s, d).select("symbol", F.col("ts").alias("decision_time"), (F.col("close") + 1000).alias("close")), ["symbol", "decision_time"])
    book = x.select(F.lit("decisions").alias("run_id"), F.col("decision_time").alias("ts"), "symbol", "close", F.col("target_position").alias("w"))
    return r6(P.pnl(book).select("run_id", "ts", "turnover", "ret", F.round("nav", 2).alias("nav")), "turnover", "ret")


@query("regime_by_year")
def regime_by_year(s, d):
    x = M.bars_4h(s, d).select("symbol", "ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret")).where("ret is not null")
    return r6(D.regime_by_year(x), "avg_pair_corr", "pc1_share", "xs_dispersion")


@query("common_mode_ic", f"WITH {IC_SQL}, m AS (SELECT ts, avg(alpha) AS a, avg(fwd) AS f FROM fx WHERE alpha IS NOT NULL AND fwd IS NOT NULL GROUP BY 1), r AS (SELECT corr(a, f) AS r, count(*) AS n FROM m) SELECT round(r, 6) AS ic, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_stat FROM r")
def common_mode_ic(s, d):
    m = forward(s, d).where("alpha is not null and fwd is not null").groupBy("ts").agg(F.avg("alpha").alias("a"), F.avg("fwd").alias("f"))
    r = m.agg(N.correlation("a", "f").alias("ic"), F.count(F.lit(1)).alias("n"))
    return r6(r.withColumn("t_stat", F.col("ic") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("ic") * F.col("ic")))), "ic", "t_stat")


@query("event_risk_gate", """WITH x AS (SELECT time_bucket(INTERVAL 4 HOUR, to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP) + INTERVAL 4 HOUR AS ts, avg(CASE WHEN regexp_matches(text, '!!') THEN 1.0 ELSE 0.0 END)::DOUBLE AS nr FROM documents GROUP BY 1),
y AS (SELECT ts, nr, list(nr) OVER w AS v, count(nr) OVER w AS n FROM x WINDOW w AS (ORDER BY ts ROWS 179 PRECEDING))
SELECT ts, round(1 - 0.5 * coalesce(CASE WHEN n >= 5 THEN (len([e FOR e IN v IF e < nr]) + (len([e FOR e IN v IF e = nr]) + 1) / 2.0) / len(v) END, 0.5), 6)::DOUBLE AS multiplier FROM y""")
def event_risk_gate(s, d):
    x = M.table(s, d, "documents").groupBy(right_edge(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420), M.FOUR_HOURS).alias("ts")).agg(F.avg(F.col("text").rlike("!!").cast("double")).alias("nr"))
    rank = R.fraction_rank("nr", Window.partitionBy(F.lit(0)).orderBy("ts"), 180, 5)  # one row a bin
    return r6(x.select("ts", (1 - 0.5 * F.coalesce(rank, F.lit(0.5))).alias("multiplier")), "multiplier")


@query("vol_forward_label", f"""WITH {S.B4}, r AS (SELECT ts, avg(abs(ret)) AS a FROM (SELECT ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4) GROUP BY 1) SELECT ts, round(CASE WHEN count(a) OVER w = 6 THEN avg(a) OVER w END, 6) AS fwd_vol FROM r WINDOW w AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""")
def vol_forward_label(s, d):
    a = M.bars_4h(s, d).select("ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret")).groupBy("ts").agg(F.avg(F.abs("ret")).alias("a"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(1, 6)  # one row a time
    return r6(a.select("ts", R.gated(F.avg("a").over(ahead), "a", ahead, 6).alias("fwd_vol")), "fwd_vol")


@query("complete_panel", f"WITH {S.B4}, t AS (SELECT ts, count(*) AS n FROM b4 GROUP BY 1) SELECT symbol, ts, close FROM b4 JOIN t USING (ts) WHERE n = (SELECT count(DISTINCT symbol) FROM b4)")
def complete_panel(s, d):
    """Rows of the times at which every symbol has a price."""
    b = M.bars_4h(s, d).select("symbol", "ts", "close")
    n = b.agg(F.count_distinct("symbol").alias("k"))  # one row
    return b.withColumn("n", F.count("close").over(Window.partitionBy("ts"))).crossJoin(F.broadcast(n)).where("n = k").select("symbol", "ts", "close")


@query("coverage", f"WITH {MARKET_SQL} SELECT symbol, count(*) AS n, round(avg((vol_96h IS NOT NULL)::INT), 6) AS vol_share, round(avg((ret_96h IS NOT NULL)::INT), 6) AS ret_share, min(decision_time) FILTER (ret_96h IS NOT NULL) AS first_time FROM mf GROUP BY 1")
def coverage(s, d):
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return r6(market_features(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), share("vol_96h").alias("vol_share"), share("ret_96h").alias("ret_share"), F.min(F.when(F.col("ret_96h").isNotNull(), F.col("decision_time"))).alias("first_time")), "vol_share", "ret_share")


@query("unpivot_features", f"WITH {MARKET_SQL} SELECT symbol, decision_time, 'ret_4h' AS feature, round(ret_4h, 6) AS value FROM mf UNION ALL SELECT symbol, decision_time, 'vol_96h', round(vol_96h, 6) FROM mf")
def unpivot_features(s, d):
    return r6(market_features(s, d).unpivot(["symbol", "decision_time"], ["ret_4h", "vol_96h"], "feature", "value"), "value")


@query("dev_holdout", f"WITH {LABELS_SQL}, r AS (SELECT event_id, decision_time, row_number() OVER (ORDER BY decision_time, event_id) - 1 AS i, count(*) OVER () AS n FROM lb), c AS (SELECT decision_time AS cut FROM r WHERE i = floor(n * 0.8)) SELECT event_id, decision_time < cut AS is_dev FROM r, c")
def dev_holdout(s, d):
    """The cut is the decision time at row floor(0.8 n); its place is found in the small table of times."""
    x = intervals(s, d)
    times = x.groupBy("decision_time").agg(F.count(F.lit(1)).alias("c"))
    w_ = Window.partitionBy(F.lit(0)).orderBy("decision_time")
    upto = times.withColumns({"upto": F.sum("c").over(w_), "n": F.sum("c").over(Window.partitionBy(F.lit(0)))})
    cut = upto.where(F.col("upto") > F.floor(F.col("n") * 0.8)).agg(F.min("decision_time").alias("cut"))  # one row
    return x.crossJoin(F.broadcast(cut)).select("event_id", (F.col("decision_time") < F.col("cut")).alias("is_dev"))


@query("features_with_labels", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def features_with_labels(s, d):
    return M.table(s, d, "documents").select("doc_id", "n_chars").join(M.table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("compaction_summary", "SELECT count(*) FILTER (a) AS n_main, count(*) FILTER (b) AS n_parts, count(*) FILTER (b AND NOT a) AS n_new, count(*) FILTER (a AND b) AS n_overlapping FROM (SELECT user_id, event_type, bool_or(event_id % 3 <> 0) AS a, bool_or(event_id % 3 = 0) AS b FROM events GROUP BY 1, 2)")
def compaction_summary(s, d):
    e = M.table(s, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return scan.compaction(e.where("seq % 3 <> 0"), e.where("seq % 3 = 0"), ["user_id", "event_type"], ["seq"])[1]


@query("normalised_symbols", "SELECT event_id, upper(regexp_replace(event_type || '/USDT', '[^A-Za-z0-9]', '', 'g')) AS pair, regexp_replace(upper(event_type), '(USDT|USD)$', '') AS base FROM events")
def normalised_symbols(s, d):
    return M.table(s, d, "events").select("event_id", F.upper(F.regexp_replace(F.concat("event_type", F.lit("/USDT")), "[^A-Za-z0-9]", "")).alias("pair"), F.regexp_replace(F.upper("event_type"), "(USDT|USD)$", "").alias("base"))


@query("coerced_values", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts FROM events")
def coerced_values(s, d):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    time = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    x = M.table(s, d, "events").select("event_id", text.alias("v"), time.alias("t"))
    return x.select("event_id", F.expr("try_cast(v AS double)").alias("value"), F.try_to_timestamp("t").alias("ts"))


@query("coerced_extractions", "SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'none' END AS event_type, least(greatest(value / 50 - 1, -1), 1) AS sentiment, 0.0::DOUBLE AS severity, 0.5::DOUBLE AS confidence FROM events")
def coerced_extractions(s, d):
    x = M.table(s, d, "events").select("event_id", F.upper("event_type").alias("event_type"), (F.col("value") / 50 - 1).alias("sentiment"), F.lit("?").alias("severity"), F.lit(None).cast("string").alias("confidence"))
    return T.coerced(x, ["click", "error"])


@query("article_tags_exploded", "WITH x AS (SELECT doc_id, unnest(string_split(source || ',' || lang, ',')) AS tag FROM documents) SELECT DISTINCT doc_id, trim(tag) AS tag FROM x WHERE trim(tag) <> ''")
def article_tags_exploded(s, d):
    """Loose tag lists to one row an (article, tag)."""
    x = M.table(s, d, "documents").select("doc_id", F.concat_ws(",", "source", "lang").alias("tags"))
    listed = F.coalesce(F.from_json("tags", "array<string>"), F.split("tags", ","))
    return x.select("doc_id", F.explode(listed).alias("tag")).select("doc_id", F.trim("tag").alias("tag")).where("tag <> ''").distinct()


@query("articles_in_range", "SELECT doc_id, to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP AS published_at FROM documents WHERE doc_id IS NULL OR to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02'")
def articles_in_range(s, d):
    """In range, or of unknown date."""
    return M.news(s, d).select("doc_id", "published_at").where(F.col("published_at").isNull() | F.col("published_at").between(F.lit("2024-01-01 06:00:00").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")))


@query("open_interest_features", """WITH x AS (SELECT event_type AS symbol, ts AS oi_time, value * 100 AS oi FROM events), y AS (SELECT *, oi / nullif(lag(oi) OVER (PARTITION BY symbol ORDER BY oi_time), 0) - 1 AS change FROM x)
SELECT symbol, oi_time, round(change, 6) AS oi_change, round(CASE WHEN count(oi) OVER w >= 10 THEN (oi - avg(oi) OVER w) / (stddev_samp(oi) OVER w + 1e-12) END, 6) AS oi_z FROM y WINDOW w AS (PARTITION BY symbol ORDER BY oi_time ROWS 29 PRECEDING)""")
def open_interest_features(s, d):
    by = R.series("symbol", "oi_time")
    x = M.open_interest(s, d)
    return r6(x.select("symbol", "oi_time", R.pct_change("open_interest", by).alias("oi_change"), R.zscore("open_interest", by, 30, 10).alias("oi_z")), "oi_change", "oi_z")


@query("run_comparison", f"""WITH {S.PNL}, n AS (SELECT ts FROM pnl GROUP BY 1 HAVING count(*) = 2), x AS (SELECT run_id, avg(ret) * sqrt(2190.0) / nullif(stddev_samp(ret), 0) AS sharpe, sum(ret) AS total FROM pnl JOIN n USING (ts) GROUP BY 1)
SELECT run_id, round(sharpe, 6) AS sharpe, round(total, 6) AS total, round(sharpe - max(sharpe) FILTER (run_id = 'lag1') OVER (), 6) AS vs_first FROM x""")
def run_comparison(s, d):
    """Runs side by side over the times that all of them have."""
    p = pnl(s, d).select("run_id", "ts", "ret")
    runs = p.agg(F.count_distinct("run_id").alias("k"))  # one row
    x = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).crossJoin(F.broadcast(runs)).where("n = k")
    g = x.groupBy("run_id").agg(F.try_divide(F.avg("ret") * F.sqrt(F.lit(2190.0)), F.stddev_samp("ret")).alias("sharpe"), F.sum("ret").alias("total"))
    return r6(g.withColumn("vs_first", F.col("sharpe") - F.max(F.when(F.col("run_id") == "lag1", F.col("sharpe"))).over(Window.partitionBy())), "sharpe", "total", "vs_first")


@query("equity_risk", f"""WITH {S.PNL}, r AS (SELECT run_id, ts, ret, floor((row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1) / 6)::BIGINT AS d FROM pnl), x AS (SELECT run_id, d, exp(sum(ln(1 + ret))) - 1 AS daily FROM r GROUP BY 1, 2)
SELECT run_id, round(greatest(0, -arg_max(daily, d)), 6)::DOUBLE AS last_loss, round(avg(abs(daily)), 6) AS mean_abs_daily, count(*) AS n_days FROM x GROUP BY 1""")
def equity_risk(s, d):
    day = F.floor((F.row_number().over(P.by_run()) - 1) / 6)
    x = pnl(s, d).withColumn("d", day).groupBy("run_id", "d").agg((F.product(1 + F.col("ret")) - 1).alias("daily"))
    return r6(x.groupBy("run_id").agg(F.greatest(F.lit(0.0), -F.max_by("daily", "d")).alias("last_loss"), F.avg(F.abs("daily")).alias("mean_abs_daily"), F.count(F.lit(1)).alias("n_days")), "last_loss", "mean_abs_daily")


_EXTRACTED = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Hack' WHEN event_id % 3 = 1 THEN event_type END AS event_type, ['btc', 'ETH', 'zzz', 'btc'] AS entities, CASE WHEN event_id % 2 = 0 THEN ['L2', 'etf', 'zoo'] ELSE ['zoo'] END AS themes, value / 50 - 1 AS sentiment, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS severity FROM events"""


@query("coerced_extraction_full", f"""WITH x AS ({_EXTRACTED}) SELECT event_id, CASE WHEN event_type = 'Hack' THEN 'hack' ELSE 'none' END AS event_type, 'BTC,ETH' AS entities, CASE WHEN event_id % 2 = 0 THEN 'etf,l2' ELSE 'none' END AS themes, least(greatest(sentiment, -1), 1) AS sentiment, coalesce(least(greatest(severity, 0), 1), 0) AS severity,
 event_id % 4 = 0 AS is_rumor, 0.5::DOUBLE AS source_credibility, CASE WHEN event_id % 2 = 0 THEN 'weeks' ELSE 'days' END AS horizon, 1.0::DOUBLE AS confidence FROM x""")
def coerced_extraction_full(s, d):
    """Extractions as a model would return them: kinds and names in any case or unknown, numbers out of range, missing or no numbers."""
    i = F.col("event_id")
    x = M.table(s, d, "events").select(
        "event_id", F.when(i % 3 == 0, "Hack").when(i % 3 == 1, F.col("event_type")).alias("event_type"), F.array(*map(F.lit, ("btc", "ETH", "zzz", "btc"))).alias("entities"),
        F.when(i % 2 == 0, F.array(*map(F.lit, ("L2", "etf", "zoo")))).otherwise(F.array(F.lit("zoo"))).alias("themes"), (F.col("value") / 50 - 1).cast("string").alias("sentiment"), F.when(i % 5 != 0, F.col("value").cast("string")).alias("severity"),
        F.when(i % 4 == 0, "true").alias("is_rumor"), F.lit("unsure").alias("source_credibility"), F.when(i % 2 == 0, "weeks").otherwise("years").alias("horizon"), F.lit("7").alias("confidence"),
    )
    out = T.coerced_extraction(x, rules)
    return out.withColumns({"entities": F.array_join("entities", ","), "themes": F.array_join("themes", ",")})


@query("articles_of_unknown_date", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP END AS published, CASE WHEN doc_id % 3 < 2 THEN date_trunc('day', to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP) END AS day FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, published, day FROM x WHERE coalesce(published, day) IS NULL OR coalesce(published, day) BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03 12:00:00'""")
def articles_of_unknown_date(s, d):
    """A third of the articles has a time, a third only a day, a third neither: those are kept."""
    t, i = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 420), F.col("doc_id") % 3
    x = M.table(s, d, "documents").where("doc_id is not null").select("doc_id", F.when(i == 0, t).alias("published"), F.when(i < 2, F.date_trunc("day", t)).alias("day"))
    return T.in_dates(x, "2024-01-02", "2024-01-03 12:00:00", "published", "day")


@query("carried_panel", f"""WITH {S.B4}, h AS (SELECT * FROM b4 WHERE (hour(ts) + length(symbol)) % 3 <> 0), g AS (SELECT t.ts, k.symbol FROM (SELECT DISTINCT ts FROM h) t, (SELECT DISTINCT symbol FROM h) k),
c AS (SELECT g.symbol, g.ts, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume FROM g LEFT JOIN h ON h.symbol = g.symbol AND h.ts = g.ts WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, ts, close, volume FROM c QUALIFY count(*) FILTER (close IS NULL OR volume IS NULL) OVER (PARTITION BY ts) = 0""")
def carried_panel(s, d):
    """Bars of which a third is missing, on all times, carried forward, from where every symbol is known."""
    x = M.bars_4h(s, d).where((F.hour("ts") + F.length("symbol")) % 3 != 0)
    return C.panel(x, "symbol", "ts", ["close", "volume"])


@query("chain_coverage", f"WITH {METRICS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(count({c}) / count(*), 6)::DOUBLE AS share, min(ts) FILTER ({c} IS NOT NULL) AS first_time, max(ts) FILTER ({c} IS NOT NULL) AS last_time FROM m" for c in METRICS))
def chain_coverage(s, d):
    """Rows, share, first and last day of each chain metric."""
    x = chain_metrics(s, d).unpivot(["ts"], list(METRICS), "metric", "value")
    known = F.when(F.col("value").isNotNull(), F.col("ts"))
    return r6(x.groupBy("metric").agg(F.count("value").alias("n"), F.try_divide(F.count("value").cast("double"), F.count(F.lit(1)).cast("double")).alias("share"), F.min(known).alias("first_time"), F.max(known).alias("last_time")), "share")


@query("compact_features", f"""WITH {S.B4}, x AS (SELECT symbol, ts, close / nullif(lag(close, 1) OVER o, 0) - 1 AS ret_1, close / nullif(lag(close, 6) OVER o, 0) - 1 AS ret_6, close / nullif(lag(close, 12) OVER o, 0) - 1 AS m FROM b4 WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(ret_1, 6) AS ret_1, round(ret_6, 6) AS ret_6, round(CASE WHEN count(ret_1) OVER v >= 24 THEN stddev_samp(ret_1) OVER v END, 6) AS vol_24, round(CASE WHEN count(m) OVER z >= 48 THEN (m - avg(m) OVER z) / (stddev_samp(m) OVER z + 1e-9) END, 6) AS mom_z FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING), z AS (PARTITION BY symbol ORDER BY ts ROWS 47 PRECEDING)""")
def compact_features(s, d):
    """The small set: returns over one and six bars, volatility, momentum as a z-score."""
    by = R.series("symbol", "ts")
    x = M.bars_4h(s, d).select("symbol", "ts", *(R.pct_change("close", by, n).alias(c) for c, n in (("ret_1", 1), ("ret_6", 6), ("m", 12))))
    return r6(x.select("symbol", "ts", "ret_1", "ret_6", R.roll(F.stddev_samp, "ret_1", by, 24).alias("vol_24"), R.zscore("m", by, 48, 48, 1e-9).alias("mom_z")), "ret_1", "ret_6", "vol_24", "mom_z")


_DIFF = SQL["newey_west"].replace("FROM pnl)", "FROM (SELECT 'lag2' AS run_id, b.ts, b.ret - a.ret AS ret FROM pnl a JOIN pnl b USING (ts) WHERE a.run_id = 'lag1' AND b.run_id = 'lag2'))")


@query("acceptance_table", f"""WITH au AS ({SQL['pit_audit']}), ec AS ({SQL['ece']}), sh AS ({SQL['run_metrics']}), df AS ({_DIFF}), ic AS ({SQL['xs_ic']}), pb AS ({SQL['pbo']})
SELECT 'no_look_ahead' AS gate, n_look_ahead::DOUBLE AS value, n_look_ahead = 0 AS passed FROM au UNION ALL SELECT 'calibration', ece, ece <= 0.05 FROM ec UNION ALL SELECT 'increment', count(*) FILTER (t_stat > 2)::DOUBLE, count(*) FILTER (t_stat > 2) > 0 FROM df
UNION ALL SELECT 'enriched_features', -2 * t_stat, -2 * t_stat > 0 FROM ic UNION ALL SELECT 'overfitting', pbo, pbo < 0.5 FROM pb UNION ALL SELECT 'beats_baseline', round(b.mean_sharpe - a.mean_sharpe, 6), b.mean_sharpe > a.mean_sharpe FROM sh a, sh b WHERE a.run_id = 'lag1' AND b.run_id = 'lag2'""")
def acceptance_table(s, d):
    """All six gates from their tables: the later run against the earlier one as ladder, a score and its reverse as feature sets."""
    from ..plans.registry import QUERIES

    q = lambda name: QUERIES[name](s, d)
    p = pnl(s, d).select("run_id", "ts", "ret")
    diff = p.where("run_id = 'lag2'").join(p.where("run_id = 'lag1'").select("ts", F.col("ret").alias("base")), "ts").select("run_id", "ts", (F.col("ret") - F.col("base")).alias("ret"))
    t = r6(N.newey_west(diff, "run_id", "ts", "ret", 6), "t_stat").select("run_id", (F.col("t_stat") > 2).alias("included"))
    ladder = q("run_metrics").select("run_id", "mean_sharpe").join(t, "run_id", "left").fillna(False, ["included"])
    ic = q("xs_ic").select("t_stat")
    ablation = ic.select(F.lit("score").alias("run_id"), "t_stat").unionByName(ic.select(F.lit("reversed").alias("run_id"), -F.col("t_stat").alias("t_stat")).toDF("run_id", "t_stat"))
    out = D.acceptance(q("pit_audit"), q("ece"), ladder, ablation, q("pbo"), "lag1", "score", ["reversed"])
    return r6(out, "value")


@query("run_deltas", f"""WITH {S.PNL}, n AS (SELECT ts FROM pnl GROUP BY 1 HAVING count(*) = 2), x AS (SELECT run_id, exp(sum(ln(1 + ret))) - 1 AS total, exp(sum(ln(1 + ret))) ** (2190.0 / count(*)) - 1 AS annual, stddev_samp(ret) * sqrt(2190.0) AS vol, avg(ret) * sqrt(2190.0) / nullif(stddev_samp(ret), 0) AS sharpe FROM pnl JOIN n USING (ts) GROUP BY 1)
SELECT run_id, {', '.join(f"round({c}, 6) AS {c}, round({c} - max({c}) FILTER (run_id = 'lag1') OVER (), 6) AS d_{c}" for c in ('total', 'annual', 'vol', 'sharpe'))} FROM x""")
def run_deltas(s, d):
    """Runs over their common times: compounded total, annual return, volatility, Sharpe, and the difference of each to the first run."""
    p = pnl(s, d).select("run_id", "ts", "ret")
    runs = p.agg(F.count_distinct("run_id").alias("k"))  # one row
    x = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).crossJoin(F.broadcast(runs)).where("n = k")
    root, growth = F.sqrt(F.lit(2190.0)), F.product(1 + F.col("ret"))
    g = x.groupBy("run_id").agg((growth - 1).alias("total"), (F.pow(growth, F.lit(2190.0) / F.count("ret")) - 1).alias("annual"), (F.stddev_samp("ret") * root).alias("vol"), F.try_divide(F.avg("ret") * root, F.stddev_samp("ret")).alias("sharpe"))
    names = ("total", "annual", "vol", "sharpe")
    first = lambda c: F.max(F.when(F.col("run_id") == "lag1", F.col(c))).over(Window.partitionBy())  # one row a run
    return r6(g.select("run_id", *names, *((F.col(c) - first(c)).alias(f"d_{c}") for c in names)), *names, *(f"d_{c}" for c in names))
