"""Queries over scans of long tables, payloads, model inputs, latest rows and rolling diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import statistics as N
from ..operators.bars import right_edge
from ..sources import market as M
from ..operators import cleaning as C
from ..sources import commit, contract, payloads, scan
from ..sources.stage import folder
from . import base_sql as S
from .market import PIT_SQL, pit_table
from .registry import QUERIES, SQL, query, r6

query("long_table_scan", f"SELECT symbol, ts, close FROM ({SQL['multi_tf_rollup']}) WHERE timeframe = '4h' AND symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")(
    lambda s, d: scan.scan_long(QUERIES["multi_tf_rollup"](s, d), ["click", "view"], "2024-01-05", "2024-01-20", "4h", ["symbol", "ts", "close"])
)

query("funding_range_scan", f"""WITH {S.FUNDING} SELECT symbol, "timestamp", funding_rate FROM funding WHERE symbol = 'error' AND "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-09'""")(
    lambda s, d: scan.scan_long(scan.required(M.funding(s, d), ["symbol", "timestamp", "funding_rate"]), ["error"], "2024-01-03", "2024-01-09", columns=["symbol", "timestamp", "funding_rate"])
)

query("dated_table_scan", "WITH m AS (SELECT date_trunc('day', l_shipdate) AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1) SELECT * FROM m WHERE day >= TIMESTAMP '2000-01-01' AND day < TIMESTAMP '2001-01-01'")(
    lambda s, d: scan.scan_long(M.daily_metric(s, d), start="2000-01-01", end="2001-01-01").select("day", F.round("value", 2).alias("value"))
)


@query("feed_items", r"""SELECT doc_id, nullif(trim(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 ]', '', 'g')), '') AS title, 'https://news.example/' || doc_id AS link, strftime(to_timestamp(1704067200 + doc_id * 420), '%Y-%m-%dT%H:%M:%SZ') AS published FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL""")
def feed_items(s, d):
    """Articles as feeds, RSS for even ids and Atom for odd ones, and read back."""
    title = F.regexp_replace("title", "[^A-Za-z0-9 ]", "")
    at, link = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("https://news.example/"), "doc_id")
    rss = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), at, F.lit("</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), title, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><updated>'), at, F.lit("</updated></entry></feed>"))
    feeds = M.news(s, d).where("body is not null and doc_id is not null").select("doc_id", F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return payloads.feed_rows(feeds, "xml", ["doc_id"]).select("doc_id", F.nullif(F.trim("title"), F.lit("")).alias("title"), "link", "published")


@query("json_row_payloads", "SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def json_row_payloads(s, d):
    """Events as JSON rows whose numbers are strings, some of them no numbers."""
    value = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = M.table(s, d, "events").select(F.to_json(F.struct("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), value.alias("value"))).alias("j"))
    out = payloads.json_rows(rows, "j", "event_id long, us long, value string", ["value"])
    return out.select("event_id", F.timestamp_micros("us").alias("ts"), "value")


@query("model_inputs", f"WITH {PIT_SQL} SELECT symbol, decision_time, round(coalesce(vol_96h, range_pct), 6) AS vol, round(ret_24h, 6) AS momentum, funding_rate AS funding FROM pit2 WHERE coalesce(vol_96h, range_pct) IS NOT NULL AND ret_24h IS NOT NULL AND funding_rate IS NOT NULL")
def model_inputs(s, d):
    x = scan.model_inputs(pit_table(s, d), ["symbol", "decision_time"], {"vol": ["vol_30d", "vol_96h", "range_pct"], "momentum": ["mom_z", "ret_24h"], "funding": ["funding_rate"]})
    return r6(x, "vol", "momentum")


@query("latest_bars", f"WITH {S.B4} SELECT symbol, ts, close FROM b4 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5")
def latest_bars(s, d):
    """The tail of each symbol: its five newest bars, in order."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return M.bars_4h(s, d).select("symbol", "ts", "close").withColumn("n", n).where("n <= 5").drop("n").orderBy("symbol", "ts")


@query("rolling_pair_corr", f"""WITH {S.B4}, x AS (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4), p AS (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.ret AS r1, y.ret AS r2 FROM x JOIN x y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
SELECT a, b, ts, round(CASE WHEN count(*) OVER w = 30 THEN corr(r1, r2) OVER w END, 5) AS corr, round(CASE WHEN count(*) OVER w = 30 THEN covar_samp(r1, r2) OVER w END, 5) AS cov FROM p WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS 29 PRECEDING)""")
def rolling_pair_corr(s, d):
    x = M.bars_4h(s, d).select("symbol", "ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret"))
    return N.rolling_pairs(x, 30).select("a", "b", "ts", F.round("corr", 5).alias("corr"), F.round("cov", 5).alias("cov"))


@query("news_volatility", f"""WITH {S.B4}, n AS (SELECT time_bucket(INTERVAL 4 HOUR, to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP) + INTERVAL 4 HOUR AS ts, avg(length(text))::DOUBLE AS risk FROM documents GROUP BY 1), r AS (SELECT ts, avg(abs(ret)) AS a FROM (SELECT ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b4) GROUP BY 1),
v AS (SELECT ts, CASE WHEN count(a) OVER w = 6 THEN avg(a) OVER w END AS vol FROM r WINDOW w AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)), x AS (SELECT n.ts, risk, vol FROM n JOIN v USING (ts) WHERE risk IS NOT NULL AND vol IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0 AS a, rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2.0 AS b FROM x) SELECT round(corr(a, b), 6) AS ic, count(*) AS n FROM k""")
def news_volatility(s, d):
    """Whether much news (mean length of a bin's articles) goes before volatile markets: rank correlation with the next day's mean absolute return."""
    return r6(N.rank_ic(news_and_volatility(s, d), ["k"], "risk", "vol").select("ic", "n"), "ic")


def news_and_volatility(s, d):
    risk = M.news(s, d).groupBy(right_edge("published_at", M.FOUR_HOURS).alias("ts")).agg(F.avg(F.length("body")).alias("risk"))
    a = M.bars_4h(s, d).select("ts", R.pct_change("close", R.series("symbol", "ts")).alias("ret")).groupBy("ts").agg(F.avg(F.abs("ret")).alias("a"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(1, 6)  # one row a time
    return risk.join(a.select("ts", R.gated(F.avg("a").over(ahead), "a", ahead, 6).alias("vol")), "ts").withColumn("k", F.lit(0))


_RISK_SQL = SQL["news_volatility"].split("SELECT round(corr(a, b)")[0]


@query("news_volatility_hac", f"""{_RISK_SQL.replace('k AS (SELECT rank()', 'k AS (SELECT ts, rank()')}, z AS (SELECT row_number() OVER (ORDER BY ts) AS i, (a - avg(a) OVER ()) / stddev_pop(a) OVER () * (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS p FROM k), e AS (SELECT i, p, p - avg(p) OVER () AS e FROM z)
SELECT round(m, 6) AS ic, n, round(m / sqrt(greatest((g0 + 2 * gl) / n, 1e-18) / n), 5) AS t_stat FROM (SELECT avg(p) AS m, count(*) AS n, sum(e * e) AS g0 FROM e), (SELECT sum((1 - (x.i - y.i) / 7.0) * x.e * y.e) AS gl FROM e x JOIN e y ON x.i - y.i BETWEEN 1 AND 6)""")
def news_volatility_hac(s, d):
    """The same diagnostic with the HAC t of its rank correlation."""
    x = news_and_volatility(s, d)
    return N.hac_ic(x, "k", "ts", "risk", "vol", 6).select(F.round("ic", 6).alias("ic"), "n", F.round("t_stat", 5).alias("t_stat"))


@query("committed_table", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders")
def committed_table(s, d):
    """Orders by status: written, one status replaced, a write that dies half way, and what readers see then."""
    root = folder(s, "orders")
    x = M.table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    commit.commit(x, root, by=("o_orderstatus",))
    commit.commit(x.where("o_orderstatus = 'F'").withColumn("price", F.round(F.col("price") * 2, 2)), root, by=("o_orderstatus",))
    try:
        commit.commit(commit.failing(x.withColumn("price", F.lit(-1.0)), F.col("o_orderstatus") == "O"), root, by=("o_orderstatus",))
    except Exception as e:  # the drill's own error
        if "stopped half way" not in str(e):
            raise
    return commit.table(s, root)


@query("detected_time_scan", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def detected_time_scan(s, d):
    """A table whose time column has no usual name: found by its type."""
    return scan.scan_long(M.table(s, d, "orders"), start="1997-01-01", end="1998-01-01", columns=["o_orderkey", "o_orderdate", "o_totalprice"])


@query("feature_view", f"WITH {PIT_SQL} SELECT symbol, decision_time, round(ret_4h, 6) AS ret_4h, funding_rate FROM pit2 WHERE symbol IN ('click', 'view') AND decision_time >= TIMESTAMP '2024-01-05' AND decision_time <= TIMESTAMP '2024-01-20'")
def feature_view(s, d):
    return r6(contract.feature_view(pit_table(s, d), ["click", "view"], "2024-01-05", "2024-01-20", ["ret_4h", "funding_rate"]), "ret_4h")


@query("strict_features", f"WITH {PIT_SQL} SELECT symbol, decision_time, max_feature_available_time FROM pit2")
def strict_features(s, d):
    """The feature table under its contract: no label among the columns, no row newer than its decision."""
    x = contract.features(pit_table(s, d).drop("max_feature_available_time"))
    return contract.strict(x).select("symbol", "decision_time", "max_feature_available_time")


_SAMPLED = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("column_samples", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) AS n_rows, count({c}) AS n_non_null, round(100 * (1 - count({c}) / count(*)), 6)::DOUBLE AS missing_pct, min({c}::VARCHAR) AS sample FROM events""" for c, k in _SAMPLED.items() if k not in ("double", "timestamp_ntz")))
def column_samples(s, d):
    """Every column but times and doubles, whose text differs between engines."""
    return r6(contract.described(M.table(s, d, "events").select(*(c for c, k in _SAMPLED.items() if k not in ("double", "timestamp_ntz")))), "missing_pct")


@query("market_names", """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) || '/USDT' WHEN 2 THEN event_type || '-usdt' ELSE upper(event_type) || 'USDT' END AS name FROM events), y AS (SELECT event_id, name, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS p FROM x), z AS (SELECT *, CASE WHEN p LIKE '_%USDT' THEN p ELSE p || 'USDT' END AS pair FROM y)
SELECT event_id, pair, regexp_replace(pair, 'USDT$', '') AS base, regexp_replace(pair, 'USDT$', '') || '/USDT' AS slashed, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM z""")
def market_names(s, d):
    """Names of markets in four spellings, and all of them back in each form."""
    t, up = F.col("event_type"), F.upper("event_type")
    name = F.get(F.array(t, F.concat(up, F.lit("/USDT")), F.concat(t, F.lit("-usdt")), F.concat(up, F.lit("USDT"))), (F.col("event_id") % 4).cast("int"))
    x = M.table(s, d, "events").select("event_id", name.alias("name"))
    return x.select("event_id", contract.pair(F.col("name")).alias("pair"), contract.base(F.col("name")).alias("base"), contract.slashed(F.col("name")).alias("slashed"), contract.slug(F.col("name")).alias("slug"))


@query("row_quality_pit", f"WITH {PIT_SQL}, x AS (SELECT symbol, decision_time, ret_4h, vol_96h, CASE WHEN hour(ts) = 8 THEN decision_time + INTERVAL 1 SECOND ELSE max_feature_available_time END AS seen FROM pit2) SELECT g.symbol, g.decision_time, CASE WHEN x.symbol IS NULL OR seen > x.decision_time THEN 0 ELSE round(1 - ((ret_4h IS NULL)::INT + (vol_96h IS NULL)::INT) / 2.0, 6) END::DOUBLE AS data_quality FROM (SELECT symbol, decision_time FROM pit2 UNION ALL SELECT 'missing', decision_time FROM pit2 WHERE symbol = 'click') g LEFT JOIN x ON x.symbol = g.symbol AND x.decision_time = g.decision_time")
def row_quality_pit(s, d):
    """Quality of the rows asked for: 0 for those that are missing or have a feature newer than the decision (made so at one hour)."""
    x = pit_table(s, d).select("symbol", "decision_time", "ret_4h", "vol_96h", F.when(F.hour("ts") == 8, F.col("decision_time") + F.expr("interval 1 second")).otherwise(F.col("max_feature_available_time")).alias("at"))
    asked = x.select("symbol", "decision_time").unionByName(x.where("symbol = 'click'").select(F.lit("missing").alias("symbol"), "decision_time"))
    out = asked.join(x.withColumn("found", F.lit(True)), ["symbol", "decision_time"], "left")
    return r6(out.select("symbol", "decision_time", C.row_quality(["ret_4h", "vol_96h"], F.col("found").isNotNull(), F.col("at") > F.col("decision_time")).alias("data_quality")), "data_quality")


@query("funding_report", """WITH f AS (SELECT event_type AS symbol, ts, (value - 50) / 1e5 AS rate, event_id FROM events), l AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY event_id) AS before FROM f)
SELECT 'rows' AS "check", count(*) AS violations FROM f UNION ALL SELECT 'null_symbol', count(*) FILTER (symbol IS NULL) FROM f UNION ALL SELECT 'null_timestamp', count(*) FILTER (ts IS NULL) FROM f UNION ALL SELECT 'null_funding_rate', count(*) FILTER (rate IS NULL) FROM f
UNION ALL SELECT 'not_finite_funding_rate', count(*) FILTER (NOT isfinite(rate)) FROM f UNION ALL SELECT 'not_in_order', count(*) FILTER (ts <= before) FROM l UNION ALL SELECT 'repeated_key', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM f GROUP BY symbol, ts HAVING count(*) > 1)""")
def funding_report(s, d):
    """Checks of a long table: nulls, infinities, repeated keys, and times that do not rise in the order of arrival."""
    return C.long_report(M.funding(s, d), ["symbol", "timestamp"], ["funding_rate"], "seq")
