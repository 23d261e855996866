"""Wide tables: news factors, every source as of each decision, cross-sectional columns, and the supervised data set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof as J
from ..operators import bars as B
from ..operators import cleaning as C
from ..operators import labels as L
from ..operators import rules
from ..operators import text as T
from ..sources import market as M
from ..sources.stage import staged
from . import market as K
from .book import BARRIER_SQL, barriers
from .news import _kind_sql, extraction_sql
from .registry import SQL, query, r6

#: The market that articles of a language are about, where they name none.
MARKETS = {"en": "click", "de": "view", "fr": "error", "es": "purchase"}
THEMES = ["etf", "regulation", "defi", "l2", "ai"]
FACTORS = {"event_alpha": ("a", 3), "event_risk": ("r", 2), "rumor_risk": ("u", 2), **{f"theme_{t}": (f"t_{t}", 5) for t in THEMES}}
RATES = {n: (x, 1 - 2 ** (-1 / (days * 6))) for n, (x, days) in FACTORS.items()}
_MARKET_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKETS.items()) + " END"
_AT = "to_timestamp(1704067200 + doc_id * 420)::TIMESTAMP"

EVENTS_SQL = f"""ex AS ({extraction_sql('documents', 'text')}), c AS (SELECT {_AT} AS moment, list_distinct(list_filter(list_concat(entities, [{_MARKET_SQL}]), lambda x: x IS NOT NULL)) AS es, sentiment * severity * 0.6 * CASE WHEN {_kind_sql("lower(split_part(text, chr(10), 1))")} = event_type THEN 1 ELSE 0.5 END * (NOT is_rumor)::INT AS a,
  CASE WHEN event_type IN ('hack', 'delisting', 'regulation') THEN severity ELSE 0 END AS r, is_rumor::INT AS u, {', '.join(f"list_contains(themes, '{t}')::INT AS t_{t}" for t in THEMES)} FROM ex WHERE doc_id IS NOT NULL),
o AS (SELECT unnest(es) AS symbol, * EXCLUDE (es) FROM c), bn AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, moment) + INTERVAL 4 HOUR AS bin, avg(a) AS a, max(r) AS r, avg(u) AS u, {', '.join(f'avg(t_{t}) AS t_{t}' for t in THEMES)} FROM o GROUP BY 1, 2),
cal AS (SELECT symbol, unnest(generate_series(min(bin), max(bin), INTERVAL 4 HOUR)) AS bin FROM bn GROUP BY 1), g AS (SELECT symbol, bin, {', '.join(f'coalesce({x}, 0)::DOUBLE AS {x}' for x, _ in FACTORS.values())} FROM cal LEFT JOIN bn USING (symbol, bin)), {K.ewma_sql('g', 'symbol', 'bin', RATES)}"""


@query("event_factors", f"WITH RECURSIVE {EVENTS_SQL} SELECT symbol, bin, {', '.join(f'round({n}, 6) AS {n}' for n in FACTORS)} FROM ew")
def event_factors(s, d):
    """Eight smoothed factors by market from keyword extractions; consistency is 1 where title and whole text give one kind of event, else one half."""
    x = T.keyword_extraction(M.news(s, d).where("doc_id is not null"), "body", rules)
    same = F.when(T.first_kind(F.coalesce(F.lower("title"), F.lit("")), rules.EVENTS) == F.col("event_type"), 1.0).otherwise(0.5)
    own = F.create_map(*(F.lit(v) for pair in MARKETS.items() for v in pair))
    x = x.select(
        F.explode(F.array_distinct(F.array_compact(F.concat("entities", F.array(F.try_element_at(own, F.col("lang"))))))).alias("symbol"), B.right_edge("published_at", M.FOUR_HOURS).alias("bin"),
        (F.col("sentiment") * F.col("severity") * rules.CREDIBILITY * same * (~F.col("is_rumor")).cast("int")).alias("a"), F.when(F.col("event_type").isin(*rules.RISKS), F.col("severity")).otherwise(0.0).alias("r"),
        F.col("is_rumor").cast("int").alias("u"), *(F.array_contains("themes", t).cast("int").alias(f"t_{t}") for t in THEMES),
    )
    binned = x.groupBy("symbol", "bin").agg(F.max("r").alias("r"), *(F.avg(c).alias(c) for c, _ in FACTORS.values() if c != "r"))
    return r6(B.ewma(B.on_grid(binned, "4 hours", [c for c, _ in FACTORS.values()]), "symbol", "bin", RATES).select("symbol", "bin", *FACTORS), *FACTORS)


#: name -> (registered query, time it is available at as Spark and SQL expressions of its columns, columns taken)
SOURCES = {
    "funding": ("funding_features", '"timestamp" + INTERVAL 1 MINUTE', lambda: J.shifted(F.col("timestamp"), 60), ["rate_8h", "rate_change", "rate_z"]),
    "oi": ("open_interest_features", "oi_time + INTERVAL 1 MINUTE", lambda: J.shifted(F.col("oi_time"), 60), ["oi_change", "oi_z"]),
    "short": ("short_horizon_1h", "available", lambda: F.col("available"), K.SHORT_1H),
    "regime": ("regime_1d_features", "ts + INTERVAL 1 DAY + INTERVAL 30 SECOND", lambda: J.shifted(F.col("ts"), 86430), [*K.REGIME, "daily_trend_up"]),
    "cvd": ("cvd", "ts + INTERVAL 4 HOUR + INTERVAL 30 SECOND", lambda: J.shifted(F.col("ts"), 14430), ["delta", "cvd", "delta_z"]),
    "basis": ("spot_perp_basis", "availability_ts", lambda: F.col("availability_ts"), ["premium_bps", "premium_change", "premium_z"]),
    "event": ("event_factors", "bin", lambda: F.col("bin"), list(FACTORS)),
}
CHAIN = ["base_chg_1d", "base_chg_7d", "base_z_30d"]
VERSION = "pit-2"
XS = ["xs_demean_ret_24h", "xs_rank_ret_24h", "xs_demean_ret_7d", "ret_vs_base_24h", "xs_demean_vol_30d"]


def all_columns() -> list[str]:
    return [*K.FEATURES, *(c for _, _, _, cs in SOURCES.values() for c in cs), *CHAIN]


def _full_sql() -> str:
    news = SQL["news_ewma"].replace("SELECT lang AS symbol,", f"SELECT {_MARKET_SQL} AS symbol,")
    subs = "".join(f", q_{n} AS (SELECT symbol AS s_{n}, {at} AS {n}_available, {', '.join(cs)} FROM ({SQL[q]}))" for n, (q, at, _, cs) in SOURCES.items())
    joins = " ".join(f"ASOF LEFT JOIN q_{n} ON m.symbol = s_{n} AND m.decision_time >= {n}_available" for n in SOURCES)
    return f"""m AS ({SQL['market_4h_features']}){subs}, q_news AS (SELECT symbol AS s_news, bin AS news_available, sent_fast, sent_slow, sent_momentum, log_count FROM ({news})),
q_chain AS (SELECT ts + INTERVAL {K.SHIFT_YEARS} SECOND + INTERVAL 1 DAY AS chain_available, {', '.join(CHAIN)} FROM ({SQL['onchain_factors']})),
full0 AS MATERIALIZED (SELECT m.*, {', '.join(f'{n}_available, ' + ', '.join(cs) for n, (_, _, _, cs) in SOURCES.items())}, news_available, sent_fast, sent_slow, sent_momentum, log_count, chain_available, {', '.join(CHAIN)} FROM m {joins} ASOF LEFT JOIN q_news ON m.symbol = s_news AND m.decision_time >= news_available ASOF LEFT JOIN q_chain ON m.decision_time >= chain_available),
fullt AS (SELECT *, greatest(ts + INTERVAL 4 HOUR + INTERVAL 30 SECOND, {', '.join(f'{n}_available' for n in [*SOURCES, 'news', 'chain'])}) AS max_feature_available_time, '{VERSION}' AS feature_version FROM full0)"""


SENT = ["sent_fast", "sent_slow", "sent_momentum", "log_count"]


def full_table(s, d):
    """Eight keyed sources in one union and one window, the chain's daily factors by time: every feature as known at each decision."""
    from .registry import QUERIES

    base = QUERIES["market_4h_features"](s, d).withColumn("availability_ts", J.shifted(F.col("ts"), M.FOUR_HOURS + 30))
    sources = [(QUERIES[q](s, d).withColumn(f"{n}_available", at()).select("symbol", f"{n}_available", *cs), f"{n}_available", cs, None) for n, (q, _, at, cs) in SOURCES.items()]
    own = F.create_map(*(F.lit(v) for pair in MARKETS.items() for v in pair))
    news = QUERIES["news_ewma"](s, d).select(F.try_element_at(own, F.col("symbol")).alias("symbol"), F.col("bin").alias("news_available"), *SENT).where("symbol is not null")
    x = J.asof_many(base, ["symbol"], "decision_time", [*sources, (news, "news_available", SENT, None)], bucket_s=30 * 86400)
    chain = QUERIES["onchain_factors"](s, d).select(J.shifted(F.col("ts"), K.SHIFT_YEARS + 86400).alias("chain_available"), *CHAIN)
    x = J.asof_global(x, chain, "decision_time", "chain_available", CHAIN)
    latest = F.greatest("availability_ts", *(f"{n}_available" for n in [*SOURCES, "news", "chain"]))
    return x.withColumns({"max_feature_available_time": latest, "feature_version": F.lit(VERSION)}).drop("availability_ts")


def with_relative(x):
    """Five columns of a symbol against the others at the same time; 0 where there is nothing to compare."""
    at = Window.partitionBy("decision_time")
    less = lambda c: F.col(c) - F.avg(c).over(at)
    base = F.max(F.when(F.col("symbol") == "click", F.col("ret_24h"))).over(at)
    return x.withColumns({
        XS[0]: less("ret_24h"), XS[1]: R.average_rank("ret_24h", ["decision_time"]) / F.count("ret_24h").over(at) - 0.5, XS[2]: less("ret_7d"), XS[3]: F.col("ret_24h") - base, XS[4]: less("vol_30d"),
    }).fillna(0.0, XS)


def _relative_sql(source: str) -> str:
    return f"""rel0 AS MATERIALIZED (SELECT *, ret_24h - avg(ret_24h) OVER t AS d0, rank() OVER (PARTITION BY decision_time ORDER BY ret_24h NULLS LAST) + (count(*) OVER (PARTITION BY decision_time, ret_24h) - 1) / 2.0 AS rk, count(ret_24h) OVER t AS rn_, ret_7d - avg(ret_7d) OVER t AS d2, ret_24h - max(ret_24h) FILTER (symbol = 'click') OVER t AS d3, vol_30d - avg(vol_30d) OVER t AS d4
  FROM {source} WINDOW t AS (PARTITION BY decision_time)), rel AS (SELECT * EXCLUDE (d0, rk, rn_, d2, d3, d4), round(coalesce(d0, 0), 6) AS {XS[0]}, round(coalesce(CASE WHEN ret_24h IS NOT NULL THEN rk / rn_ - 0.5 END, 0), 6)::DOUBLE AS {XS[1]}, round(coalesce(d2, 0), 6) AS {XS[2]}, round(coalesce(d3, 0), 6) AS {XS[3]}, round(coalesce(d4, 0), 6) AS {XS[4]} FROM rel0)"""


@query("full_feature_table", f"WITH {_full_sql()} SELECT * FROM fullt")
def full_feature_table(s, d):
    return full_table(s, d)


@query("xs_features", f"WITH {_full_sql()}, {_relative_sql('fullt')} SELECT symbol, decision_time, {', '.join(XS)} FROM rel")
def xs_features(s, d):
    return r6(with_relative(full_table(s, d)).select("symbol", "decision_time", *XS), *XS)


MODALITIES = {"market": [*K.FEATURES, *K.SHORT_1H, *K.REGIME, *XS], "flow": ["rate_z", "oi_z", "delta_z", "premium_z"], "onchain": CHAIN, "narrative": SENT, "event": list(FACTORS)}
_COMPLETE = [*K.FEATURES, "vol_24h", "ret_7d"]
_KEPT = ["ret_4h", "ret_24h", "vol_96h", "volume_z", "rate_z", "oi_z", "delta_z", "premium_z", "ret_7d", "vol_30d", *CHAIN, "sent_fast", "event_alpha", *XS]


def data_set(s, d):
    """Features, labels and weights of every decision that is complete.

    Unknown chain, news and event factors are 0 (nothing known is nothing seen); a row without a market feature goes. A
    decision has one label: a repeated key on either side is an error.
    """
    x = with_relative(full_table(s, d)).fillna(0.0, [*CHAIN, *SENT, *FACTORS]).dropna(subset=_COMPLETE)
    y = staged(barriers(s, d).select("symbol", "decision_time", F.col("entry_time").alias("t0"), F.col("exit_time").alias("t1"), "label", "raw_long", "net_long", "net_short"))  # read several times
    return C.joined_once(x, L.uniqueness(y, "symbol", "t0", "t1"), ["symbol", "decision_time"])


def modal_data_set(s, d):
    """(data set with the temporal embedding and forecasts, columns by modality that it has); decisions before the first window have zeros there."""
    from .learning import HORIZONS, temporal

    names = [f"forecast_{h}" for h in HORIZONS]
    t = temporal(s, d).select("symbol", "decision_time", *names, *(F.element_at("embedding", i).alias(f"e{i}") for i in (1, 2, 3, 4)))
    extra = [*names, "e1", "e2", "e3", "e4"]
    x = data_set(s, d).join(t, ["symbol", "decision_time"], "left").fillna(0.0, extra)
    return x, {m: [c for c in cols if c in x.columns] for m, cols in (MODALITIES | {"temporal": extra}).items()}


@query("modal_rows")
def modal_rows(s, d):
    """Each decision with its modalities as vectors, as learners take them; the temporal model has no SQL. The sign of an embedding's component is arbitrary, so its absolute value is returned."""
    x, lists = modal_data_set(s, d)
    value = lambda c: F.round(F.abs(F.col(c)) if c in ("e1", "e2", "e3", "e4") else F.col(c).cast("double"), 6)
    return x.select("symbol", "decision_time", "label", *(F.array(*map(value, cols)).alias(m) for m, cols in lists.items()))


_MODAL = {m: [c for c in cols if c not in XS] for m, cols in MODALITIES.items()}


@query("modality_coverage", f"WITH {_full_sql()} " + " UNION ALL ".join(f"SELECT '{m}' AS modality, {len(cols)}::INT AS n_columns, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in cols)}) AS complete_rows, count(*) AS n_rows FROM fullt" for m, cols in _MODAL.items()))
def modality_coverage(s, d):
    """How many decisions know all columns of a modality."""
    x = full_table(s, d)
    whole = lambda cols: ~F.exists(F.array(*(F.col(c).isNull() for c in cols)), lambda v: v)
    one = x.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*(F.struct(F.lit(m).alias("modality"), F.lit(len(cols)).alias("n_columns"), F.count_if(whole(cols)).alias("complete_rows")) for m, cols in _MODAL.items())).alias("m"))
    return one.select("n_rows", F.explode("m").alias("m")).select("m.modality", "m.n_columns", "m.complete_rows", "n_rows")


@query("market_data_set", f"""WITH {_full_sql()}, {_relative_sql('fullt')}, lab AS MATERIALIZED (SELECT symbol, decision_time, entry_time AS t0, exit_time AS t1, label, raw_long, raw_long - rates - 0.0016 AS net_long FROM (WITH {BARRIER_SQL} SELECT * FROM tbl)),
ev AS (SELECT symbol, t, sum(e) AS e FROM (SELECT symbol, t0 AS t, 1 AS e FROM lab UNION ALL SELECT symbol, t1, -1 FROM lab) GROUP BY 1, 2), st AS (SELECT symbol, unnest(generate_series(min(t0), max(t1), INTERVAL 1 HOUR)) AS t FROM lab GROUP BY symbol),
cc AS (SELECT symbol, t, greatest(1, sum(coalesce(e, 0)) OVER (PARTITION BY symbol ORDER BY t)) AS c FROM st LEFT JOIN ev USING (symbol, t)), pp AS MATERIALIZED (SELECT symbol, t, coalesce(sum(1000000000000 // c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM cc),
wt AS MATERIALIZED (SELECT lab.*, CASE WHEN t1 > t0 THEN (b.p - a.p)::DOUBLE / date_diff('hour', t0, t1) / 1e12 ELSE 1 END AS weight FROM lab JOIN pp a ON a.symbol = lab.symbol AND a.t = t0 JOIN pp b ON b.symbol = lab.symbol AND b.t = t1)
SELECT rel.symbol, rel.decision_time, {', '.join(f'coalesce({c}, 0) AS {c}' if c in [*CHAIN, 'sent_fast', 'event_alpha'] else c for c in _KEPT)}, label, round(raw_long, 6) AS raw_long, round(net_long, 6) AS net_long, round(weight, 6)::DOUBLE AS weight
FROM rel JOIN wt ON wt.symbol = rel.symbol AND wt.decision_time = rel.decision_time WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _COMPLETE)}""")
def market_data_set(s, d):
    x = data_set(s, d)
    return r6(x.select("symbol", "decision_time", *_KEPT, "label", "raw_long", "net_long", F.col("uniqueness").alias("weight")), *XS, "raw_long", "net_long", "weight")
