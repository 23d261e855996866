"""Queries over pages and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import rules
from ..operators import text as T
from ..sources import market as M
from .registry import query, r6


def pages(s, d):
    return M.table(s, d, "pages")


def _plain(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '<script\\b.*?</script>', ' ', 'gis'), '<style\\b.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"


def _entities(x: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("html_strip", f"SELECT page_id, {_squeezed(_entities(_plain('html')))} AS text FROM pages")
def html_strip(s, d):
    return pages(s, d).select("page_id", T.clean_text(F.col("html")).alias("text"))


@query("article_meta", f"""SELECT page_id, nullif({_squeezed(_entities(_plain("regexp_extract(html, '<h1\\b[^>]*>(.*?)</h1>', 1, 'is')")))}, '') AS heading, regexp_extract(html, '<html\\b[^>]*lang="([^"]*)"', 1, 'i') AS lang,
  nullif(regexp_extract(url, '^\\w+://([^/?#]+)', 1), '') AS host, regexp_extract(url, '^\\w+://[^/]+/([^/?#]+)', 1) AS section FROM pages""")
def article_meta(s, d):
    """Title, language, host and section, by the fallbacks that these pages exercise: named meta, then heading, then address."""
    x = pages(s, d)
    named = T.meta_content(F.col("html"), ["og:title", "twitter:title"])
    heading = F.coalesce(F.nullif(named, F.lit("")), T.clean_text(F.get(T.blocks(F.col("html"), "h1"), F.lit(0))))
    return x.select("page_id", heading.alias("heading"), F.regexp_extract("html", r'(?i)<html\b[^>]*lang="([^"]*)"', 1).alias("lang"), F.try_parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("url", r"^\w+://[^/]+/([^/?#]+)", 1).alias("section"))


BODY_SQL = f"""WITH a AS (SELECT page_id, regexp_extract(html, '<article\\b[^>]*>(.*?)</article>', 1, 'is') AS art FROM pages),
p AS (SELECT page_id, [x FOR x IN [{_squeezed(_plain('b'))} FOR b IN regexp_extract_all(art, '<p\\b[^>]*>(.*?)</p>', 1, 'is')] IF length(x) >= 25 AND NOT regexp_matches(lower(x), 'subscribe|sign up|cookie|advertisement')] AS ps FROM a)
SELECT page_id, nullif(array_to_string(ps, chr(10) || chr(10)), '') AS body FROM p"""


@query("article_body", f"WITH q AS ({BODY_SQL}) SELECT page_id, coalesce(length(body), 0)::INT AS body_char_count, coalesce(len(regexp_extract_all(body, '\\S+')), 0)::INT AS body_word_count, sha256(body) AS body_hash, CASE WHEN body IS NULL THEN 'missing_body' ELSE 'ok' END AS status FROM q")
def article_body(s, d):
    x = pages(s, d).select("page_id", T.article_body(F.col("html")).alias("body"))
    return x.select("page_id", F.coalesce(F.length("body"), F.lit(0)).alias("body_char_count"), F.coalesce(F.regexp_count("body", F.lit(r"\S+")), F.lit(0)).alias("body_word_count"), F.sha2("body", 256).alias("body_hash"), F.when(F.col("body").isNull(), "missing_body").otherwise("ok").alias("status"))


@query("page_status", f"""WITH t AS (SELECT page_id, lower({_squeezed(_plain('html'))}) AS t, lower({_squeezed(_plain("regexp_extract(html, '<title\\b[^>]*>(.*?)</title>', 1, 'is')"))}) AS ti FROM pages)
SELECT page_id, CASE WHEN regexp_matches(ti, 'page not found|not found|404') OR (regexp_matches(t, 'page not found|not found|404') AND (length(t) < 1500 OR regexp_matches(t, 'cloudflare|akamai|fastly|nginx|waf|http 404|error 404|status code 404'))) THEN 'http_404'
  WHEN regexp_matches(ti, 'access denied|forbidden') OR (regexp_matches(t, 'access denied|forbidden') AND (length(t) < 1500 OR regexp_matches(t, 'cloudflare|akamai|fastly|nginx|waf|http 40[13]|error 40[13]|status code 40[13]'))) THEN 'access_denied'
  WHEN regexp_matches(ti, 'too many requests|rate limited|rate limit exceeded') OR (regexp_matches(t, 'too many requests|rate limited|rate limit exceeded') AND (length(t) < 1500 OR regexp_matches(t, 'cloudflare|akamai|fastly|nginx|waf|http 429|error 429|status code 429'))) THEN 'rate_limited'
  WHEN regexp_matches(t, 'redirected you too many times|redirect too many times') THEN 'cookie_redirect_loop' WHEN t LIKE '%checking your browser%' AND t LIKE '%cloudflare%' THEN 'cloudflare_challenge' ELSE 'ok' END AS status FROM t""")
def page_status(s, d):
    x = pages(s, d).select("page_id", F.lower(T.squeezed(T.without_markup(F.col("html")))).alias("t"), F.lower(T.squeezed(T.without_markup(F.get(T.blocks(F.col("html"), "title"), F.lit(0))))).alias("ti"))
    return x.select("page_id", T.page_status(F.col("t"), F.col("ti")).alias("status"))


@query("link_extract", f"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is'), 1) - 1 AS place FROM pages),
h AS (SELECT *, regexp_extract(a, 'href="([^"]*)"', 1, 'i') AS href FROM a)
SELECT page_id, place::INT AS place, href, CASE WHEN regexp_matches(href, '^\\w+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^(\\w+://[^/]+)', 1) || href ELSE regexp_replace(base, '[^/]*$', '') || href END AS url, {_squeezed(_plain("regexp_extract(a, '<a\\b[^>]*>(.*?)</a>', 1, 'is')"))} AS title FROM h""")
def link_extract(s, d):
    return T.links(pages(s, d), "html", "url", ["page_id"])


#: Names of assets.
ASSETS = {"BTC": ["BTC", "Bitcoin"], "ETH": ["ETH", "Ether", "Ethereum"], "SOL": ["SOL", "Solana"], "BNB": ["BNB", "Binance Coin"], "XRP": ["XRP", "Ripple"], "LINK": ["LINK", "Chainlink"]}

#: The given articles are invented words, so the tag query also looks for words that they have.
WORDS = ASSETS | {"THE": ["the"], "QUE": ["que", "qui"], "DER": ["der", "die", "das"]}


@query("asset_tags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])({'|'.join(a)})($|[^A-Za-z0-9])') THEN '{n}' END" for n, a in WORDS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def asset_tags(s, d):
    return M.table(s, d, "documents").select("doc_id", F.array_join(T.tags(F.col("text"), WORDS), ",").alias("tags"))


def _any_sql(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _count_sql(t: str, words: list[str]) -> str:
    return " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) / {len(w)}" for w in words)


def _kind_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(t, k)} THEN '{n}'" for n, k in rules.EVENTS.items()) + " ELSE 'none' END"


def extraction_sql(source: str, text: str) -> str:
    """The keyword rules over the column `text` of the table `source`."""
    names = sorted({(w, n) for w, n in rules.TICKERS.items()})
    found = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}' END" for w, n in names) + "], lambda x: x IS NOT NULL)))"
    themes = "list_filter([" + ", ".join(f"CASE WHEN {_any_sql('t', k)} THEN '{n}' END" for n, k in sorted(rules.THEMES.items())) + "], lambda x: x IS NOT NULL)"
    return f"""SELECT * EXCLUDE (t, th), CASE WHEN len(th) > 0 THEN th ELSE ['none'] END AS themes, CASE WHEN event_type IN ('hack', 'delisting', 'regulation', 'etf') THEN 0.7 WHEN event_type <> 'none' THEN 0.4 ELSE 0.1 END::DOUBLE AS severity FROM (
  SELECT *, {_kind_sql('t')} AS event_type, {found} AS entities, {themes} AS th, least(greatest(0.15 * (({_count_sql('t', rules.GOOD)}) - ({_count_sql('t', rules.BAD)})), -1), 1)::DOUBLE AS sentiment, {_any_sql('t', rules.RUMOUR)} AS is_rumor
  FROM (SELECT *, coalesce(lower({text}), '') AS t FROM {source}))"""


@query("keyword_events", f"SELECT doc_id, event_type, array_to_string(entities, ',') AS entities, array_to_string(themes, ',') AS themes, round(sentiment, 6) AS sentiment, severity, is_rumor FROM ({extraction_sql('documents', 'text')})")
def keyword_events(s, d):
    x = T.keyword_extraction(M.table(s, d, "documents").select("doc_id", "text"), "text", rules)
    return r6(x.select("doc_id", "event_type", F.array_join("entities", ",").alias("entities"), F.array_join("themes", ",").alias("themes"), "sentiment", "severity", "is_rumor"), "sentiment")


@query("consistency_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS c, sum(value) AS s FROM events GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n, sum(s) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM c)
SELECT user_id, event_type, round(c / n, 6)::DOUBLE AS agreement, round(t / n, 9)::DOUBLE AS value, n::BIGINT AS n FROM r WHERE k = 1""")
def consistency_vote(s, d):
    return r6(T.consensus(M.table(s, d, "events"), "user_id", "event_type", "value"), "agreement").withColumn("value", F.round("value", 9))


@query("score_distinct", "SELECT doc_id, sha256(text) AS body_hash, coalesce(length(text), 0)::DOUBLE AS score FROM documents")
def score_distinct(s, d):
    """The scorer is the user's; here the length of the whole body. Articles of one source fill the cache that the others use."""
    x = M.news(s, d)
    _, cache = T.score_distinct(x.where("source = 'src1'"), "body", T.length_scorer, "key string, score double")
    rows, _ = T.score_distinct(x, "body", T.length_scorer, "key string, score double", cache)
    return rows.select("doc_id", F.sha2("body", 256).alias("body_hash"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query("content_hashes", "SELECT doc_id, sha1(coalesce(split_part(text, chr(10), 1), '') || chr(10) || coalesce(text, '')) AS content_key, sha256(text) AS body_hash, sha1(split_part(text, chr(10), 1)) AS title_key FROM documents")
def content_hashes(s, d):
    x = M.news(s, d)
    return x.select("doc_id", F.sha1(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))).alias("content_key"), F.sha2("body", 256).alias("body_hash"), F.sha1("title").alias("title_key"))


@query("news_corpus", "SELECT text_key AS body_hash, doc_id, n FROM (SELECT sha256(text) AS text_key, max(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def news_corpus(s, d):
    """One article a body, the newest; how many there were."""
    x = M.news(s, d).where("body is not null").withColumn("body_hash", F.sha2("body", 256))
    newest = C.keep_one(x.select("body_hash", "doc_id", "published_at"), ["body_hash"], ["published_at", "doc_id"])
    return newest.join(x.groupBy("body_hash").agg(F.count(F.lit(1)).alias("n")), "body_hash").select("body_hash", "doc_id", "n")


@query("resume_set", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_set(s, d):
    return M.table(s, d, "documents").select("doc_id").join(M.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("url_parts", r"SELECT page_id, nullif(regexp_extract(url, '^\w+://([^/?#]+)', 1), '') AS host, regexp_extract(url, '^\w+://[^/]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number FROM pages")
def url_parts(s, d):
    part = lambda p: F.try_parse_url("url", F.lit(p))
    return pages(s, d).select("page_id", part("HOST").alias("host"), F.coalesce(part("PATH"), F.lit("")).alias("path"), part("QUERY").alias("query"), F.expr("try_cast(nullif(regexp_extract(url, '/(\\\\d+)', 1), '') AS bigint)").alias("number"))
