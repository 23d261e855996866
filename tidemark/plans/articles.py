"""Queries over article pages, archives and tag lists.

The given pages have neither JSON-LD nor named meta tags nor dates, so these queries write pages of eight kinds from all
documents (whole texts, letters and digits kept), one kind for each fallback, and read them again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import text as T
from ..sources import market as M
from ..sources.stage import staged
from .registry import query

T0 = 1704067200


def written(s, d):
    """(doc_id, url, html): pages of kind doc_id % 8."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    x = M.table(s, d, "documents").where("doc_id is not null").select("doc_id", words.alias("w"), F.timestamp_seconds(T0 + F.col("doc_id") * 420).alias("t"), (F.col("doc_id") % 8).alias("k"))
    show = lambda fmt: F.date_format("t", fmt)
    title, iso = F.concat(F.lit("Story "), F.col("doc_id").cast("string")), show("yyyy-MM-dd'T'HH:mm:ss'Z'")
    writer = F.concat(F.lit("Writer "), (F.col("doc_id") % 10).cast("string"))
    obj = lambda kind, *more: F.struct(F.lit(kind).alias("@type"), title.alias("headline"), *more)
    full = (F.struct(F.lit("Person").alias("@type"), writer.alias("name")).alias("author"), iso.alias("datePublished"), F.lit("Markets &amp; more").alias("articleSection"), F.lit("A <b>short</b> line").alias("description"), F.col("w").alias("articleBody"))
    east = F.concat(F.date_format(F.col("t") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    two = (F.array(F.struct(writer.alias("name")), F.struct(F.lit("Editor").alias("name"))).alias("author"), east.alias("datePublished"), F.array(F.lit("Bitcoin"), F.lit("Bullish")).alias("keywords"), F.col("w").alias("articleBody"))
    ld = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    site = F.lit('{"@type":"Organization","name":"Site"}')
    paras = F.concat(F.lit("<p>"), F.col("w"), F.lit("</p><p>Subscribe to our daily letter and more</p><li>An item of the list that is long enough</li>"))
    meta = lambda name, v: F.concat(F.lit(f'<meta property="{name}" content="'), v, F.lit('">'))
    kinds = [
        ld(F.to_json(obj("NewsArticle", *full))),
        ld(F.lit("["), site, F.lit(","), F.to_json(obj("Article", *two)), F.lit("]")),
        F.concat(ld(F.lit("{broken")), ld(F.lit('{"@graph":['), site, F.lit(","), F.to_json(obj("BlogPosting", F.struct(writer.alias("@id")).alias("creator"), iso.alias("datePublished"), F.col("w").alias("articleBody"))), F.lit("]}"))),
        F.concat(meta("og:title", title), meta("article:published_time", show("yyyy-MM-dd HH:mm:ss")), meta("author", writer), meta("article:section", F.lit("Policy")), meta("description", F.lit("Given &quot;by&quot; meta")), F.lit("<article></article><article>"), paras, F.lit("</article>")),
        F.concat(F.lit('<h2> </h2><h3>'), title, F.lit('</h3><time datetime="'), iso, F.lit('">then</time>'), paras),
        F.concat(F.lit("<title>"), title, F.lit("</title><p>Published "), F.upper(show("MMM")), F.lit(". "), show("d, yyyy"), F.lit(" at "), show("h:mm a"), F.lit(" UTC by hand</p><article><p>too short</p></article>"), paras),
        F.concat(ld(F.lit('{"headline":"'), title, F.lit('","articleBody":"Under a hundred characters","datePublished":"13/45/2024"}')), F.lit("<article>"), paras, F.lit("</article>")),
        F.lit("<p>No date, no name</p>"),
    ]
    html = F.get(F.array(*kinds), F.col("k").cast("int"))
    path = F.when(F.col("k") == 6, show("/yyyy/M/d/")).when(F.col("k") == 7, F.lit("/2024/13/41/")).otherwise(F.lit("/opinion/"))
    return x.select("doc_id", F.concat(F.lit("https://news.example"), path, F.lit("s-"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


WORDS_SQL = f"w AS (SELECT doc_id, doc_id % 8 AS k, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS w, to_timestamp({T0} + doc_id * 420)::TIMESTAMP AS t, 'Story ' || doc_id AS title, 'Writer ' || doc_id % 10 AS writer FROM documents WHERE doc_id IS NOT NULL)"
_ITEM = "An item of the list that is long enough"
_PARA = "(length(w) >= 25 AND NOT regexp_matches(lower(w), 'subscribe|sign up|cookie|advertisement'))"


@query("article_metadata", f"""WITH {WORDS_SQL} SELECT doc_id, CASE WHEN k < 7 THEN title END AS title, CASE WHEN k = 5 THEN date_trunc('minute', t) WHEN k < 6 THEN t END AS published_at, CASE WHEN k < 7 THEN date_trunc('day', t) END AS published_date,
 CASE k WHEN 0 THEN 'Markets & more' WHEN 3 THEN 'Policy' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'opinion' END AS section, CASE WHEN k = 1 THEN writer || ', Editor' WHEN k IN (0, 2, 3) THEN writer END AS author,
 CASE WHEN k = 0 THEN 'A short line' WHEN k = 3 THEN 'Given "by" meta' WHEN k = 5 THEN 'Published ' || upper(strftime(t, '%b')) || '. ' || strftime(t, '%-d, %Y') || ' at ' || strftime(t, '%-I:%M %p') || ' UTC by hand' WHEN k IN (4, 6) AND length(w) >= 25 THEN w WHEN k IN (4, 6) THEN 'Subscribe to our daily letter and more' END AS description,
 CASE WHEN k = 1 THEN 'Bitcoin, Bullish' END AS keywords, CASE WHEN k = 1 THEN 'BTC' ELSE '' END AS assets, CASE WHEN k = 1 THEN 'bullish' END AS mood, CASE WHEN k < 6 THEN 'ok' ELSE 'missing_published_at' END AS status FROM w""")
def article_metadata(s, d):
    x = A.metadata(written(s, d), "html", "url", ["doc_id"])
    return x.withColumn("assets", F.array_join("assets", ","))


@query("json_ld_articles", f"""WITH {WORDS_SQL}, o AS (SELECT doc_id, 0 AS n, 'NewsArticle' AS kind, title AS name, writer AS author, length(w) AS body FROM w WHERE k = 0
 UNION ALL SELECT doc_id, 0, 'Organization', 'Site', NULL, NULL FROM w WHERE k = 1 UNION ALL SELECT doc_id, 1, 'Article', title, writer || ', Editor', length(w) FROM w WHERE k = 1
 UNION ALL SELECT doc_id, 0, NULL, NULL, NULL, NULL FROM w WHERE k = 2 UNION ALL SELECT doc_id, 1, 'Organization', 'Site', NULL, NULL FROM w WHERE k = 2 UNION ALL SELECT doc_id, 2, 'BlogPosting', title, writer, length(w) FROM w WHERE k = 2
 UNION ALL SELECT doc_id, 0, NULL, title, NULL, 26 FROM w WHERE k = 6) SELECT doc_id, n::INT AS n, kind, name, author, nullif(body, 0)::INT AS body_chars FROM o""")
def json_ld_articles(s, d):
    """Every JSON-LD object of every page: of blocks, arrays and graphs; broken blocks give none."""
    o = written(s, d).select("doc_id", F.posexplode(A.json_ld_objects(F.col("html"))).alias("n", "o"))
    text = lambda *keys: F.coalesce(*(A.json_text(F.col("o"), k) for k in keys))
    return o.select("doc_id", "n", text("@type").alias("kind"), text("headline", "name").alias("name"), text("author", "creator").alias("author"), F.length(text("articleBody")).alias("body_chars"))


@query("article_bodies", f"""WITH {WORDS_SQL}, p AS (SELECT doc_id, k, w, CASE WHEN {_PARA} THEN w || chr(10) || chr(10) || '{_ITEM}' ELSE '{_ITEM}' END AS paras FROM w),
b AS (SELECT doc_id, CASE WHEN k IN (0, 1, 2) AND length(w) >= 100 THEN w WHEN k IN (3, 4, 6) THEN paras WHEN k = 5 THEN 'Published ' || (SELECT upper(strftime(t, '%b')) || '. ' || strftime(t, '%-d, %Y') || ' at ' || strftime(t, '%-I:%M %p') FROM w x WHERE x.doc_id = p.doc_id) || ' UTC by hand' || chr(10) || chr(10) || paras END AS body FROM p)
SELECT doc_id, coalesce(length(body), 0)::INT AS body_char_count, coalesce(len(regexp_extract_all(body, '\\S+')), 0)::INT AS body_word_count, sha256(body) AS body_hash, CASE WHEN body IS NULL THEN 'missing_body' ELSE 'ok' END AS status FROM b""")
def article_bodies(s, d):
    return A.bodies(written(s, d), "html", ["doc_id"]).drop("body")


@query("parsed_dates", f"""WITH w AS (SELECT doc_id, doc_id % 16 AS k, to_timestamp({T0} + doc_id * 420)::TIMESTAMP AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN k <= 3 THEN t WHEN k IN (4, 5, 6, 7) THEN date_trunc('minute', t) WHEN k = 8 THEN t WHEN k IN (9, 10, 11, 12) THEN date_trunc('day', t) END AS at, CASE WHEN k = 13 THEN date_trunc('day', t) END AS in_url, CASE WHEN k IN (2, 4, 6, 9, 10, 11, 13, 14) THEN date_trunc('day', t) END AS in_text FROM w""")
def parsed_dates(s, d):
    """A date in each of its forms, one row a document; forms 13 and 14 are addresses and sentences, 15 is no date."""
    x = M.table(s, d, "documents").where("doc_id is not null").select("doc_id", F.timestamp_seconds(T0 + F.col("doc_id") * 420).alias("t"))
    show, word = (lambda fmt: F.date_format("t", fmt)), F.lit
    month = F.when(show("MMM") == "Sep", "Sept").otherwise(show("MMM"))
    forms = [
        show("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format(F.col("t") - F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss"), word("-05:00")), show("yyyy-MM-dd HH:mm:ss"), F.concat(show("EEE, dd MMM yyyy HH:mm:ss"), word(" +0000")),
        F.concat(show("MMMM d, yyyy"), word(" at "), show("h:mm a"), word(" UTC")), F.concat(F.lower(month), word(". "), show("d, yyyy h:mm"), F.lower(show("a"))), F.concat(show("MMM d, yyyy H:mm"), word(" GMT")), show("d MMMM yyyy H:mm"),
        F.concat(show("yyyyMMdd"), word("T"), show("HHmmss"), word("Z")), show("yyyy-M-d"), show("MMMM d, yyyy"), show("yyyy/M/d"), show("d MMM yyyy"),
        F.concat(word("https://x.example"), show("/yyyy/M/d/"), word("slug")), F.concat(word("Written on "), F.upper(show("MMMM")), show(" d, yyyy"), word(" in a hurry")), word("2024-13-45 or so"),
    ]
    form = F.get(F.array(*forms), (F.col("doc_id") % 16).cast("int"))
    return x.select("doc_id", form.alias("x")).select("doc_id", A.parse_time(F.col("x")).alias("at"), A.date_in_url(F.col("x")).alias("in_url"), A.date_in_text(F.col("x")).alias("in_text"))


ARCHIVE = 25  #: links of a page of the archive


def archive(s, d):
    """(page, url, html): an archive of all documents, 25 links a page; every other link has its day in its address, others beside them."""
    x = M.table(s, d, "documents").where("doc_id is not null").select("doc_id", F.timestamp_seconds(T0 + F.col("doc_id") * 420).alias("t"), F.floor(F.col("doc_id") / ARCHIVE).alias("page"))
    href = F.when(F.col("doc_id") % 2 == 0, F.concat(F.date_format("t", "/yyyy/MM/dd/"), F.lit("s-"))).when(F.col("doc_id") % 5 == 0, F.lit("/tag/t-")).otherwise(F.lit("https://news.example/markets/s-"))
    item = F.concat(F.lit('<div class="card"><a href="'), href, F.col("doc_id").cast("string"), F.lit('#top"><b>Story</b> '), F.col("doc_id").cast("string"), F.lit("</a> "), F.date_format("t", "MMMM d, yyyy"), F.lit("</div>"))
    pages = x.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda r: r["i"]), "\n").alias("items"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("<html><p>Page "), (F.col("page") + 1).cast("string"), F.lit(" of "), (F.col("page") + 3).cast("string"), F.lit('</p><p>1,'), F.lpad((F.col("page") % 1000).cast("string"), 3, "0"), F.lit(' articles published</p><a href="/sitemap/archive/2024/'), (F.col("page") + 2).cast("string"), F.lit('">next</a>\n'))
    return pages.select("page", F.concat(F.lit("https://news.example/sitemap/archive/2024/"), F.col("page").cast("string")).alias("url"), F.concat(head, "items", F.lit("</html>")).alias("html"))


ARCHIVE_SQL = f"""x AS (SELECT doc_id, to_timestamp({T0} + doc_id * 420)::TIMESTAMP AS t, (doc_id // {ARCHIVE})::BIGINT AS page FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, t, page, CASE WHEN doc_id % 2 = 0 THEN strftime(t, '/%Y/%m/%d/') || 's-' WHEN doc_id % 5 = 0 THEN '/tag/t-' ELSE 'https://news.example/markets/s-' END || doc_id AS href FROM x),
j AS (SELECT *, '<div class="card"><a href="' || href || '#top"><b>Story</b> ' || doc_id || '</a> ' || strftime(t, '%B %-d, %Y') || '</div>' AS item FROM i),
h AS (SELECT page, '<html><p>Page ' || (page + 1) || ' of ' || (page + 3) || '</p><p>1,' || lpad((page % 1000)::VARCHAR, 3, '0') || ' articles published</p><a href="/sitemap/archive/2024/' || (page + 2) || '">next</a>' || chr(10) || string_agg(item, chr(10) ORDER BY doc_id) || '</html>' AS html FROM j GROUP BY page)"""


@query("link_context", f"""WITH {ARCHIVE_SQL}, a AS (SELECT j.*, row_number() OVER (PARTITION BY j.page ORDER BY doc_id) AS place, strpos(h.html, '<a href="' || href || '#top">') AS p0, html, length('<a href="' || href || '#top"><b>Story</b> ' || doc_id || '</a>') AS n FROM j JOIN h USING (page)),
c AS (SELECT *, trim(regexp_replace(regexp_replace(substr(html, greatest(p0 - 500, 1)::BIGINT, (n + 500 + least(p0 - 1, 500))::BIGINT), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS context FROM a),
k AS (SELECT *, regexp_extract(context, '\\b(20\\d{{2}}[-/]\\d{{1,2}}[-/]\\d{{1,2}})\\b', 1) AS num, regexp_extract(context, '\\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{{1,2}},\\s+20\\d{{2}})\\b', 1) AS named FROM c)
SELECT page, place::INT AS place, CASE WHEN starts_with(href, '/') THEN 'https://news.example' || href ELSE href END AS url, 'Story ' || doc_id AS title,
 CASE WHEN doc_id % 2 = 0 THEN date_trunc('day', t) WHEN num <> '' THEN try_strptime(replace(num, '/', '-'), '%Y-%m-%d') ELSE try_strptime(nullif(named, ''), '%B %-d, %Y') END AS published_date, length(context)::INT AS context_chars FROM k WHERE NOT (doc_id % 2 = 1 AND doc_id % 5 = 0)""")
def link_context(s, d):
    """Links of the archive with the text of 500 characters around each; tag pages and the archive's own links are no articles."""
    x = A.link_context(archive(s, d), "html", "url", "page", host="news.example")
    return x.select("page", "place", "url", "title", "published_date", F.length("context").alias("context_chars"))


@query("archive_counts", f"WITH {ARCHIVE_SQL} SELECT page, (page + 3)::INT AS pages, (1000 + page % 1000)::INT AS declared, (SELECT count(*) FROM j WHERE j.page = h.page)::INT AS links FROM h")
def archive_counts(s, d):
    html = F.col("html")
    return archive(s, d).select("page", A.page_count(html, r"(?i)/sitemap/archive/2024/(\d+)").alias("pages"), A.declared_count(html).alias("declared"), (F.size(T.blocks(html, "a")) - 1).alias("links"))


@query("url_kinds", r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, path NOT IN ('', '/', '/sitemap') AND NOT regexp_matches(path, '^(/sitemap|/arc/outboundfeeds|/cdn-cgi|/author/|/tag/|/category/|/markets/sitemap)') AS is_article, nullif(lower(regexp_extract(url, '^\w+://([^/?#]+)', 1)), '') AS domain,
 CASE WHEN regexp_matches(regexp_extract(url, '^\w+://[^/?#]+/+([^/?#]+)', 1), '^20\d{2}$') THEN NULL ELSE nullif(regexp_extract(url, '^\w+://[^/?#]+/+([^/?#]+)', 1), '') END AS section FROM u""")
def url_kinds(s, d):
    u = F.col("url")
    return M.table(s, d, "pages").select("page_id", A.article_url(u).alias("is_article"), A.known(F.lower(F.regexp_extract(u, r"^\w+://([^/?#]+)", 1))).alias("domain"), A.section_in_url(u).alias("section"))


UNIVERSE = ["EN", "DE", "SRC1", "SRC2"]


@query("tag_lists", f"""WITH t AS (SELECT doc_id, lang, source, doc_id % 3 AS k FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT doc_id, unnest(list_distinct([upper(lang), upper(source), upper(lang)])) AS coin FROM t)
SELECT doc_id, coin FROM n WHERE coin IN ({', '.join(f"'{u}'" for u in UNIVERSE)})""")
def tag_lists(s, d):
    """Language and source of every article as a list: JSON, with commas, or in brackets with quotes; one row for each name of the universe."""
    x = M.table(s, d, "documents").where("doc_id is not null").select("doc_id", F.array_compact(F.array("lang", "source", "lang")).alias("n"))
    kinds = F.array(F.to_json("n"), F.array_join("n", " , "), F.concat(F.lit("['"), F.array_join("n", "';'"), F.lit("']")))
    lists = x.select("doc_id", F.get(kinds, (F.col("doc_id") % 3).cast("int")).alias("asset_type"))
    return A.by_name(lists, "asset_type", UNIVERSE, "doc_id").select("doc_id", "coin")


@query("merged_articles", f"""WITH {WORDS_SQL}, m AS (SELECT doc_id, CASE WHEN k < 5 THEN 'a' ELSE 'b' END AS source, title, t AS published_at, CASE WHEN k IN (0, 1, 2) THEN CASE WHEN length(w) >= 100 THEN length(w) END
 ELSE CASE WHEN {_PARA} THEN length(w) + 2 + {len(_ITEM)} ELSE {len(_ITEM)} END + CASE WHEN k = 5 THEN length('Published ' || upper(strftime(t, '%b')) || '. ' || strftime(t, '%-d, %Y') || ' at ' || strftime(t, '%-I:%M %p') || ' UTC by hand') + 2 ELSE 0 END END AS n, k FROM w WHERE k < 6)
SELECT source, doc_id, title, CASE WHEN k = 5 THEN date_trunc('minute', published_at) ELSE published_at END AS published_at, n::INT AS chars FROM m WHERE n IS NOT NULL""")
def merged_articles(s, d):
    """Details and bodies of two sources, only those that are ok, joined one to one, united and made a corpus by its milliseconds."""
    x = staged(written(s, d))  # read four times; a filter on the status would else write each page anew for every pattern of the time
    details, texts = A.metadata(x, "html", "url", ["doc_id", "url"]), A.bodies(x, "html", ["doc_id", "url"])
    first = F.col("doc_id") % 8 < 5
    sources = [A.joined_source(details.where(part), texts, name, "doc_id") for name, part in (("a", first), ("b", ~first))]
    both = sources[0].unionByName(sources[1]).withColumn("published_at", F.unix_millis("published_at"))
    out = A.corpus(both.select("url", "title", "source", "published_at", "article_text"))
    return out.select("source", F.regexp_extract("url", r"s-(\d+)$", 1).cast("long").alias("doc_id"), "title", F.col("datetime_utc").alias("published_at"), F.length("body_text").alias("chars"))
