"""Articles out of pages: JSON-LD objects, metadata and bodies by ranked fallbacks, dates in any of the usual forms, links with their surroundings.

All by row. Fallbacks are `coalesce` over columns, so a page is read once; character references of the chosen fields are
resolved in one Arrow batch. A missing field is null, never an empty text. Times without a zone are the session's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Types of JSON-LD objects that are articles, and words that mark boilerplate or sections.
ARTICLE_TYPES = ("newsarticle", "article", "blogposting")
SECTIONS = ("Bitcoin", "Ethereum", "DeFi", "Regulation", "Markets", "Macro", "Trading", "ETF", "Mining", "Stablecoins", "NFT", "AI", "Security", "Policy")
MOODS = ("Bullish", "Bearish", "Neutral")
#: Names of assets in texts.
ASSETS = {
    "BTC": ["BTC", "Bitcoin"], "ETH": ["ETH", "Ether", "Ethereum"], "SOL": ["SOL", "Solana"], "BNB": ["BNB", "Binance Coin", "BNB Chain"], "XRP": ["XRP", "Ripple"], "DOGE": ["DOGE", "Dogecoin"],
    "LTC": ["LTC", "Litecoin"], "LINK": ["LINK", "Chainlink"], "TRX": ["TRX", "Tron", "TRON"], "ADA": ["ADA", "Cardano"], "HYPE": ["HYPE", "Hyperliquid"], "XMR": ["XMR", "Monero"], "ZEC": ["ZEC", "Zcash"], "USDT": ["USDT", "Tether"],
}
#: Paths that hold no articles.
NO_ARTICLES = ("/sitemap", "/arc/outboundfeeds", "/cdn-cgi", "/author/", "/tag/", "/category/", "/markets/sitemap")

MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: Forms of times that begin with letters or a day; the first that fits wins. Optional parts are in brackets.
FORMS = ("MMM d, yyyy[ h:mm a][ z]", "MMMM d, yyyy[ h:mm a][ z]", "MMM d, yyyy[ H:mm[:ss]][ z]", "MMMM d, yyyy[ H:mm[:ss]][ z]", "d MMM yyyy[ H:mm[:ss]][ XX][ z]", "d MMMM yyyy[ H:mm[:ss]][ XX][ z]", "yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd[HHmmss]", "yyyyMMdd'T'HHmmssX")


def known(x: Column) -> Column:
    """The text, or null where it has nothing but white space."""
    return F.when(F.trim(x) != "", x)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def members(o: Column) -> Column:
    """Elements of an array, or members of an object's @graph."""
    kind = F.schema_of_variant(o)
    inner = F.when(kind.startswith("ARRAY"), F.try_variant_get(o, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.try_variant_get(o, "$['@graph']", "array<variant>"))
    return F.coalesce(inner, F.array().cast("array<variant>"))


def unfolded(o: Column, depth: int) -> Column:
    """A value and all within it, each before what it holds."""
    if not depth:
        return F.array(o)
    return F.concat(F.array(o), F.flatten(F.transform(members(o), lambda c: unfolded(c, depth - 1))))


def json_ld_objects(page: Column, depth: int = 4) -> Column:
    """All JSON-LD objects of a page in order: of every script block, of arrays and of graphs, to a depth. Broken blocks give none."""
    raw = F.regexp_extract_all(page, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*['"]application/ld\+json['"][^>]*>(.*?)</script>"""), 1)
    values = F.filter(F.transform(raw, lambda r: F.try_parse_json(r)), lambda v: v.isNotNull())
    return F.filter(F.flatten(F.transform(values, lambda v: unfolded(v, depth))), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def json_text(o: Column, key: str) -> Column:
    """Text of a field: itself, the name or id of an object, or those of a list with commas; without markup, null if nothing is left."""
    v = F.try_variant_get(o, f"$['{key}']", "variant")
    named = lambda x: F.coalesce(known(F.try_variant_get(x, "$.name", "string")), known(F.try_variant_get(x, "$['@id']", "string")))
    plain = lambda x: F.try_variant_get(x, "$", "string")
    each = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), named(x)).otherwise(known(plain(x)))
    kind = F.schema_of_variant(v)
    listed = F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), each), lambda t: t.isNotNull()), ", ")
    return known(T.squeezed(T.without_markup(F.when(kind.startswith("OBJECT"), named(v)).when(kind.startswith("ARRAY"), listed).otherwise(plain(v)))))


def first_text(objects: Column, *keys: str, least: int = 1) -> Column:
    """The first text of `least` characters or more among objects, each by the first of `keys` it has."""
    texts = F.transform(objects, lambda o: F.coalesce(*(json_text(o, k) for k in keys)))
    return F.get(F.filter(texts, lambda t: F.length(t) >= least), F.lit(0))


def articles_of(objects: Column) -> Column:
    """The objects that are articles by type; all, if none is."""
    typed = F.filter(objects, lambda o: F.lower(F.try_variant_get(o, "$['@type']", "string")).isin(*ARTICLE_TYPES))
    return F.when(F.size(typed) > 0, typed).otherwise(objects)


def parse_time(x: Column) -> Column:
    """A time from text by a ranked list of forms: ISO with or without zone, month names (any case, Sept., `at`), RFC 1123, slashes; null if none fits."""
    def read(x: Column) -> Column:
        iso = F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), x.try_cast("timestamp"))
        words = T.squeezed(F.regexp_replace(F.regexp_replace(x, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"(?i)\s+at\s+", " "))
        words = F.regexp_replace(F.initcap(F.regexp_replace(words, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:t?)\.", "$1")), r"\bSept\b", "Sep")
        words = F.replace(F.replace(words, F.lit("Gmt"), F.lit("GMT")), F.lit("Utc"), F.lit("UTC"))
        words = F.regexp_replace(F.regexp_replace(words, r"(?i)(\d)\s*am\b", "$1 AM"), r"(?i)(\d)\s*pm\b", "$1 PM")
        return F.coalesce(iso, bound(words, lambda w: F.coalesce(*(F.try_to_timestamp(w, F.lit(f)) for f in FORMS))))

    return bound(F.trim(x), read)


def date_in_url(url: Column) -> Column:
    """The day of a path like /2024/1/5/; null if it is none."""
    part = lambda n: F.regexp_extract(url, r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)", n)
    return F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-M-d"))


def date_in_text(x: Column) -> Column:
    """The first day in numbers, else in words, of a text without markup."""
    numbers = F.regexp_replace(F.regexp_extract(x, r"\b(20\d{2}[-/]\d{1,2}[-/]\d{1,2})\b", 1), "/", "-")
    words = F.regexp_extract(x, rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},\s+20\d{{2}})\b", 1)
    return F.when(numbers != "", F.try_to_timestamp(numbers, F.lit("yyyy-M-d"))).otherwise(parse_time(known(words)))


def time_in_page(page: Column) -> Column:
    """A page's time by its `datetime` attribute, else its published fields, else the first written date."""
    found = lambda pattern: parse_time(known(F.regexp_extract(page, pattern, 1)))
    visible = T.squeezed(T.without_markup(page))
    written = F.regexp_extract(visible, rf"(?i)\b((?:{MONTHS})\.?\s+\d{{1,2}},\s+20\d{{2}}(?:\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:am|pm)?\s*(?:GMT|UTC)?)?)", 1)
    return F.coalesce(
        found(r"""(?is)<time\b[^>]*datetime\s*=\s*['"]([^'"]+)['"]"""), found(r"""(?is)datePublished['"]?\s*[:=]\s*['"]([^'"]+)['"]"""), found(r"""(?is)published_time['"]?\s*[:=]\s*['"]([^'"]+)['"]"""), parse_time(known(F.trim(written)))
    )


def heading(page: Column) -> Column:
    """The first heading with text, h1 before h2 to h4, else the page's title."""
    first = lambda tag: F.get(F.filter(F.transform(T.blocks(page, tag), lambda b: T.squeezed(T.without_markup(b))), lambda t: t != ""), F.lit(0))
    return F.coalesce(*(first(tag) for tag in ("h1", "h2", "h3", "h4", "title")))


def first_paragraph(page: Column, least: int = 25) -> Column:
    return F.get(F.filter(F.transform(T.blocks(page, "p"), lambda b: T.squeezed(T.without_markup(b))), lambda t: F.length(t) >= least), F.lit(0))


def section_in_url(url: Column) -> Column:
    """The first part of the path that is no year."""
    part = F.regexp_extract(url, r"^\w+://[^/?#]+/+([^/?#]+)", 1)
    return F.when(~part.rlike(r"^20\d{2}$"), known(part))


def first_word(x: Column, words: tuple[str, ...]) -> Column:
    """The first of `words`, in their order, that stands in the text as a word."""
    return F.coalesce(*(F.when(x.rlike(rf"(?i)\b{w}\b"), F.lit(w)) for w in words))


def article_url(url: Column, host: str | None = None) -> Column:
    """Whether an address can be an article's: of the host (if given), with a path that is not among those without articles."""
    path = F.lower(F.regexp_extract(url, r"^\w+://[^/?#]*([^?#]*)", 1))
    own = F.lit(True) if host is None else F.lower(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1)).endswith(host)
    return own & ~path.isin("", "/", "/sitemap") & ~F.exists(F.array(*map(F.lit, NO_ARTICLES)), lambda p: path.startswith(p))


def page_count(page: Column, link: str) -> Column:
    """How many pages an archive has: the largest number of `Page x of y` and of links like `link`, at least 1."""
    said = F.regexp_extract(T.squeezed(T.without_markup(page)), r"(?i)\bPage\s+\d+\s+of\s+(\d+)\b", 1).try_cast("int")
    linked = F.array_max(F.transform(F.regexp_extract_all(page, F.lit(link), 1), lambda n: n.try_cast("int")))
    return F.greatest(F.lit(1), said, linked)


def declared_count(page: Column) -> Column:
    """The number in `1,234 articles published`, or null."""
    return F.replace(F.regexp_extract(T.squeezed(T.without_markup(page)), r"(?i)\b([\d,]+)\s+articles\s+published\b", 1), F.lit(","), F.lit("")).try_cast("int")


def metadata(df: DataFrame, page: str, url: str, keep: list[str], title: str | None = None, date: str | None = None) -> DataFrame:
    """(keep, title, published_at, published_date, section, author, description, keywords, assets, mood, status) of article pages.

    Each field comes from the page's article objects, else its meta tags, else what the page shows (heading, written date, address). `title`
    and `date` name columns of an index, taken where the page itself says nothing. status is missing_published_at without a time.
    """
    p, u = F.col(page), F.col(url)
    x = df.withColumn("_o", articles_of(json_ld_objects(p)))
    o, meta = F.col("_o"), lambda *keys: known(T.squeezed(T.without_markup(T.meta_content(p, list(keys)))))
    given = [F.col(title)] if title else []
    fields = {
        "title": F.coalesce(first_text(o, "headline", "name"), meta("og:title", "twitter:title"), *given, heading(p)),
        "section": F.coalesce(first_text(o, "articleSection", "section"), meta("article:section"), section_in_url(u)),
        "author": F.coalesce(first_text(o, "author", "creator"), meta("author")),
        "description": F.coalesce(first_text(o, "description"), meta("description", "og:description"), first_paragraph(p)),
        "keywords": F.coalesce(first_text(o, "keywords"), meta("keywords", "news_keywords")),
    }
    times = F.filter(F.transform(o, lambda v: F.try_variant_get(v, "$.datePublished", "string")), lambda t: t.isNotNull())
    at = F.coalesce(parse_time(F.get(times, F.lit(0))), parse_time(meta("article:published_time", "date", "pubdate")), time_in_page(p))
    out = x.select(*keep, *(T.unescape(c).alias(n) for n, c in fields.items()), at.alias("published_at"), u.alias("_u"), p.alias("_p"), *([F.col(date).alias("_d")] if date else []))
    said = F.concat_ws(" ", "title", "description", "section", "keywords")
    head = F.concat_ws(" ", "title", "description", "keywords", T.squeezed(T.without_markup(F.col("_p"))))
    day = F.coalesce(F.date_trunc("day", "published_at"), *([F.col("_d").cast("timestamp")] if date else []), date_in_url(F.col("_u")))
    return out.select(
        *keep, "title", "published_at", day.alias("published_date"), "section", "author", "description", "keywords", T.tags(said, {n: [re.escape(a) for a in names] for n, names in ASSETS.items()}).alias("assets"),
        F.lower(first_word(head, MOODS)).alias("mood"), F.when(F.col("published_at").isNull(), "missing_published_at").otherwise("ok").alias("status"),
    )


def bodies(df: DataFrame, page: str, keep: list[str], status: str | None = None, least: int = 100) -> DataFrame:
    """(keep, body, body_char_count, body_word_count, body_hash, status): the first JSON-LD body of `least` characters, else paragraphs.

    Paragraphs are those of the first article element that has any, else of the page. Where the column `status` is not ok, there is no body.
    """
    p = F.col(page)
    own = F.get(F.filter(F.transform(T.blocks(p, "article"), lambda b: F.array_join(T.paragraphs(b), "\n\n")), lambda t: t != ""), F.lit(0))
    shown = F.coalesce(own, known(F.array_join(T.paragraphs(p), "\n\n")))
    body = F.coalesce(first_text(json_ld_objects(p), "articleBody", least=least), shown)
    ok = F.lit("ok") if status is None else F.col(status)
    x = df.select(*keep, ok.alias("_s"), T.unescape(F.when(ok == "ok", body)).alias("body"))
    return x.select(
        *keep, "body", F.coalesce(F.length("body"), F.lit(0)).alias("body_char_count"), F.coalesce(F.regexp_count("body", F.lit(r"\S+")), F.lit(0)).alias("body_word_count"), F.sha2("body", 256).alias("body_hash"),
        F.when(F.col("body").isNotNull(), "ok").when(F.col("_s") == "ok", "missing_body").otherwise(F.col("_s")).alias("status"),
    )


ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.I | re.S)
#: A worker of `link_context` passes on what it cut at this many characters; only memory depends on it.
HELD = 1 << 22
HREF = re.compile(r"""href\s*=\s*["']([^"']+)["']""", re.I)


def link_context(df: DataFrame, page: str, url: str, key: str, around: int = 500, host: str | None = None) -> DataFrame:
    """(key, place, url, title, published_date, context) of each link to an article: its day by its address, else by what stands around it.

    Spark's regular expressions do not tell where they match, so a pass over Arrow batches cuts `around` characters on both
    sides of each anchor; all else is columns. Fragments are cut off; links without text are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def links(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [key, "base", "place", "href", "inner", "context"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.types[0], pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                k, base, html = (c[i].as_py() for c in batch.columns)
                for n, m in enumerate(ANCHOR.finditer(html or "")):
                    if h := HREF.search(m.group(1)):
                        rows.append((k, base, n, h.group(1), m.group(2), html[max(0, m.start() - around) : m.end() + around]))
                        held += len(m.group(2)) + len(rows[-1][-1])
                        if held >= HELD:
                            yield links(rows, kinds)
                            rows, held = [], 0
            if rows:
                yield links(rows, kinds)

    rows = df.select(key, F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(cut, f"{key} {kind}, base string, place int, href string, inner string, context string")
    rows = rows.withColumns({"href": F.trim(T.unescape(F.col("href"))), "title": T.clean_text(F.col("inner")), "context": T.squeezed(T.unescape(T.without_markup(F.col("context"))))})
    rows = rows.withColumn("url", F.regexp_replace(T.absolute(F.col("href"), F.col("base")), "#.*$", "")).where(F.col("title").isNotNull() & article_url(F.col("url"), host))
    return rows.select(key, "place", "url", "title", F.coalesce(date_in_url(F.col("url")), date_in_text(F.col("context"))).alias("published_date"), "context")


def name_list(x: Column) -> Column:
    """Names of a list as JSON or with commas, semicolons or spaces; upper case, each once, in order; empty if null."""
    parsed = F.try_variant_get(F.try_parse_json(x), "$", "array<string>")
    loose = F.split(F.regexp_replace(x, r"""[\[\]'"]""", ""), r"[,;\s]+")
    names = F.transform(F.coalesce(parsed, loose, F.array().cast("array<string>")), lambda n: F.upper(F.trim(n)))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def by_name(df: DataFrame, column: str, universe: list[str], key: str, name: str = "coin") -> DataFrame:
    """One row for each article and name of the universe in its list: (columns of df, name), once for each (key, name)."""
    allowed = F.array(*(F.lit(u.upper()) for u in universe))
    return df.withColumn(name, F.explode(F.array_intersect(name_list(F.col(column)), allowed))).dropDuplicates([key, name])


def corpus(df: DataFrame, millis: str = "published_at") -> DataFrame:
    """A merged corpus (url, title, published_at in milliseconds, article_text; source optional) with times, one row a url (the first by time).

    Raises where a column is missing; rows without a time or a title go.
    """
    if missing := [c for c in ("url", "title", millis, "article_text") if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in df.columns else F.lit("unknown")
    x = df.select("url", F.trim("title").alias("title"), source.alias("source"), F.coalesce("article_text", F.lit("")).alias("body_text"), F.timestamp_millis(F.col(millis).cast("long")).alias("datetime_utc"))
    from .cleaning import keep_one

    return keep_one(x.where("datetime_utc is not null and title is not null"), ["url"], ["datetime_utc", "title"], newest=False)


def joined_source(details: DataFrame, texts: DataFrame, source: str, order: str) -> DataFrame:
    """Details and bodies of one source whose status is ok, the newest of each url, joined one to one."""
    from .cleaning import joined_once, keep_one

    newest = lambda df: keep_one(df.where("status = 'ok'").drop("status"), ["url"], [order])
    both = joined_once(newest(details), newest(texts).select("url", F.col("body").alias("article_text")), ["url"])
    return both.withColumn("source", F.lit(source))
