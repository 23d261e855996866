"""Article pages by hand: objects, fields, dates, links, lists, corpora."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import articles as A
from tidemark.operators import rules
from tidemark.operators import text as T

NOON = dt.datetime(2024, 3, 5, 12, 30)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-03-05T12:30:00Z", NOON), ("2024-03-05T14:30:00+02:00", NOON), ("2024-03-05 12:30:00", NOON), ("2024-03-05", dt.datetime(2024, 3, 5)), ("Tue, 05 Mar 2024 12:30:00 +0000", NOON), ("5 March 2024 12:30", NOON),
        ("Mar. 5, 2024 at 12:30 pm UTC", NOON), ("march 5, 2024 at 12:30PM", NOON), ("MARCH 5, 2024", dt.datetime(2024, 3, 5)), ("Sept. 5, 2024", dt.datetime(2024, 9, 5)), ("2024/3/5", dt.datetime(2024, 3, 5)), ("20240305T123000Z", NOON),
        ("may. 5, 2024 1:07am", dt.datetime(2024, 5, 5, 1, 7)), ("MAY. 5, 2024 at 1:07 AM UTC", dt.datetime(2024, 5, 5, 1, 7)), ("May 5, 2024", dt.datetime(2024, 5, 5)),
        ("2024-02-30", None), ("13/45/2024", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_times_in_all_forms(spark, text, want):
    assert one(spark, text, A.parse_time) == want


def test_days_in_addresses_and_texts(spark):
    assert one(spark, "https://x/2024/3/5/a", A.date_in_url) == dt.datetime(2024, 3, 5) and one(spark, "https://x/2024/13/5/a", A.date_in_url) is None
    assert one(spark, "on Mar 5, 2024 or 2023-01-02", A.date_in_text) == dt.datetime(2023, 1, 2)
    assert one(spark, "on Mar 5, 2024", A.date_in_text) == dt.datetime(2024, 3, 5) and one(spark, "2024-13-45", A.date_in_text) is None
    assert one(spark, '<time datetime="bad">x</time> <p>Mar. 5, 2024 at 12:30 pm</p>', A.time_in_page) == NOON


def test_references_without_a_semicolon_stay(spark):
    assert one(spark, "<h1>a&amp;&amp &lt;b&gt; &quo &#39;&#x41; &ampx; &eacute;&nonsense;</h1>", T.clean_text) == "a&&amp <b> &quo 'A &ampx; é&nonsense;"


def page(*objects):
    return "".join(f"<script type='application/ld+json'>{o if isinstance(o, str) else json.dumps(o)}</script>" for o in objects)


def test_objects_are_found_in_depth_and_in_order(spark):
    deep = {"name": "a", "@graph": [{"name": "b", "@graph": [{"name": "c"}]}, {"name": "d"}]}
    html = page([deep, {"name": "e"}], "{broken", "[]", '"text"', {"name": "f"})
    got = one(spark, html, lambda x: F.transform(A.json_ld_objects(x), lambda o: A.json_text(o, "name")))
    assert got == list("abcdef")
    assert one(spark, None, lambda x: A.json_ld_objects(x).isNull()) and one(spark, "<p>", lambda x: F.size(A.json_ld_objects(x))) == 0


def test_text_of_fields(spark):
    o = {"s": " <b>x</b>  y ", "o": {"name": "", "@id": "i"}, "l": [{"name": "a"}, "b", "", None, {"@id": "c"}], "n": 5, "e": "  ", "z": None}
    got = {k: one(spark, page(o), lambda x, k=k: A.first_text(A.json_ld_objects(x), k)) for k in (*o, "missing")}
    assert got == {"s": "x y", "o": "i", "l": "a, b, c", "n": "5", "e": None, "z": None, "missing": None}


def test_articles_come_before_other_objects(spark):
    html = page({"@type": "WebSite", "name": "Site", "author": "Nobody"}, {"@type": "NewsArticle", "headline": "News", "datePublished": "2024-03-05T12:30:00Z"}) + "<meta name='author' content='Ann &amp; Bob'><p>A paragraph that is long enough to describe it</p>"
    df = spark.createDataFrame([(1, html, "https://x.example/tech/a"), (2, "<h1> </h1><h2>Seen</h2>", "https://x.example/2024/3/5/a"), (3, None, None)], "id int, html string, url string")
    r = {x.id: x for x in A.metadata(df, "html", "url", ["id"]).collect()}
    assert (r[1].title, r[1].author, r[1].section, r[1].published_at, r[1].status) == ("News", "Ann & Bob", "tech", NOON, "ok")
    assert r[1].description == "A paragraph that is long enough to describe it"
    assert (r[2].title, r[2].section, r[2].published_date, r[2].status) == ("Seen", None, dt.datetime(2024, 3, 5), "missing_published_at")
    assert r[3].title is None and r[3].assets == []


def test_bodies_fall_back(spark):
    long, short = "word " * 30, "short body"
    p = "<p>A paragraph that is long enough to count &amp; more</p>"
    rows = [(1, page({"articleBody": short}, {"articleBody": long}), "ok"), (2, page({"articleBody": short}) + f"<article></article><article>{p}</article><p>Another one that is outside of the article</p>", "ok"), (3, f"<div>{p}</div>", "ok"), (4, "<p>tiny</p>", "ok"), (5, page({"articleBody": long}), "http_404"), (6, None, "ok")]
    got = {r.id: (r.body, r.status) for r in A.bodies(spark.createDataFrame(rows, "id int, html string, s string"), "html", ["id"], "s").collect()}
    text = "A paragraph that is long enough to count & more"
    assert got == {1: (long.strip(), "ok"), 2: (text, "ok"), 3: (text, "ok"), 4: (None, "missing_body"), 5: (None, "http_404"), 6: (None, "missing_body")}


def test_links_with_their_surroundings(spark):
    html = '<p>Jan 2, 2024</p><a href="/a&amp;b#x"><b>One</b></a>' + "x" * 600 + '<a class=c href=\'https://y.example/2024/3/5/s\'>Two</a><a href="/tag/t">Tag</a><a>none</a><a href="/empty"></a>'
    df = spark.createDataFrame([(1, html, "https://x.example/list"), (2, None, "https://x.example/")], "id long, html string, url string")
    got = [(r.place, r.url, r.title, r.published_date) for r in A.link_context(df, "html", "url", "id").orderBy("place").collect()]
    assert got == [(0, "https://x.example/a&b", "One", dt.datetime(2024, 1, 2)), (1, "https://y.example/2024/3/5/s", "Two", dt.datetime(2024, 3, 5))]
    assert [r.url for r in A.link_context(df, "html", "url", "id", host="y.example").collect()] == ["https://y.example/2024/3/5/s"]


@pytest.mark.parametrize("text, want", [('["btc","ETH","BTC"]', ["BTC", "ETH"]), ("['btc', 'eth']", ["BTC", "ETH"]), ("btc; eth,sol", ["BTC", "ETH", "SOL"]), ("BTC", ["BTC"]), ("[]", []), ("", []), (None, [])])
def test_lists_of_names(spark, text, want):
    assert one(spark, text, A.name_list) == want


def test_corpora(spark):
    df = spark.createDataFrame([("u", " b ", 2000, None), ("u", "a", 1000, "t"), ("v", None, 1000, "t"), ("w", "c", None, "t")], "url string, title string, published_at long, article_text string")
    assert [tuple(r) for r in A.corpus(df).collect()] == [("u", "a", "unknown", "t", dt.datetime(1970, 1, 1, 0, 0, 1))]
    with pytest.raises(ValueError, match="article_text"):
        A.corpus(df.drop("article_text"))


def test_extractions_in_range(spark):
    schema = "event_type string, entities array<string>, themes array<string>, sentiment string, severity double, is_rumor boolean, source_credibility double, horizon string, confidence double"
    rows = [("ETF", ["eth", "btc", "eth", "x"], ["DEFI"], "-3", 2.0, True, 0.2, "weeks", -1.0), (None, None, None, None, float("nan"), None, None, None, None)]
    a, b = (tuple(r) for r in T.coerced_extraction(spark.createDataFrame(rows, schema), rules).collect())
    assert a == ("etf", ["BTC", "ETH"], ["defi"], -1.0, 1.0, True, 0.2, "weeks", 0.0)
    assert b == ("none", [], ["none"], 0.0, 0.0, False, 0.5, "days", 0.5)


def test_links_are_passed_on_in_bounded_batches(spark, monkeypatch):
    """One Arrow batch of many pages is not one batch of all their links, whose surroundings are much longer than the pages."""
    import pyarrow as pa

    html = "".join(f'<p><a href="/{i}">Story {i}</a></p>' for i in range(100))
    df = spark.createDataFrame([(1, html, "https://x.example/")], "id long, html string, url string")
    seen, whole = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda x, f, schema: seen.append(f) or whole(x, f, schema))
    A.link_context(df, "html", "url", "id")
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["https://x.example/"] * 200), pa.array([html] * 200)], ["id", "url", "html"])
    out = list(seen[0](iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) < 6e6
    assert [(i, n) for b in out for i, n in zip(b["id"].to_pylist(), b["place"].to_pylist())] == [(i, n) for i in range(200) for n in range(100)]


def test_rules_by_literal_search_equal_those_of_columns(spark):
    """One pass over Arrow batches gives what a search of the whole text for each word gives: overlaps, counts of repeats, order of kinds."""
    texts = ["", "banbanban surge surges rally", "the fed may list a token unlock", "hackhack sec ban ai agent", "xbtc btc_ (eth) reportedly delisted", "yield tvl l2 layer 2", "ünban \U0001f600 gain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    want = df.select("i", T.first_match(t, rules.EVENTS).alias("kind"), F.array_compact(F.array(*(F.when(T.any_of(t, w), n) for n, w in sorted(rules.THEMES.items())))).alias("themes"), T.occurrences(t, rules.GOOD).cast("long").alias("good"), T.occurrences(t, rules.BAD).cast("long").alias("bad"), T.any_of(t, rules.RUMOUR).alias("rumour"))
    got = df.select("i", T.literal_rules(t, rules).alias("r"), T.first_kind(t, rules.EVENTS).alias("k"))
    assert got.select("i", "r.*").orderBy("i").collect() == want.orderBy("i").collect()
    assert [r.k for r in got.orderBy("i").collect()] == [r.kind for r in want.orderBy("i").collect()]


def test_merged_articles_read_pages_that_are_written_once(spark, tmp_path):
    """No filter or projection of the four readers writes the pages anew: all that makes them stands before the staged table."""
    from tidemark import plans

    spark.sql("SELECT id * 8 + 5 AS doc_id, repeat('word ', 30) AS text FROM range(4)").write.parquet(f"{tmp_path}/documents.parquet")
    out = plans.queries()["merged_articles"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan and "documents.parquet" not in "".join(out.inputFiles())
    assert sorted(r.doc_id for r in out.collect()) == [5, 13, 21, 29]
