"""Hand-computed cases and invariants of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.functions import rolling as R
from tidemark.operators import asof as J
from tidemark.operators import bars as B
from tidemark.operators import cleaning as C
from tidemark.operators import labels as L
from tidemark.operators import portfolio as P
from tidemark.operators import statistics as N
from tidemark.operators import text as T
from tidemark.sources import payloads

T0 = dt.datetime(2024, 1, 1)


def hours(n: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=n)


def path(spark, prices, special=None):
    """Hourly bars with open = high = low = close, `special` overwriting (high, low) by place."""
    rows = []
    for i, p in enumerate(prices):
        hi, lo = (special or {}).get(i, (p, p))
        rows.append(("A", hours(i), float(p), float(hi), float(lo), float(p), hours(i + 1) + dt.timedelta(seconds=30)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, availability_ts timestamp")


WARM = [101.0 if i % 2 else 99.0 for i in range(26)]


def label(spark, prices, special=None, **options):
    grid = spark.createDataFrame([("A", hours(26) + dt.timedelta(minutes=1))], "symbol string, decision_time timestamp")
    return L.triple_barrier(path(spark, prices, special), grid, **options).first()


def test_upper_touch(spark):
    r = label(spark, WARM + [100.0] * 40, {30: (200.0, 100.0)})
    assert (r.label, r.reason) == (1, "upper_touch")


def test_dual_touch(spark):
    r = label(spark, WARM + [100.0] * 40, {30: (200.0, 20.0)})
    assert (r.label, r.reason) == (0, "dual_touch_ambiguous")


def test_vertical_neutral(spark):
    r = label(spark, WARM + [100.0] * 60, vertical_s=86400)
    assert (r.label, r.reason) == (0, "vertical_neutral")


def test_short_return_and_funding(spark):
    funding = spark.createDataFrame([("A", hours(28), -0.01), ("A", hours(29), -0.01)], "symbol string, timestamp timestamp, funding_rate double")
    grid = spark.createDataFrame([("A", hours(26) + dt.timedelta(minutes=1))], "symbol string, decision_time timestamp")
    r = L.triple_barrier(path(spark, WARM + [100.0] * 40, {35: (100.0, 20.0)}), grid, funding).first()
    assert r.label == -1 and r.raw_short == pytest.approx(1 - r.exit / r.entry)
    assert r.net_short == pytest.approx(r.raw_short - 0.02 - 0.0016)


@pytest.mark.parametrize("spans, want", [([(0, 2), (3, 5)], [1, 1]), ([(0, 4), (0, 4)], [0.5, 0.5]), ([(0, 2), (2, 4)], [1, 1]), ([(1, 1)], [1])])
def test_uniqueness(spark, spans, want):
    rows = [("A", i, hours(a), hours(b)) for i, (a, b) in enumerate(spans)]
    out = L.uniqueness(spark.createDataFrame(rows, "symbol string, i int, t0 timestamp, t1 timestamp"), "symbol", "t0", "t1")
    assert [r.uniqueness for r in out.orderBy("i").collect()] == pytest.approx(want)


def test_folds_never_overlap(spark):
    rows = [("A", hours(24 * i), hours(24 * i), hours(24 * i + 60)) for i in range(40)]
    x = spark.createDataFrame(rows, "symbol string, decision_time timestamp, t0 timestamp, t1 timestamp")
    out = L.purged_folds(x, ["symbol"], 4, 86400).join(x, ["symbol", "decision_time"])
    a, b = out.where("role = 'test'").alias("a"), out.where("role = 'train'").alias("b")
    assert a.join(b, F.expr("a.fold_id = b.fold_id and a.t0 < b.t1 and b.t0 < a.t1")).count() == 0
    assert out.where("role = 'test'").count() == 40


def test_calibration_of_perfect_scores(spark):
    x = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(10)], "y double, p double")
    assert L.calibration_error(x, "y", "p").first().ece == 0


def test_slippage_and_staleness(spark):
    x = spark.range(1).select(risk.slippage_bps(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(10.0)).alias("s"), *(risk.staleness(F.lit(float(a))).alias(f"t{a}") for a in (1, 5, 12))).first()
    assert (x.s, x.t1, x.t5, x.t12) == (5, "normal", "stale_warning", "skip")


def test_breaker_levels(spark):
    own = (0.10, 0.15, 0.20)
    x = spark.createDataFrame([(d,) for d in (0.05, 0.12, 0.16, 0.21)], "d double").select(risk.breaker_level(F.col("d"), F.lit(0.0), F.lit(0.02), own).alias("l"))
    assert [r.l for r in x.collect()] == [0, 1, 2, 3]


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1.0), ("z", 0.0)], "k string, q double")
    b = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "k string, q double")
    assert {r.k: r.matches for r in J.reconcile(a, b, "k").collect()} == {"x": True, "y": False, "z": True}


@pytest.mark.parametrize("bucket", [None, 3600, 7200])
def test_asof_ties_gaps_and_empty_keys(spark, bucket):
    left = spark.createDataFrame([("A", hours(h)) for h in (0, 1, 2.5, 30, 100)] + [("B", hours(1))], "k string, t timestamp")
    right = spark.createDataFrame([("A", hours(1), 1.0, 1), ("A", hours(1), 2.0, 2), ("A", hours(2), 3.0, 3), ("A", hours(50), 4.0, 4), ("C", hours(0), 9.0, 5)], "k string, at timestamp, v double, seq long")
    got = {(r.k, r.t): r.v for r in J.asof(left, right, ["k"], "t", "at", ["v"], "seq", bucket).collect()}
    assert got == {("A", hours(0)): None, ("A", hours(1)): 2.0, ("A", hours(2.5)): 3.0, ("A", hours(30)): 3.0, ("A", hours(100)): 4.0, ("B", hours(1)): None}


def test_asof_global_crosses_months(spark):
    left = spark.createDataFrame([(dt.datetime(2024, m, 15),) for m in (1, 2, 5)], "t timestamp")
    right = spark.createDataFrame([(dt.datetime(2024, 1, 20), 1.0), (dt.datetime(2024, 3, 1), 2.0)], "at timestamp, v double")
    assert [r.v for r in J.asof_global(left, right, "t", "at", ["v"]).orderBy("t").collect()] == [None, 1.0, 2.0]


@pytest.mark.parametrize("block", [2, 7, 256])
def test_ewma_equals_pandas(spark, block):
    pd = pytest.importorskip("pandas")
    values = [float((i * 37) % 11) for i in range(60)]
    x = spark.createDataFrame([("A", hours(i), v) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")
    got = [r.y for r in B.ewma(x, "symbol", "ts", {"y": ("x", 0.1)}, block).orderBy("ts").collect()]
    assert got == pytest.approx(pd.Series(values).ewm(alpha=0.1, adjust=False).mean().tolist())


def test_cleaning(spark):
    x = spark.createDataFrame([("A", hours(0), 1.0, 0.5, 2.0, 1.0, 5.0), ("A", hours(3), 2.0, 2.0, 2.0, -1.0, 1.0)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    rows = C.clean_bars(x, "1 hour", ["volume"]).orderBy("ts").collect()
    assert [r.close for r in rows] == [1, 1, 1, 1] and [r.volume for r in rows] == [5, 0, 0, 1] and rows[0].high == 2 and rows[0].low == 0.5
    assert {r.check: r.violations for r in C.quality_report(x, ["symbol", "ts"], ["close"]).collect()}["not_positive_close"] == 1


def test_spot_prices_of_zero_stay(spark, tmp_path):
    """A last spot price of 0 makes the premium infinite and its z-scores no number, as in the SQL; a bar keeps its low of 0."""
    from tidemark import plans

    from .oracle import connect, differences

    rows = [(i, dt.datetime(2024, 1, 1, h, m), 0, "click", 0.0 if (h, m) == (9, 20) else 5.0 + h, '{"k": 1}') for i, (h, m) in enumerate((h, m) for h in range(12) for m in (10, 15, 20, 21))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events"))
    next((tmp_path / "events").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("spot_perp_basis", "spot_bars"):
        got, want = plans.queries()[name](spark, str(tmp_path)).toPandas(), connect(str(tmp_path)).sql(plans.oracle_sql()[name]).df()
        finite = lambda df: df.replace([float("inf"), float("-inf")], [1e9, -1e9])
        assert len(want) > 10 and differences(finite(got), finite(want)) == ""
    assert (want["low"] == 0).any()


def test_rank_ties(spark):
    x = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "i int, v double").withColumn("k", F.lit(1))
    assert [r.r for r in x.select("i", R.average_rank("v", ["k"]).alias("r")).orderBy("i").collect()] == [1.5, 1.5, 3.0, None]


def test_weights_are_neutral_and_capped(spark):
    x = spark.createDataFrame([("r", hours(0), s, v) for s, v in (("A", 1.0), ("B", -0.5), ("C", 0.3))], "run_id string, ts timestamp, symbol string, w double")
    out = [r.w for r in P.neutral(x, "w").collect()]
    assert sum(out) == pytest.approx(0) and sum(map(abs, out)) == pytest.approx(1)
    assert sum(abs(r.w) for r in P.normalised(x).collect()) == pytest.approx(1)


def test_overfitting_of_edge_and_noise(spark):
    import random

    rnd = random.Random(2)
    noise = [(f"c{j}", hours(i), rnd.gauss(0, 0.01)) for i in range(240) for j in range(6)]
    edge = [(c, t, r + (0.004 if c == "c0" else 0)) for c, t, r in noise]
    value = lambda rows: N.overfit_probability(spark.createDataFrame(rows, "run_id string, ts timestamp, ret double"), 8).first().pbo
    assert value(edge) < 0.5 and value(noise) >= 0.3


def test_text(spark):
    page = '<html><head><meta name="og:title" content="A &amp; B"></head><body><article><p>Short.</p><p>A paragraph of some length &copy; here.</p><p>Please subscribe to our newsletter today.</p></article></body></html>'
    x = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    r = x.select(T.meta_content(F.col("h"), ["og:title"]).alias("m"), T.article_body(F.col("h")).alias("b"), T.clean_text(F.col("h")).alias("t")).collect()
    assert r[0].m == "A &amp; B" and r[0].b == "A paragraph of some length &copy; here." and "©" in r[0].t
    assert r[1].b is None and r[2].t is None


def test_json_ld(spark):
    page = '<script type="application/ld+json">{"@graph": [{"headline": "H", "author": {"name": "X"}}]}</script><script type="application/ld+json">broken</script>'
    r = T.json_ld(spark.createDataFrame([(1, page)], "id int, h string"), "h", ["id"], ["headline"]).first()
    assert r.headline == "H"


def test_payloads(spark):
    x = spark.createDataFrame([(1, '[[1700000000000, 5], [1700000001, 6]]'), (2, '[{"date": 1700000000, "a": 1, "b": 2}]'), (3, None)], "id int, c string")
    rows = payloads.chart_rows(x, "c", ["id"]).orderBy("id", "value").collect()
    assert [r.value for r in rows] == [5, 6, 3] and rows[0].ts == rows[2].ts
    feed = spark.createDataFrame([("<rss><item><title>T</title><link>L</link><pubDate>D</pubDate></item></rss>",)], "x string")
    assert payloads.feed_rows(feed, "x", []).first().title == "T"
    assert payloads.json_rows(spark.createDataFrame([('{"n": "x1"}',)], "j string"), "j", "n string", ["n"]).first().n is None


def test_score_distinct_uses_the_cache(spark):
    x = spark.createDataFrame([("a",), ("a",), ("bb",)], "t string")
    _, cache = T.score_distinct(x.limit(1), "t", T.length_scorer, "key string, score double")
    rows, full = T.score_distinct(x, "t", T.length_scorer, "key string, score double", cache)
    assert sorted(r.score for r in rows.collect()) == [1, 1, 2] and full.count() == 2


@pytest.mark.parametrize("seq, want", [(None, 10.0), ("n", 9.0)])
def test_asof_ties_go_to_the_largest(spark, seq, want):
    right = spark.createDataFrame([("A", hours(1), 9.0, 3), ("A", hours(1), 10.0, -20), ("A", hours(1), 9.5, -3)], "k string, t timestamp, v double, n long")
    left = spark.createDataFrame([("A", hours(2))], "k string, at timestamp")
    for bucket in (None, 1800):
        assert J.asof(left, right, ["k"], "at", "t", ["v"], seq, bucket).first().v == want


@pytest.mark.parametrize("bucket", [3600, 7 * 86400])
def test_next_and_interval_sums_over_buckets(spark, bucket):
    right = spark.createDataFrame([("A", hours(h), float(h)) for h in (1, 5, 5.5, 30)], "k string, t timestamp, v double")
    left = spark.createDataFrame([("A", hours(a), hours(b)) for a, b in ((0, 1), (1, 5.5), (5, 40), (31, 50))] + [("B", hours(0), hours(9))], "k string, a timestamp, b timestamp")
    got = {(r.k, r.a): r.v for r in J.next_after(left, right, ["k"], "a", "t", ["v"], bucket).collect()}
    assert got == {("A", hours(0)): 1.0, ("A", hours(1)): 5.0, ("A", hours(5)): 5.5, ("A", hours(31)): None, ("B", hours(0)): None}
    sums = {(r.k, r.a): r.s for r in J.interval_sum(left, right, ["k"], "a", "b", "t", "v", "s", bucket).collect()}
    assert sums == {("A", hours(0)): 1.0, ("A", hours(1)): 10.5, ("A", hours(5)): 35.5, ("A", hours(31)): 0.0, ("B", hours(0)): 0.0}


@pytest.mark.parametrize("block, depth", [(4, 0), (4, 3), (64, 2)])
def test_hysteresis_equals_a_loop(spark, block, depth):
    import random

    rng = random.Random(3)
    scores = [(k, hours(i), None if rng.random() < 0.02 else rng.uniform(-0.04, 0.04)) for k in "AB" for i in range(700)]
    want, p = {}, {}
    for k, t, s in scores:
        q = p.get(k, 0)
        if s is None:
            q = 0
        elif q == 0:
            q = 1 if s > 0.02 else -1 if s < -0.02 else 0
        elif q == 1:
            q = 0 if s < 0.005 else 1
        else:
            q = 0 if s > -0.005 else -1
        p[k] = want[k, t] = q
    df = spark.createDataFrame(scores, "symbol string, ts timestamp, score double")
    got = {(r.symbol, r.ts): r.position for r in P.hysteresis(df, 0.02, 0.005, ["symbol"], block, depth).collect()}
    assert got == want


def test_long_series_of_automata_stay_linear(spark):
    import time

    rows = spark.range(64_000).select(F.lit("r").alias("run_id"), F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.sin(F.col("id") / 50.0) * 0.03).alias("score"))
    start = time.time()
    got = P.hysteresis(rows, 0.02, 0.005, ["symbol"]).groupBy("position").count().collect()
    assert sum(r["count"] for r in got) == 64_000 and len(got) == 3 and time.time() - start < 20
    held = P.no_trade_band(rows.withColumnRenamed("score", "w"), 0.01)
    moves = held.withColumn("m", F.col("w") != F.lag("w").over(R.series("symbol", "ts"))).agg(F.count_if("m").alias("m"), F.count("w").alias("n")).first()
    assert moves.n == 64_000 and 0 < moves.m < 6_000
