"""Commits, contracts, carried columns, labels, weights, gates and diagnostics by hand-computed cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as J
from tidemark.operators import cleaning as C
from tidemark.operators import decisions as D
from tidemark.operators import labels as L
from tidemark.operators import models as ML
from tidemark.operators import portfolio as P
from tidemark.operators import statistics as N
from tidemark.sources import commit, contract

T0 = dt.datetime(2024, 1, 1)
hours = lambda h: T0 + dt.timedelta(hours=h)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    assert commit.commit(a, root, by=("k",)) == 1
    many = spark.range(2000).select(F.lit("y").alias("k"), F.col("id").cast("int").alias("v"))
    with pytest.raises(Exception, match="stopped half way"):
        commit.commit(commit.failing(many.repartition(8), F.col("v") == 1990), root, by=("k",))
    assert rows_of(commit.table(spark, root)) == [("x", 1), ("x", 2), ("y", 3)] and commit.versions(spark, root) == [1]
    assert commit.commit(a.where("k = 'y'").withColumn("v", F.lit(9)), root, by=("k",)) == 2
    assert rows_of(commit.table(spark, root)) == [("x", 1), ("x", 2), ("y", 9)]
    assert rows_of(commit.table(spark, root, version=1)) == [("x", 1), ("x", 2), ("y", 3)]
    with pytest.raises(commit.Conflict):
        commit.commit(a, root, by=("k",), base=1)
    assert commit.commit(a.limit(0), root, by=("k",), whole=True) == 3 and commit.table(spark, root).count() == 0
    assert commit.vacuum(spark, root, keep=2) >= 1 and rows_of(commit.table(spark, root, version=2)) == [("x", 1), ("x", 2), ("y", 9)]
    with pytest.raises(FileNotFoundError):
        commit.table(spark, root, version=1)


def test_labels_are_refused_before_anything_is_read(spark):
    boom = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("symbol"), F.lit(T0).alias("decision_time"), F.lit(1.0).alias("fwd_4h"), F.lit(1.0).alias("ret"))
    with pytest.raises(ValueError, match="fwd_4h"):
        contract.features(boom)
    with pytest.raises(ValueError, match="missing keys"):
        contract.features(boom.drop("symbol", "fwd_4h"))
    assert contract.features(boom, allowed=("fwd_4h",)).columns == boom.columns
    late = spark.createDataFrame([("A", T0, hours(1))], "symbol string, decision_time timestamp, oi_available_time timestamp")
    assert contract.strict(late.withColumn("decision_time", F.lit(hours(2)))).first().max_feature_available_time == hours(1)
    with pytest.raises(Exception, match="newer than its decision"):
        contract.strict(late).collect()


def test_names_of_markets(spark):
    x = spark.createDataFrame([("btc",), ("BTC/USDT",), ("btc-usdt",), ("USDT",), (None,)], "n string")
    got = [tuple(r) for r in x.select(contract.pair(F.col("n")), contract.base(F.col("n")), contract.slashed(F.col("n")), contract.slug(F.col("n"))).collect()]
    assert got == [("BTCUSDT", "BTC", "BTC/USDT", "btc"), ("BTCUSDT", "BTC", "BTC/USDT", "btc_usdt"), ("BTCUSDT", "BTC", "BTC/USDT", "btc_usdt"), ("USDTUSDT", "USDT", "USDT/USDT", "usdt"), (None,) * 4]


@pytest.mark.parametrize("bucket", [None, 3600])
def test_each_column_is_carried_with_its_own_lag(spark, bucket):
    right = spark.createDataFrame([(1, hours(0), 1.0, 10.0), (1, hours(1), None, 20.0), (1, hours(2), 3.0, None), (2, hours(0), 7.0, None)], "k int, ts timestamp, a double, b double")
    left = spark.createDataFrame([(1, hours(h)) for h in range(6)] + [(2, hours(5)), (3, hours(5))], "k int, at timestamp")
    got = {(r.k, r["at"]): (r.a, r.b, r.b_at) for r in J.carried(left, right, ["k"], "at", "ts", {"a": 0, "b": 3 * 3600}, bucket).collect()}
    want = {(1, hours(0)): (1.0, None, None), (1, hours(1)): (1.0, None, None), (1, hours(2)): (3.0, None, None), (1, hours(3)): (3.0, 10.0, hours(3)), (1, hours(4)): (3.0, 20.0, hours(4)), (1, hours(5)): (3.0, 20.0, hours(4)), (2, hours(5)): (7.0, None, None), (3, hours(5)): (None, None, None)}
    assert got == want


def test_finer_bars_settle_what_an_hour_leaves_open(spark):
    bars = [("A", hours(h), 100.0, 101.0, 99.0, 100.0) for h in range(30)] + [("A", hours(30), 100.0, 120.0, 80.0, 104.0)] + [("A", hours(h), 100.0, 100.5, 99.5, 100.0) for h in range(31, 60)]
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double").withColumn("availability_ts", F.expr("ts + interval 1 hour"))
    grid = spark.createDataFrame([("A", hours(27))], "symbol string, decision_time timestamp")
    coarse = L.triple_barrier(b, grid).first()
    assert (coarse.label, coarse.reason, coarse.exit, coarse.exit_time) == (0, "dual_touch_ambiguous", 104.0, hours(30))
    asked = []

    def finer(minutes):
        rows = [("A", hours(30) + dt.timedelta(minutes=m), hi, lo, 100.0) for m, hi, lo in minutes]
        fine = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
        return lambda hours_: asked.append(rows_of(hours_)) or fine

    down = L.triple_barrier(b, grid, finer=finer([(1, 101.0, 99.5), (2, 101.0, 80.0), (3, 120.0, 99.0)])).first()
    assert (down.label, down.reason, down.exit_time) == (-1, "lower_touch", hours(30) + dt.timedelta(minutes=2)) and down.exit < 100
    both = L.triple_barrier(b, grid, finer=finer([(1, 120.0, 80.0)])).first()
    assert (both.label, both.reason, both.exit) == (0, "dual_touch_ambiguous", 104.0) and asked[0] == [("A", hours(30))]
    none = L.triple_barrier(b, grid, finer=finer([(1, 100.1, 99.9)])).first()
    assert (none.label, none.exit_time) == (0, hours(30))


def test_pooled_uniqueness(spark):
    rows = [("A", 0, 2), ("A", 10, 12), ("B", 0, 2), ("B", 20, 20)]
    x = spark.createDataFrame([(s, hours(a), hours(b)) for s, a, b in rows], "s string, t0 timestamp, t1 timestamp")
    got = [(r.s, r.t0, round(r.uniqueness, 9)) for r in L.pooled_uniqueness(x, "s", "t0", "t1", normalise=False).orderBy("t0", "s").collect()]
    assert got == [("A", hours(0), 0.5), ("B", hours(0), 0.5), ("A", hours(10), 1.0), ("B", hours(20), 1.0)]
    dense = x.union(x.where("s = 'A'").withColumns({"t0": F.lit(hours(40)), "t1": F.lit(hours(41))}))
    w = L.pooled_uniqueness(dense, "s", "t0", "t1")
    total = {r.s: r.w for r in w.groupBy("s").agg(F.sum("uniqueness").alias("w")).collect()}
    assert math.isclose(sum(total.values()), 6.0) and w.count() == 6  # both copies of the new row are counted


def test_windows_of_channels(spark):
    rows = [("A", hours(h), float(h + 1), float(h % 2)) for h in range(6)]
    got = L.channel_windows(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, v double"), ["close", "v"], 3, {"f": 1}).orderBy("ts").collect()
    assert [r.ts for r in got] == [hours(2), hours(3), hours(4)] and len(got[0].window) == 6
    z = np.array(got[0].window).reshape(3, 2)
    assert np.allclose(z[:, 0], (np.array([1, 2, 3]) - 2) / np.std([1, 2, 3])) and np.allclose(z[:, 1], (np.array([0, 1, 0]) - 1 / 3) / np.std([0, 1, 0]))
    assert math.isclose(got[0].f, 4 / 3 - 1)


def test_training_rows_after_the_limit_are_an_error(spark):
    x = spark.createDataFrame([(hours(0), hours(5))], "decision_time timestamp, t1 timestamp")
    assert L.guarded(x, "2024-01-01 05:00:00", "decision_time", "t1").count() == 1
    with pytest.raises(Exception, match="training rows after"):
        L.guarded(x, "2024-01-01 04:00:00", "decision_time", "t1").collect()


def test_overfitting_by_a_measure_of_the_user(spark):
    rng = np.random.default_rng(1)
    returns = rng.normal(size=(240, 6)) * 0.01
    returns[:, 3] += 0.004
    x = spark.createDataFrame([(f"r{j}", hours(i), float(returns[i, j])) for i in range(240) for j in range(6)], "run_id string, ts timestamp, ret double")

    @F.pandas_udf("double")
    def mean(n: pd.Series, s: pd.Series, q: pd.Series) -> float:
        return float(s.dropna().sum() / n.dropna().sum())

    own = N.overfit_probability(x, 6, mean).first()
    built_in = N.overfit_probability(x, 6, lambda n, s, q: F.sum(s) / F.sum(n)).first()
    assert own == built_in and own.n_splits == 20 and own.pbo < 0.5


def test_deflated_sharpe_and_regimes_by_hand(spark):
    from statistics import NormalDist

    normal = NormalDist()
    rng = np.random.default_rng(4)
    r = rng.normal(0.001, 0.01, 300)
    got = N.deflated_sharpe(spark.createDataFrame([("a", hours(i), float(v)) for i, v in enumerate(r)], "run_id string, ts timestamp, ret double"), 10).first()
    sr, g = r.mean() / r.std(ddof=1), 0.5772156649015329
    z = (1 - g) * normal.inv_cdf(0.9) + g * normal.inv_cdf(1 - 1 / (10 * math.e))
    c = (r - r.mean()) / r.std()
    skew, excess = (c**3).mean(), (c**4).mean() - 3
    sigma = math.sqrt((1 - skew * sr + (excess + 2) / 4 * sr * sr) / 299)
    assert math.isclose(got.sharpe, sr, rel_tol=1e-9) and math.isclose(got.dsr, normal.cdf((sr - z * sigma) / sigma), rel_tol=1e-6)


def test_regimes_by_year_by_hand(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(50, 3)) + rng.normal(size=(50, 1))
    x = spark.createDataFrame([("abc"[j], hours(i), float(m[i, j])) for i in range(50) for j in range(3)], "symbol string, ts timestamp, ret double")
    got, c = D.regime_by_year(x).first(), np.corrcoef(m.T)
    assert math.isclose(got.pc1_share, np.linalg.eigvalsh(c)[-1] / 3, rel_tol=1e-9) and math.isclose(got.avg_pair_corr, c[np.triu_indices(3, 1)].mean(), rel_tol=1e-9)
    assert math.isclose(got.xs_dispersion, m.std(axis=1, ddof=1).mean(), rel_tol=1e-9)


def test_books_of_a_signal(spark):
    rng = np.random.default_rng(6)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (80, 3)), axis=0))
    bars = spark.createDataFrame([("abc"[j], hours(4 * i), float(close[i, j])) for i in range(80) for j in range(3)], "symbol string, ts timestamp, close double")
    one = {(r.ts, r.symbol): r.w for r in P.multiscale_weights(bars, (5,)).collect()}
    two = {(r.ts, r.symbol): r.w for r in P.momentum_weights(bars, lookback=5).collect()}
    assert all(math.isclose(one[k], two[k], abs_tol=1e-12) for k in one) and any(one.values())
    flat = P.multiscale_weights(spark.createDataFrame([("a", hours(i), 100.0) for i in range(60)], "symbol string, ts timestamp, close double"), (5, 9))
    assert {r.w for r in flat.collect()} == {0.0}
    strong = P.signal_weights(bars, bars.select("symbol", "ts", F.lit(5.0).alias("signal"))).where("w <> 0").agg(F.min("w").alias("a"), F.sum(F.abs("w")).alias("s")).first()
    assert strong.a > 0
    with pytest.raises(ValueError):
        P.multiscale_weights(bars, ())
    with pytest.raises(ValueError):
        D.deployed(bars.select("symbol", "ts", F.lit(0.1).alias("alpha")), "other")
    simple = D.deployed(bars.select("symbol", "ts", F.lit(0.1).alias("alpha"), F.lit(0.5).alias("meta")), "simple")
    assert {r.w for r in simple.collect()} == {0.0}  # the gate is shut
    held = D.deployed(bars.select("symbol", "ts", F.lit(0.1).alias("alpha")), "simple", band=0.01)
    assert {round(r.w, 9) for r in held.collect()} == {0.125}


def test_panels(spark):
    x = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("b", 2, 5.0)], "k string, t int, v double")
    assert rows_of(C.panel(x, "k", "t", ["v"])) == [("a", 2, 1.0), ("a", 3, 1.0), ("b", 2, 5.0), ("b", 3, 5.0)]
    assert rows_of(C.panel(x, "k", "t", ["v"], complete=False))[0] == ("a", 1, 1.0) and C.panel(x, "k", "t", ["v"], complete=False).count() == 6


def test_gates(spark):
    row = lambda schema, *v: spark.createDataFrame([v], schema)
    ladder = spark.createDataFrame([("base", 1.0, False), ("more", 1.5, True)], "run_id string, mean_sharpe double, included boolean")
    ablation = spark.createDataFrame([("plain", 2.0), ("rich", 1.0)], "run_id string, t_stat double")
    got = {r.gate: (r.value, r.passed) for r in D.acceptance(row("n_look_ahead long", 0), row("ece double", 0.06), ladder, ablation, row("pbo double", None), "base", "plain", ["rich"]).collect()}
    assert got == {"no_look_ahead": (0.0, True), "calibration": (0.06, False), "increment": (1.0, True), "enriched_features": (-1.0, False), "overfitting": (None, False), "beats_baseline": (0.5, True)}


def test_decision_tables(spark):
    row = ("2024-01-01 00:00:00", "A", "x", "flat", "none", None, "7", "true", "r", "{}", "2024-01-01")
    x = spark.createDataFrame([row, ("bad time", *row[1:7], "no", *row[8:])], ", ".join(f"{c} string" for c in D.STANDARD))
    a, b = D.validated(x).orderBy("risk_approved", ascending=False).collect()
    assert (a.target_position, a.signal_score, a.confidence, a.risk_approved) == (0.0, 0.0, 1.0, True) and b.decision_time is None and not b.risk_approved
    assert D.loaded(D.validated(x)).count() == 1
    with pytest.raises(ValueError, match="audit_log"):
        D.validated(x.drop("audit_log"))
    ids = spark.range(1).select(*(D.audit_id(F.lit("A"), F.lit(T0), m, "d", "c", {"b": 1, "a": v}) for m, v in (("m", 1), ("m", 2), ("n", 1), ("m", 1)))).first()
    assert ids[0] == ids[3] and len(set(ids)) == 3


@pytest.fixture(scope="module")
def two_rules(spark):
    """y follows f in rows of weight 1 and its opposite in more rows of weight ~0."""
    rows = [("A", hours(i), float(i % 7), float((i % 7 > 3) == (i % 3 == 0)), 1.0 if i % 3 == 0 else 1e-6) for i in range(420)]
    x = spark.createDataFrame(rows, "symbol string, decision_time timestamp, f double, y double, w double").withColumns({"t0": F.col("decision_time"), "t1": F.col("decision_time")})
    return x, L.purged_folds(x.select("symbol", "decision_time", "t0", "t1"), ["symbol"], 3, 0)


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_weights_reach_the_learner(two_rules, kind):
    x, folds = two_rules
    slope = lambda w: ML.out_of_fold(x, ["f"], "y", folds, ["symbol", "decision_time"], kind, weight=w, trees=5).join(x, ["symbol", "decision_time"]).agg(F.corr("alpha", "f")).first()[0]
    assert slope("w") > 0.5 and slope(None) < -0.5


def test_calibration_knows_no_test_row(spark, two_rules):
    """Scores say the opposite of the outcome in the test fold only: a calibrator that had seen it would turn them round."""
    x, folds = two_rules
    test = folds.where("fold_id = 1 and role = 'test'").select("symbol", "decision_time", F.lit(True).alias("t"))
    s = x.join(test, ["symbol", "decision_time"], "left").select("symbol", "decision_time", (F.col("f") / 7).alias("p"), F.when(F.col("t"), (F.col("f") <= 3).cast("double")).otherwise((F.col("f") > 3).cast("double")).alias("y"))
    out = ML.calibrated_out_of_fold(s, folds.where("fold_id = 1"), ["symbol", "decision_time"], "p", "y")
    assert out.count() == test.count() and out.agg(F.corr("calibrated", "p")).first()[0] > 0.5
    d = ML.diagnostics(out, "y", "p", "calibrated").first()
    assert d.n == out.count() and d.brier_calibrated > d.brier_raw > 0


def test_bands_of_a_stream_go_on_in_the_next_batch(spark, tmp_path):
    from tidemark.plans.streams import state_store
    from tidemark.streaming import jobs

    w = [0.0, 0.2, 0.4, 0.1, None, 0.5, 0.65]
    schema = "run_id string, symbol string, ts timestamp, w double"
    rows = [("r", "A", hours(i), v) for i, v in enumerate(w)]
    want = {(r.ts, r.w) for r in P.no_trade_band(spark.createDataFrame(rows, schema), 0.3).collect()}
    with state_store(spark):
        for part in (rows[:3], rows[3:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = jobs.band_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 0.3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination()
    assert {(r.ts, r.w) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
