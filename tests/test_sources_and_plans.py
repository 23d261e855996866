"""Scans, sinks, plan shapes and model jobs."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import labels as L
from tidemark.operators import models as ML
from tidemark.sources import scan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def long(spark):
    rows = [(s, tf, T0 + dt.timedelta(hours=h), float(h)) for s in ("A", "B") for tf in ("1h", "4h") for h in range(5)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, timestamp timestamp, v double")


def test_scan_long(long):
    got = scan.scan_long(long, ["A"], "2024-01-01 01:00:00", "2024-01-01 03:00:00", "1h", ["symbol", "v"])
    assert [(r.symbol, r.v) for r in got.orderBy("v").collect()] == [("A", 1.0), ("A", 2.0)]
    with pytest.raises(ValueError):
        scan.scan_long(long, columns=["nope"])
    with pytest.raises(ValueError):
        scan.time_column(long.select("symbol"))
    assert scan.time_column(long.withColumnRenamed("timestamp", "when")) == "when"


def test_finite_and_sinks(spark, long, tmp_path):
    x = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 1.0), (4, None)], "i int, v double")
    assert [r.v for r in scan.finite(x, ["v"]).orderBy("i").collect()] == [None, None, 1.0, None]
    scan.write_partitions(long, str(tmp_path / "p"), ["symbol"])
    scan.write_partitions(long.where("symbol = 'A'").limit(3), str(tmp_path / "p"), ["symbol"])
    assert {r.symbol: r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy("symbol").count().collect()} == {"A": 3, "B": 10}
    for kind in ("csv", "json"):
        scan.write_text(long, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 20


def test_compaction(spark):
    main = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "k string, v int, seq int")
    parts = spark.createDataFrame([("b", 2, 3), ("c", 1, 4)], "k string, v int, seq int")
    merged, counts = scan.compaction(main, parts, ["k"], ["seq"])
    assert {r.k: r.v for r in merged.collect()} == {"a": 1, "b": 2, "c": 1}
    assert tuple(counts.first()) == (2, 2, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = _plan(plans.queries()["kline_range_scan"](spark, SF))
    read = next(x for x in p.split("\n") if "FileScan" in x)
    assert "IN (click,error)" in read and ">= 2024-01-05" in read and "user_id" not in read.split("]")[0]
    assert p.count("Exchange") == 1


def test_three_sources_meet_in_one_window(spark):
    p = _plan(plans.queries()["pit_feature_table"](spark, SF))
    assert "SortMergeJoin" not in p.split("Union")[0] and "NestedLoop" not in p and "Cartesian" not in p


@pytest.fixture(scope="module")
def supervised(spark):
    rows = [("A", T0 + dt.timedelta(hours=i), float(i % 5), float(i % 5 > 2)) for i in range(120)]
    x = spark.createDataFrame(rows, "symbol string, decision_time timestamp, f double, y double")
    x = x.withColumns({"t0": F.col("decision_time"), "t1": F.expr("decision_time + interval 2 hours")})
    return x, L.purged_folds(x.select("symbol", "decision_time", "t0", "t1"), ["symbol"], 3, 3600)


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_out_of_fold_scores_each_row_once(supervised, kind):
    x, folds = supervised
    got = ML.out_of_fold(x, ["f"], "y", folds, ["symbol", "decision_time"], kind, trees=5).join(x, ["symbol", "decision_time"])
    assert got.count() == 120
    r = got.groupBy("y").agg(F.avg("alpha").alias("a")).collect()
    a = {row.y: row.a for row in r}
    assert a[1.0] > a[0.0] and -1 <= a[0.0] and a[1.0] <= 1


def test_one_class_and_few_rows_score_zero(supervised):
    x, folds = supervised
    assert {r.alpha for r in ML.out_of_fold(x.withColumn("y", F.lit(0.0)), ["f"], "y", folds, ["symbol", "decision_time"]).collect()} == {0.0}


@pytest.mark.parametrize("least", [10, 1000])
def test_calibration_is_monotone(supervised, least):
    x, _ = supervised
    x = x.select((F.col("f") / 5).alias("p"), "y")
    got = ML.calibrated(ML.calibrator(x, "p", "y", least), x).groupBy("p").agg(F.avg("calibrated").alias("c")).orderBy("p").collect()
    c = [r.c for r in got]
    assert c == sorted(c) and 0 <= c[0] and c[-1] <= 1


def test_fusion_prefers_the_skilled(supervised):
    x, folds = supervised
    x = x.withColumn("noise", (F.xxhash64("decision_time") % 7).cast("double"))
    got = ML.fusion(x, folds, ["symbol", "decision_time"], ["f", "noise"], "y").join(x, ["symbol", "decision_time"])
    assert got.agg(F.corr("alpha", "f")).first()[0] > 0.9


def test_joined_once_refuses_repeated_keys(spark):
    from tidemark.operators import cleaning as C

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, b double")
    assert [tuple(r) for r in C.joined_once(a, b, ["k"]).collect()] == [(1, "x", 1.0)]
    with pytest.raises(Exception, match="repeated key on the right"):
        C.joined_once(a, b.union(b), ["k"]).collect()


def test_model_inputs_by_alias(spark):
    x = spark.createDataFrame([(1, None, 2.0, 1.0), (2, math.inf, 3.0, 1.0), (3, 5.0, None, None)], "k int, vol_30d double, vol_96h double, m double")
    got = scan.model_inputs(x, ["k"], {"vol": ["vol_30d", "vol_96h"], "momentum": ["mom_z", "m"]})
    assert [tuple(r) for r in got.collect()] == [(1, 2.0, 1.0)]
    with pytest.raises(ValueError):
        scan.model_inputs(x, ["k"], {"vol": ["nope"]})


def test_saved_models_score_what_they_have_not_seen(spark, supervised, tmp_path):
    x = supervised[0] if isinstance(supervised, tuple) else supervised
    names = [c for c, kind in x.dtypes if kind == "double" and c not in ("y", "raw_long")][:2]
    ML.save_bundle(x, names, "y", str(tmp_path / "m"), trees=5)
    keys = [c for c in x.columns if c in ("symbol", "decision_time")]
    got = ML.bundle_scores(x.select(*keys, *names), str(tmp_path / "m"), keys)
    r = got.agg(F.min("p_up").alias("a"), F.max("p_up").alias("b"), F.count("alpha").alias("n")).first()
    assert 0 <= r.a <= r.b <= 1 and r.n == x.dropna(subset=names).count()
