"""Model jobs with Spark ML: out-of-fold scores, calibration, temporal embedding, fusion weights, batch scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def classifier(kind: str, classes: int, label: str, weight: str | None, seed: int = 42, trees: int = 50, depth: int = 4, leaf: int = 1):
    own = {"weightCol": weight} if weight else {}
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **own)
    if kind == "logistic":
        return LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01, **own)
    one = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed, **own)
    return one if classes == 2 else OneVsRest(classifier=one, labelCol=label, featuresCol="features", **own)


def out_of_fold(df: DataFrame, features: list[str], label: str, folds: DataFrame, keys: list[str], kind: str = "forest", weight: str | None = None, least: int = 30, trees: int = 50, depth: int = 4, leaf: int = 1) -> DataFrame:
    """(keys, fold_id, alpha): P(last class) - P(first class) of each test row by a model of its fold's train rows.

    label: 0, 1 (, 2). folds: (keys, fold_id, role). A fold with fewer than `least` train rows or one class has alpha 0.
    The driver plans one fit a fold; rows stay distributed. Rows that lack a feature or the label are neither learnt from nor scored.
    """
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label]))
    rows = staged(data.join(folds, keys).select(*keys, "fold_id", "role", label, "features", *([weight] if weight else [])))  # each fold's fit reads it several times
    counts = {(r.fold_id, r[label]): r["count"] for r in rows.where("role = 'train'").groupBy("fold_id", label).count().collect()}  # folds x classes rows
    out = []
    for fold in sorted({f for f, _ in counts}):
        test = rows.where((F.col("fold_id") == fold) & (F.col("role") == "test"))
        classes = sorted(c for f, c in counts if f == fold)
        if len(classes) < 2 or sum(n for (f, _), n in counts.items() if f == fold) < least:
            out.append(test.select(*keys, "fold_id", F.lit(0.0).alias("alpha")))
            continue
        train = rows.where((F.col("fold_id") == fold) & (F.col("role") == "train"))
        model = classifier(kind, int(max(classes)) + 1, label, weight, trees=trees, depth=depth, leaf=leaf).fit(train)
        p = vector_to_array("probability")
        out.append(model.transform(test).select(*keys, "fold_id", (F.element_at(p, -1) - F.element_at(p, 1)).alias("alpha")))
    return reduce(DataFrame.unionByName, out)


def save_bundle(df: DataFrame, features: list[str], label: str, path: str, kind: str = "forest", trees: int = 200) -> None:
    """Fits assembler and learner on all complete rows and saves them as one pipeline."""
    rows = df.dropna(subset=[*features, label])
    classes = int(rows.agg(F.max(label)).first()[0] or 1) + 1
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), classifier(kind, classes, label, None, trees=trees)]
    Pipeline(stages=stages).fit(rows).write().overwrite().save(path)


def bundle_scores(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """(keys, alpha, p_up) of a feature table by a saved pipeline; rows that lack a feature have no score."""
    p = vector_to_array("probability")
    return PipelineModel.load(path).transform(df).select(*keys, (F.element_at(p, -1) - F.element_at(p, 1)).alias("alpha"), F.element_at(p, -1).alias("p_up"))


def calibrator(df: DataFrame, score: str, y: str, isotonic_from: int = 1000) -> PipelineModel:
    """Isotonic regression from `isotonic_from` rows on, else Platt scaling; its output is in column `calibrated`."""
    if df.where(F.col(score).isNotNull()).count() >= isotonic_from:
        stages = [IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="calibrated")]
    else:
        stages = [VectorAssembler(inputCols=[score], outputCol="_s", handleInvalid="skip"), LogisticRegression(featuresCol="_s", labelCol=y, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l")]
    return Pipeline(stages=stages).fit(df.withColumn(y, F.col(y).cast("double")))


def calibrated(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out if "calibrated" in out.columns else out.withColumn("calibrated", F.element_at(vector_to_array("_p"), 2)).drop("_s", "_p", "_r", "_l")


def temporal(windows: DataFrame, folds: DataFrame, keys: list[str], targets: list[str], width: int = 4, ridge: float = 1.0, least: int = 30) -> DataFrame:
    """(keys, embedding, forecast_<target>): principal components and ridge forecasts of test rows, fitted on each fold's train rows; null where those are fewer than `least`."""
    rows = staged(windows.withColumn("features", array_to_vector("window")).join(folds, keys))
    sizes = {r.fold_id: r for r in rows.groupBy("fold_id").agg(F.count_if(F.col("role") == "train").alias("all"), *(F.count_if((F.col("role") == "train") & F.col(t).isNotNull()).alias(t) for t in targets)).collect()}  # k rows
    out = []
    for fold in sorted(sizes):
        train, test = (rows.where((F.col("fold_id") == fold) & (F.col("role") == r)) for r in ("train", "test"))
        if sizes[fold]["all"] >= least:
            got = PCA(k=width, inputCol="features", outputCol="_e").fit(train).transform(test).withColumn("embedding", vector_to_array("_e"))
        else:
            got = test.withColumn("embedding", F.lit(None).cast("array<double>"))
        for t in targets:
            if sizes[fold][t] < least:
                got = got.withColumn(f"forecast_{t}", F.lit(None).cast("double"))
                continue
            fit = LinearRegression(featuresCol="features", labelCol=t, predictionCol=f"forecast_{t}", regParam=ridge, elasticNetParam=0.0).fit(train.where(F.col(t).isNotNull()))
            got = fit.transform(got)
        out.append(got.select(*keys, "embedding", *(f"forecast_{t}" for t in targets)))
    return reduce(DataFrame.unionByName, out)


def fusion(df: DataFrame, folds: DataFrame, keys: list[str], modalities: list[str], target: str) -> DataFrame:
    """(keys, alpha): modalities scaled by their train deviation and weighed by their train skill (non-negative mean IC), equal where none has any."""
    long = df.join(folds, keys).unpivot([*keys, "fold_id", "role", target], modalities, "modality", "x")
    train = long.where("role = 'train'")
    skill = train.groupBy("fold_id", "modality").agg(F.greatest(F.coalesce(F.try_divide(F.covar_samp("x", target), F.nullif(F.stddev_samp("x") * F.stddev_samp(target), F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("ic"), F.stddev_samp("x").alias("sd"), F.avg("x").alias("m"))
    by = Window.partitionBy("fold_id")
    w = skill.withColumn("w", F.when(F.sum("ic").over(by) > 0, F.col("ic") / F.sum("ic").over(by)).otherwise(1 / F.count(F.lit(1)).over(by)))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("sd")), F.lit(0.0))
    return long.where("role = 'test'").join(F.broadcast(w), ["fold_id", "modality"]).groupBy(*keys, "fold_id").agg(F.sum(F.col("w") * z).alias("alpha"))  # folds x modalities rows


def calibrated_out_of_fold(df: DataFrame, folds: DataFrame, keys: list[str], score: str, y: str, isotonic_from: int = 1000) -> DataFrame:
    """Adds `calibrated`: each test row's score through a calibrator fitted on its fold's train rows only."""
    rows = staged(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).join(folds, keys).where("role in ('train', 'test')"))
    out = []
    for fold in sorted(r.fold_id for r in rows.select("fold_id").distinct().collect()):  # k folds
        own = rows.where(F.col("fold_id") == fold)
        model = calibrator(own.where("role = 'train'"), score, y, isotonic_from)
        out.append(calibrated(model, own.where("role = 'test'")).select(*keys, score, y, "calibrated"))
    return reduce(DataFrame.unionByName, out)


def diagnostics(df: DataFrame, y: str, raw: str, better: str, bins: int = 10) -> DataFrame:
    """One row: n, base rate, and calibration error and Brier score of two probabilities of one outcome."""
    from .labels import calibration_error

    brier = lambda c: F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y)))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_rate"), brier(raw).alias("brier_raw"), brier(better).alias("brier_calibrated"))
    ece = lambda c, name: calibration_error(df, y, c, bins).select(F.col("ece").alias(name))
    return one.crossJoin(ece(raw, "ece_raw")).crossJoin(ece(better, "ece_calibrated"))  # one row each


def gross_scalar(df: DataFrame, p: str, threshold: float = 0.55) -> DataFrame:
    """(ts, scalar): share of rows of a time whose calibrated probability is above the threshold."""
    return df.groupBy("ts").agg(F.avg((F.col(p) > threshold).cast("double")).alias("scalar"))
