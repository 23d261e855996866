"""Quality classifier by co-training of two views.

The content view hashes letter trigrams of the text (lower case, other characters as they are) to `DIMENSIONS` square-root
counts of length one. The metadata view knows the page, not its words: hashed source and language, logarithms of length
and number of lines, mean and variance of line lengths, and the shares of capitals, digits, punctuation and repeats
among neighbouring words. Each has a logistic regression.

Both start on labelled rows. In each round both classify every unlabelled document; each gives the other `exchange`
pseudo-labels, in the classes' proportions: of all documents that it is at least `confidence` sure of, those with the
smallest hashes, an even sample of them. Then both are fitted again. At the end each view's output is calibrated (Platt)
on labelled rows kept out of fitting, and the mean of the calibrated log-odds scores every document.

The labelled rows that are fitted on are a bounded sample, those with the `fit_rows` smallest hashes of their id; their
features (about 2 KB a row) are a table in the shared folder, and each view is fitted on it in a task of its own. The driver
has ids and labels of these rows, features of the exchanged ones (4 * `exchange` rows at most) and the weights, nothing else.
Rounds and scoring are by row, without a shuffle of texts.

Null and empty texts have the features of an empty page. A null label is no label. Without labels of both classes every
score is the share of good labels (1 without any). Rows with repeated ids are each scored; of those with a label, one is
fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import LOWER, NEWLINE, Pieces, chunks
from .shared import stored

DIMENSIONS = 1024
SOURCES, LANGUAGES = 16, 8
META = SOURCES + LANGUAGES + 9
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3


def content_features(run: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"\n\n".join(run) + b"\n\n", np.uint8)
    low = LOWER[raw].astype(np.uint32)
    size = np.array([len(b) + 2 for b in run])
    doc = np.repeat(np.arange(len(run), dtype=np.int64), size)
    key = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(22)
    own = np.ones(len(raw), bool)  # no trigram begins between two texts
    own[np.cumsum(size) - 1] = own[np.cumsum(size) - 2] = False
    out = np.bincount((doc[:-2] * DIMENSIONS + key)[own[:-2]], minlength=len(run) * DIMENSIONS).reshape(len(run), DIMENSIONS)
    out = np.sqrt(out.astype(np.float32))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-6)


def _one_hot(values: list[str | None], size: int) -> np.ndarray:
    out = np.zeros((len(values), size), np.float32)
    h = Pieces([(v or "\0").encode("utf-8", "surrogatepass") for v in values], np.zeros(256, bool) | NEWLINE, None)
    at = np.zeros(len(values), np.int64)
    at[h.doc] = (h.hash % np.uint64(size)).astype(np.int64)
    out[np.arange(len(values)), at] = 1
    return out


def metadata_features(run: list[bytes], source: list[str | None], lang: list[str | None]) -> np.ndarray:
    lines = Pieces(run, NEWLINE, None)
    words = Pieces(run)
    length = np.array([len(b) for b in run], np.float64)
    n_lines = np.maximum(1, lines.count)
    span = (lines.end - lines.start).astype(np.float64)
    mean = np.bincount(lines.doc, span, len(run)) / n_lines
    var = np.bincount(lines.doc, span * span, len(run)) / n_lines - mean**2
    kind = _KIND[lines.raw]
    doc = np.repeat(np.arange(len(run)), [len(b) + 1 for b in run])
    shares = [np.bincount(doc, kind == k, len(run)) / np.maximum(1, length) for k in (1, 2, 3)]
    again = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc[1:], again, len(run)) / np.maximum(1, words.count)
    word = np.bincount(words.doc, words.end - words.start, len(run)) / np.maximum(1, words.count)
    own = np.stack([np.log1p(length) / 5, np.log1p(n_lines) / 3, np.log1p(mean) / 5, np.log1p(np.maximum(0, var)) / 10, *(5 * s for s in shares), 5 * repeats, word / 10], 1)
    return np.concatenate([_one_hot(source, SOURCES), _one_hot(lang, LANGUAGES), own.astype(np.float32)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights (bias last) of the rows in `use`, by accelerated gradient descent; the mean loss has a Lipschitz constant below (1 + max |x|^2) / 4."""
    share = use.astype(np.float32) / max(1, use.sum())
    y, ridge = y.astype(np.float32), np.float32(ridge)
    rate = np.float32(1 / (0.25 * (1 + float(np.einsum("ij,ij->i", x, x).max())) + ridge))
    w = ahead = np.zeros(x.shape[1] + 1, np.float32)
    for i in range(steps):
        off = (_sigmoid(x @ ahead[:-1] + ahead[-1]) - y) * share
        fresh = ahead - rate * (np.append(off @ x, off.sum()) + ridge * ahead)
        ahead, w = fresh + np.float32(i / (i + 3)) * (fresh - w), fresh
    return w.astype(np.float64)


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log-odds, fitted by Newton steps with smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        r, s = p - t, p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return max(a, 1e-3), b


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    scales: tuple[tuple[float, float], tuple[float, float]]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.scales
        return _sigmoid((a * logit(self.content, content) + b + c * logit(self.metadata, metadata) + d) / 2)


def _views(run: list[bytes], source: list[str | None], lang: list[str | None]) -> np.ndarray:
    """Features of both views side by side, as they are kept."""
    return np.concatenate([content_features(run), metadata_features(run, source, lang)], 1).astype(np.float16)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, source, lang) to (key, features)."""
    for batch in batches:
        source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for at, run in chunks(batch.column(1)):
            both = _views(run, source[at : at + len(run)], lang[at : at + len(run)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array([x.tobytes() for x in both], pa.binary())], ["key", "features"])


def _confident(weights, confidence: float, kinds: list[tuple[int, int]]):
    """(doc_id, key, text, source, lang) to a row with features for each view that is sure of a document, for the given kinds (view, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for at, texts in chunks(batch.column(2)):
                part = slice(at, at + len(texts))
                both = _views(texts, source[part], lang[part])
                wide = both.astype(np.float32)
                for giver, x in enumerate((wide[:, :DIMENSIONS], wide[:, DIMENSIONS:])):
                    p = _sigmoid(logit(weights.value[giver], x))
                    for label, sure in ((0, 1 - p), (1, p)):
                        rows = np.flatnonzero(sure >= confidence) if (giver, label) in kinds else []
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), giver, np.int32)), pa.array(np.full(len(rows), label, np.int32)), *(batch.column(c).take(pa.array(np.asarray(rows, np.int64) + at)) for c in (0, 1)), pa.array([both[i].tobytes() for i in rows], pa.binary())],
                            ["giver", "label", "doc_id", "key", "features"],
                        )

    return run


def _fitted(given, platt_too: bool):
    """One view's labelled rows (place, doc_id, label, held, features) and the pseudo-labels `given` to it to its weights, and, if asked for, its scale and shift.

    Rows of the other view's pseudo-labels weigh nothing, so that both views have the same steps as in one table of all rows.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        view = key[0].as_py()
        size = META if view else DIMENSIONS
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        taken, pseudo, features = given.value
        n = table.num_rows
        x = np.empty((n + len(taken), size), np.float32)
        for i, b in enumerate(table.column("features")):
            x[i] = np.frombuffer(b.as_buffer(), np.float16)
        x[n:] = features[:, DIMENSIONS:] if view else features[:, :DIMENSIONS]
        held = table.column("held").to_numpy()
        y = np.concatenate([table.column("label").to_numpy(), pseudo]).astype(np.float64)
        w = logistic(x, y, np.concatenate([~held, taken == view]))
        scale = platt(logit(w, x[:n][held]), y[:n][held]) if platt_too else (1.0, 0.0)
        return pa.table({"view": pa.array([view], pa.int32()), "weights": pa.array([w.tolist()], pa.list_(pa.float64())), "scale": pa.array([scale[0]], pa.float64()), "shift": pa.array([scale[1]], pa.float64())})

    return run


def _fits(spark, rows: DataFrame, given: tuple[np.ndarray, np.ndarray, np.ndarray], platt_too: bool) -> tuple[list[np.ndarray], tuple]:
    """Weights, and scales and shifts, of both views, each fitted in a task of its own; only these reach the driver."""
    shared = spark.sparkContext.broadcast(given)
    own = F.when(F.col("view") == 0, F.substring("features", 1, 2 * DIMENSIONS)).otherwise(F.substring("features", 2 * DIMENSIONS + 1, 2 * META))
    views = rows.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("features", own)
    got = views.groupBy("view").applyInArrow(_fitted(shared, platt_too), "view int, weights array<double>, scale double, shift double").collect()
    shared.destroy()
    got = sorted(got, key=lambda r: r.view)
    return [np.array(r.weights) for r in got], tuple((r.scale, r["shift"]) for r in got)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = 6000, rounds: int = 2, exchange: int = 600, confidence: float = 0.95, label_col: str = "quality") -> Model:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null")
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")).where("doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(fit_rows)  # bounded by a parameter, so it may be broadcast
    rows = docs.select("doc_id", "text", "source", "lang").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(_features, "key long, features binary")
    rows = rows.groupBy(F.col("key").alias("doc_id")).agg(F.min("features").alias("features")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select(F.xxhash64("doc_id", F.lit(5)).alias("place"), "doc_id", "label", "features"), "labelled")
    got = rows.select("place", "doc_id", "label").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    y = got.column("label").to_numpy()
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        p = float(y.mean()) if len(y) else 1.0
        z = float(np.log((p + 1e-6) / (1 - p + 1e-6)))
        return Model(np.append(np.zeros(DIMENSIONS), z), np.append(np.zeros(META), z), ((1.0, 0.0), (1.0, 0.0)))
    good = y[~held].mean()
    wanted = np.array([round(exchange * (1 - good)), round(exchange * good)])
    apart = spark.createDataFrame(pa.table({"doc_id": got.column("doc_id"), "held": pa.array(held)}))
    rows = rows.join(F.broadcast(apart), "doc_id")
    every = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", "source", "lang")
    size = every.count()
    taken, pseudo, features = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, DIMENSIONS + META), np.float16)
    for r in range(rounds + 1):
        weights, scales = _fits(spark, rows, (taken, pseudo, features), r == rounds)
        if r == rounds:
            return Model(weights[0], weights[1], scales)
        for (giver, label), fresh in _exchanged(spark, every, known, weights, confidence, wanted, size).items():
            taken = np.append(taken, np.full(len(fresh), 1 - giver, np.int32))
            pseudo = np.append(pseudo, np.full(len(fresh), label, np.int32))
            features = np.concatenate([features, np.frombuffer(b"".join(fresh), np.float16).reshape(len(fresh), -1)]) if fresh else features


def _exchanged(spark, every: DataFrame, known: DataFrame, weights: list[np.ndarray], confidence: float, wanted: np.ndarray, size: int) -> dict[tuple[int, int], list[bytes]]:
    """(giver, label) -> features of the `wanted` unlabelled documents with the smallest keys of which the view is sure of the label.

    Documents are classified in ranges of keys, from the smallest on: the first range would do if a tenth of all documents
    were sure. The ranges widen, for the kinds that still lack rows, until each has its number or has seen all documents.
    """
    place = F.col("key") / 2.0**64 + 0.5
    shared = spark.sparkContext.broadcast(weights)
    found: dict[tuple[int, int], dict[int, bytes]] = {(g, label): {} for g in (0, 1) for label in (0, 1)}
    low, high = 0.0, min(1.0, 20 * float(wanted.max()) / max(1, size))
    while kinds := [k for k in found if len(found[k]) < wanted[k[1]]]:
        part = every.where((place >= low) & (place < high)) if high < 1 else every.where(place >= low)
        sure = part.mapInArrow(_confident(shared, confidence, kinds), "giver int, label int, doc_id long, key long, features binary").join(known.select("doc_id"), "doc_id", "left_anti")
        first = sure.groupBy("giver", "label", "key").agg(F.min("features").alias("features"))
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("giver", "label").orderBy("key"))).where("rank <= " + str(int(wanted.max())))
        for r in ranked.drop("rank").toArrow().to_pylist():  # four times the wanted number at most
            found[r["giver"], r["label"]].setdefault(r["key"], r["features"])
        if high >= 1:
            break
        low, high = high, min(1.0, 8 * high)
    shared.destroy()
    return {(g, label): [rows[k] for k in sorted(rows)[: int(wanted[label])]] for (g, label), rows in found.items()}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang, scores = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), []
            for at, texts in chunks(batch.column(batch.num_columns - 3)):
                scores.append(shared.value.score(content_features(texts), metadata_features(texts, source[at : at + len(texts)], lang[at : at + len(texts)])))
            keep = batch.columns[: batch.num_columns - 3]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names[: len(keep)], "quality_score"])

    return run


def with_scores(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of `documents` and `quality_score` (0 to 1, probability of good quality; it replaces a column of that name)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c != "quality_score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema.fields)
    mark = "_" * (1 + max(len(c) for c in kept))  # longer than any name there is
    inputs = documents.select(*kept, *(F.col(c).cast("string").alias(f"{c}{mark}") for c in ("text", "source", "lang")))
    return inputs.mapInArrow(_score(shared), f"{schema}, quality_score double")


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `documents` (all columns, one named quality_score too) with a score of `least` or more."""
    aside = "_" * (1 + max(len(c) for c in documents.columns))
    scored = with_scores(documents.withColumnRenamed("quality_score", aside), model).where(F.col("quality_score") >= least).drop("quality_score")
    return scored.withColumnRenamed(aside, "quality_score").select(*documents.columns)
