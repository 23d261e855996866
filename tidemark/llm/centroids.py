"""Clustering of vectors around moving centroids, exact in whole numbers, with bounds tightened by geometry.

Vectors of exactly `dims` finite components become whole numbers floor(64 * x). A round assigns every vector to its nearest
centroid (squared distance, ties to the smaller number) and moves each non-empty centroid to the floor of its vectors' mean.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to any other one. After a
round the upper bound grows by the own centroid's drift. The lower bound would fall by the largest drift; here it falls by less.
A cluster's vectors lie in a sphere (its radius is their largest upper bound). In the plane through the sphere's centre and a
centroid's old place a and new place b, all points whose distance shrinks by d or more lie inside a branch of a hyperbola with
foci a and b, hence inside the cone of its asymptotes, whose half-angle has the cosine d / |ab|: a sphere that keeps outside the
cone of half-angle t loses at most |ab| cos t (`loosening`). A vector whose upper bound stays under its lower bound keeps its
cluster unseen; all others are compared with every centroid, exactly.

How it scales: a round is one pass over a stored table of packed vectors and their bounds, written for the next round, so a
lost executor costs one pass over what it held. Tasks add up whole-number sums by cluster before anything is shuffled; the driver sees
k sums of `dims` numbers and k radii, whatever the number of vectors and however they share clusters.

Odd rows: null vectors, vectors of another length and those with a null or non-finite component are left out. Components beyond
+-2^27 after scaling, whose distances would not fit a long, count as 2^27. Rows that repeat an id are rows of their own; null ids are
kept and hashed as an empty text; ties of the start order are settled by the vector. Fewer rows than k are as many centroids; no rows
give no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored

SCALE, LIMIT = 64, 1 << 27
#: Bounds are doubles: a vector is left unseen only where they are apart by more than their rounding.
SLACK = 1e-9
#: Products of whole numbers up to here are exact as doubles in sums of up to 2^13 components.
SMALL = 1 << 19


def whole_vectors(df: DataFrame, dims: int, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, vec): the kept vectors as little-endian 32-bit whole numbers."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dims)
            good = np.isfinite(flat).all(axis=1)
            x = np.clip(np.floor(flat[good] * SCALE), -LIMIT, LIMIT).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vec"])

    fit = df.where(F.col(column).isNotNull() & (F.size(column) == dims) & ~F.exists(column, lambda x: x.isNull()))
    return fit.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(packed, "vec_id long, vec binary")


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors of least SHA-256 of `1:<vec_id>`, in that order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("vec", mark.alias("mark")).orderBy("mark", "vec").limit(k).collect()
    return np.array([np.frombuffer(r.vec, "<i4") for r in rows], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def loosening(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """The most that the distance from a point of the sphere can shrink where a centroid moves from a to b; negative where it must grow."""
    a, b, c = (v.astype(np.float64) for v in (a, b, centre))
    drift = float(np.linalg.norm(b - a))
    if drift == 0:
        return 0.0
    along = float((c - a) @ (b - a)) / drift  # the centre's place along the line from a to b
    across = float(np.sqrt(max(0.0, ((c - a) ** 2).sum() - along * along)))
    bounds = [drift]
    u = along - drift / 2
    far = float(np.hypot(u, across))
    if far > radius:
        angle = np.arctan2(across, u) - np.arcsin(radius / far)
        bounds.append(drift * np.cos(np.clip(angle, 0, np.pi / 2)))
    # |x - a| - |x - b| = drift * (2 along(x) - drift) / (|x - a| + |x - b|), with along(x) <= along + radius
    top, both = drift * (2 * (along + radius) - drift), float(np.linalg.norm(c - a) + np.linalg.norm(c - b))
    bounds.append(top / max(drift, both - 2 * radius) if top > 0 else top / (both + 2 * radius))
    return min(bounds) + SLACK * (1 + drift + far)


def moved(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster: by how much its vectors' upper bounds grow, and by how much their lower bounds fall."""
    up = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    down = np.array([max((loosening(old[i], radii[i], old[j], new[j]) for j in range(len(old)) if j != i), default=0.0) for i in range(len(old))])
    return up, down


STATE = "vec_id long, vec binary, cluster int, upper double, lower double, scanned boolean, distance long"


def assigned(table: DataFrame, centroids: np.ndarray, bounds: tuple | None = None, last: bool = False) -> DataFrame:
    """Every vector with its nearest centroid and its bounds; without `bounds` (how those of the round before change) all are scanned.

    In the last round `distance` is the exact squared distance, also of vectors that were not scanned.
    """
    k = len(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(n, -1).astype(np.int64)
            if bounds is None:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
            else:
                cluster = batch.column(2).to_numpy()
                upper, lower = batch.column(3).to_numpy() + bounds[0][cluster], batch.column(4).to_numpy() - bounds[1][cluster]
            cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
            scan = ~(upper * (1 + SLACK) + SLACK < lower)
            if bounds is not None:  # the distance to the own centroid often settles it
                upper[scan] = np.sqrt(((x[scan] - centroids[cluster[scan]]) ** 2).sum(axis=1))
                scan = ~(upper * (1 + SLACK) + SLACK < lower)
            if scan.any():
                d = squared(x[scan], centroids)
                own = d.argmin(axis=1)
                cluster[scan], upper[scan] = own, np.sqrt(d[np.arange(len(d)), own])
                d[np.arange(len(d)), own] = np.iinfo(np.int64).max
                lower[scan] = np.sqrt(d.min(axis=1)) if k > 1 else np.inf
            distance = ((x - centroids[cluster]) ** 2).sum(axis=1) if last else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scan), pa.array(distance)], [c.split()[0] for c in STATE.split(", ")])

    return table.mapInArrow(nearest, STATE)


def sums(table: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums of components, counts and radii by cluster: each task adds up its own before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, radius = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(batch.num_rows, dims)
            cluster = batch.column(1).to_numpy()
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0, dtype=np.int64)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, batch.column(2).to_numpy())
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at])), pa.array(count[at]), pa.array(radius[at])], ["cluster", "total", "n", "radius"])

    parts = table.select("vec", "cluster", "upper").mapInArrow(partial, "cluster int, total array<long>, n long, radius double")
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims)))
    total, count, radius = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k)
    for r in each.collect():
        total[r.cluster], count[r.cluster], radius[r.cluster] = list(r)[3:], r.n, r.radius
    return total, count, radius


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(table of STATE with exact distances, final centroids)."""
    table = stored(whole_vectors(df, dims), "vectors")
    centroids = first_centroids(table, k)
    if not len(centroids):
        return assigned(table, np.zeros((1, dims), np.int64), last=True), centroids
    bounds = None
    for n in range(rounds + 1):
        fresh = stored(assigned(table, centroids, bounds, last=n == rounds), "vectors")
        forget(table)
        table = fresh
        if n < rounds:
            total, count, radius = sums(table, len(centroids), dims)
            new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
            bounds = moved(centroids, new, radius)
            centroids = new
    return table, centroids


def clustered(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned) of each kept vector."""
    table, centroids = clusters(df, k, rounds, dims)
    rows = table.select("vec_id", "cluster", "distance", "scanned")
    by = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()} if len(centroids) else {}
    facts = [(c, s, sum(by.values()), hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest()) for c, s in by.items()]
    return rows.join(F.broadcast(df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"
    )
