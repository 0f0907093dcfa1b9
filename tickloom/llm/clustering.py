"""Operator 13, centroid clustering: exact k-means of whole-number vectors that skips most distances.

Each vector carries an upper bound on the distance to its own centroid and a lower bound on that to
every other one. When centroids move, the upper bound grows by its centroid's way. The lower bound
shrinks by less than the way of the centroid that moved most: a cluster lies in a sphere about its
old centroid, and in the plane of that centre and of another centroid's old and new place one sees
how much nearer to the new place than to the old one any point of the sphere can be. Vectors whose
bounds don't tell the centroids apart are compared with all of them, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import discard, stash

#: Largest whole number of a component: squared distances of up to 128 components stay within a long.
LARGEST = 1 << 27
#: Share by which bounds are widened for the rounding of doubles.
ROUNDING = 1e-9
#: Whole numbers up to here, times themselves and added up over 128 components, are exact in doubles.
_IN_DOUBLES = 1 << 22
_STATE = "cluster int, distance long, upper double, lower double, scanned boolean"


def tightened_drift(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much nearer to ``new`` than to ``old`` a point of the sphere can be, at most; no more than the way between the two.

    From the middle of the way, a point in a direction at an angle ``t`` to it is nearer by at most
    the way times cos t, as its distances to both ends add up to twice that to the middle or more.
    The sphere's directions lie within arcsin(radius / distance) of its centre's.
    """
    step = new - old
    way = float(np.linalg.norm(step))
    if way == 0.0:
        return 0.0
    off = centre - (old + new) / 2.0
    far2 = float(off @ off)
    if far2 <= radius * radius:
        return way
    along = float(off @ step) / way
    across = float(np.sqrt(max(far2 - along * along, 0.0)))
    reach = float(np.sqrt(far2 - radius * radius))
    if along > 0 and across * reach <= along * radius:  # the way's own line meets the sphere ahead
        return way
    return way * min(1.0, max(0.0, (along * reach + across * radius) / far2))


@dataclass(frozen=True)
class Moved:
    """Centroids of a round; by how much bounds made for the round before it loosen, by cluster."""

    centroids: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def moved(old: np.ndarray, new: np.ndarray, radii: list[float]) -> Moved:
    a, b = old.astype(float), new.astype(float)
    lower = [max((tightened_drift(a[i], radii[i], a[j], b[j]) for j in range(len(a)) if j != i), default=0.0) for i in range(len(a))]
    return Moved(new, np.linalg.norm(b - a, axis=1) * (1 + ROUNDING), np.array(lower) * (1 + ROUNDING))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _IN_DOUBLES:
        a, b = x.astype(float), centroids.astype(float)
        return ((a**2).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b**2).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equally near ones), squared distance, distance to the next nearest."""
    every = _squared(x, centroids)
    best = every.argmin(axis=1)
    at = np.arange(len(x))
    distance = every[at, best]
    if len(centroids) == 1:
        return best, distance, np.full(len(x), np.inf)
    every[at, best] = np.iinfo(np.int64).max
    return best, distance, np.sqrt(every.min(axis=1).astype(float)) * (1 - ROUNDING)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``cluster``, both bounds, and which vectors had to be scanned. Where the loosened bounds still tell the centroids apart no distance is computed, else one, and all where that doesn't do either."""
    cluster, upper, lower = cluster.copy(), upper + now.upper[cluster], np.maximum(lower - now.lower[cluster], 0.0)
    near = np.flatnonzero(upper >= lower)
    upper[near] = _bound_above(_own(x[near], now.centroids[cluster[near]]))
    unsure = near[upper[near] >= lower[near]]
    cluster[unsure], distance, lower[unsure] = scan(x[unsure], now.centroids)
    upper[unsure] = _bound_above(distance)
    scanned = np.zeros(len(x), bool)
    scanned[unsure] = True
    return cluster, upper, lower, scanned


def _own(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((x - centroids) ** 2).sum(axis=1)


def _bound_above(distance: np.ndarray) -> np.ndarray:
    return np.sqrt(distance.astype(float)) * (1 + ROUNDING)


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, *, size: int, scale: float) -> DataFrame:
    """``id_column`` and ``v``: floor(``scale`` * component), of vectors with ``size`` components, none null or non-finite."""
    given = F.col(vector_column)
    sound = (F.size(given) == size) & F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    inside = lambda x: F.when(F.abs(x) <= LARGEST, x).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST} in whole numbers")))
    return vectors.where(sound).select(F.col(id_column), F.transform(given, lambda x: inside(F.floor(F.lit(scale) * x.cast("double"))).cast("int")).alias("v"))


def _first_centroids(rows: DataFrame, id_column: str, clusters: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"), 256)
    picked = rows.select(order.alias("_h"), "v").orderBy(F.col("_h").asc_nulls_last(), "v").limit(clusters).collect()  # one row for each centroid
    return np.array([r.v for r in picked], np.int64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _assigned(rows: DataFrame, id_column: str, size: int, now: Moved, *, first: bool, last: bool) -> DataFrame:
    kind = rows.schema[id_column].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            if first:
                cluster, distance, lower = scan(x, now.centroids)
                upper, scanned = _bound_above(distance), np.ones(len(x), bool)
            else:
                cluster, upper, lower, scanned = reassign(x, _column(batch, "cluster").astype(np.int64), _column(batch, "upper"), _column(batch, "lower"), now)
            distance = pa.array(_own(x, now.centroids[cluster])) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), v, pa.array(cluster.astype(np.int32)), distance, pa.array(upper), pa.array(lower), pa.array(scanned)], [id_column, "v", "cluster", "distance", "upper", "lower", "scanned"])

    return rows.mapInArrow(assign, f"`{id_column}` {kind}, v array<int>, {_STATE}")


def _sums(rows: DataFrame, size: int) -> list:
    """A row for each cluster: number of vectors, radius, sum of each component."""
    total = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(size)]
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("upper").alias("radius"), *total).collect()


def cluster_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64, scale: float = 64.0, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``id_column``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and ``scanned`` (compared with all centroids in the last assignment) of every kept vector.

    Kept are vectors with ``size`` components, none null or non-finite, as floor(``scale`` * x).
    Centroids start as the ``clusters`` kept vectors whose ids have the smallest SHA-256 with
    ``seed`` before them; fewer vectors are as many centroids. Each of ``rounds`` assigns every
    vector to the nearest centroid (ties: the smaller number) and moves each centroid that has
    vectors to the floor of their mean; then vectors are assigned once more.

    The driver holds the centroids and a row of sums for each; nothing that grows with the table.
    Each assignment reads and writes the vectors once, in the shared folder; none is shuffled.

    Repeated rows and ids are vectors of their own. A null id stays null and starts no centroid
    unless there are too few others. Other columns are ignored, whatever their names. An empty table
    gives no rows. A component beyond ``LARGEST`` in whole numbers is an error.
    """
    rows = stash(whole_vectors(vectors, id_column, vector_column, size=size, scale=scale), "whole-vectors")
    start = _first_centroids(rows, id_column, clusters, seed)
    if not len(start):
        start = np.zeros((1, size), np.int64)
    now = Moved(start, np.zeros(len(start)), np.zeros(len(start)))
    for turn in range(rounds + 1):
        before, rows = rows, stash(_assigned(rows, id_column, size, now, first=turn == 0, last=turn == rounds), f"assigned-{turn}")
        discard(before)
        if turn < rounds:
            new, radii = now.centroids.copy(), [0.0] * len(start)
            for r in _sums(rows, size):
                new[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
                radii[r.cluster] = r.radius
            now = moved(now.centroids, new, radii)
    spark = rows.sparkSession
    digests = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(now.centroids.tolist())]
    of_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = of_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")  # one row for each centroid, here and below
    told = told.join(F.broadcast(of_cluster.agg(F.sum("cluster_inertia").alias("inertia"))), F.lit(True))
    return rows.join(F.broadcast(told), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
