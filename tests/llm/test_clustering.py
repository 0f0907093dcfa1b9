import hashlib

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.clustering import cluster_vectors, moved, reassign, scan, tightened_drift

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, size, scale, clusters, rounds):
    """Every distance of every round, in Python's whole numbers."""
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] for _, v in rows]
    start = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i]))[:clusters]
    centroids = [list(x[i]) for i in start]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda k: (away(v, centroids[k]), k)) for v in x]
        if turn < rounds:
            for k in range(len(centroids)):
                if own := [v for v, c in zip(x, of, strict=True) if c == k]:
                    centroids[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    d = [away(v, centroids[k]) for v, k in zip(x, of, strict=True)]
    each = {k: sum(e for e, c in zip(d, of, strict=True) if c == k) for k in set(of)}
    return sorted((r[0], k, e, each[k], sum(d), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for r, k, e in zip(rows, of, d, strict=True))


def clustered(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size)) * 4
    return [(i, (centres[i % 6] + rng.normal(size=size)).tolist(), 0) for i in range(n)]


def got(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equals_brute_force_and_skips_scans(spark):
    rows = clustered(3, 600, 8) + [(1000 + i, [0.5] * 8, 0) for i in range(40)] + [(7, [1.25] * 8, 0)]
    found = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), size=8, scale=16.0, clusters=6, rounds=3)
    assert got(found) == brute([r[:2] for r in rows], 8, 16.0, 6, 3)
    assert found.where("scanned").count() < len(rows) / 2


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1), 0.0], 0) for i in range(30)]
    found = cluster_vectors(spark.createDataFrame(rows, SCHEMA), size=2, scale=1.0, clusters=4, rounds=2)
    assert got(found) == brute([r[:2] for r in rows], 2, 1.0, 4, 2)


def test_drift_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(11)
    tighter = 0
    for _ in range(400):
        size = int(rng.integers(2, 6))
        centre, old = rng.normal(size=size) * 3, rng.normal(size=size) * 3
        new, radius = old + rng.normal(size=size) * rng.uniform(0, 2), rng.uniform(0, 3)
        bound, way = tightened_drift(centre, radius, old, new), np.linalg.norm(new - old)
        points = rng.normal(size=(300, size))
        points = centre + points / np.linalg.norm(points, axis=1, keepdims=True) * radius * rng.uniform(0, 1, size=(300, 1)) ** 0.2
        nearer = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert nearer.max() <= bound + 1e-9 and bound <= way + 1e-12
        tighter += bound < 0.9 * way
    assert tighter > 100


def test_reassigned_vectors_are_those_of_a_full_scan():
    rng = np.random.default_rng(2)
    for large in (1, 1 << 20):
        x = rng.integers(-40, 40, size=(500, 5)) * large
        old = x[:7].copy()
        cluster, distance, lower = scan(x, old)
        new = old + rng.integers(-3, 4, size=old.shape) * large
        radii = [float(np.sqrt(distance[cluster == k].max(initial=0))) + 1e-6 for k in range(7)]
        now = moved(old, new, radii)
        again, upper, least, scanned = reassign(x, cluster, np.sqrt(distance.astype(float)) * (1 + 1e-9), lower, now)
        want, squared, _ = scan(x, new)
        assert (again == want).all() and not scanned.all()
        every = np.sqrt(((x[:, None, :] - new[None]) ** 2).sum(axis=2).astype(float))
        assert (upper >= np.sqrt(squared.astype(float))).all()
        every[np.arange(len(x)), want] = np.inf
        assert (least <= every.min(axis=1)).all()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [1.0, None], 0), (5, [1.0], 0), (6, [float("inf"), 0.0], 0), (None, [-0.51, 0.5], 0), (8, [1.0, 1.0], 0), (8, [1.0, 1.0], 0), (9, [], 0)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).withColumn("distance.a", F.lit(2))
    found = cluster_vectors(clash, size=2, scale=64.0).collect()
    assert sorted((str(r.vec_id), r.distance) for r in found) == [("0", 0), ("1", 0), ("8", 0), ("8", 0), ("None", 0)]
    assert {r.cluster for r in found if r.vec_id == 8} == {min(r.cluster for r in found if r.vec_id == 8)}
    assert cluster_vectors(clash.limit(0), size=2).collect() == []
