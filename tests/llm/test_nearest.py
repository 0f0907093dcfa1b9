import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.nearest import _nearest, hilbert_keys, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_keys(cells, 3))
    assert sorted(hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def brute(rows, every, k=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
    return out


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist(), 0) for i in range(1200)]
    rows += [(1200 + i, rows[0][1], 0) for i in range(30)]  # one common vector
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, 50)
    found = {q: {(r.vec_id) for r in got if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & {v for v, _ in near}) / 10 for q, near in want.items()]) >= 0.9
    for q in want:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)


def test_queries_in_parts_find_the_same(spark):
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 0) for i in range(600)], SCHEMA)
    whole, parts = (nearest_neighbours(vectors, F.col("vec_id") % 5 == 0, part_queries=n).collect() for n in (1 << 16, 7))
    assert sorted(whole) == sorted(parts) and len(whole) == 1200


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [1.0, None], 0), (5, [1.0], 0), (6, [float("inf"), 0.0], 0), (7, [1.0, 1.0], 0), (None, [1.0, 0.5], 0), (8, [1.0, 1.0], 0), (8, [1.0, 0.0], 0)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 8, 0.0), (2, 7, 1.0)]
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []


def test_ties_go_to_smaller_ids():
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(3000, 8)), rng.permutation(3000)
    x[(ids >= 500) & (ids < 1500)] = x[0]
    q = np.flatnonzero((ids >= 500) & (ids < 1500))[:300]
    got = list(_nearest(x[q], ids[q], x, ids, 10))
    query, found, score = (np.concatenate(c) for c in zip(*got, strict=True))
    for i in ids[q]:
        assert found[query == i].tolist() == [j for j in range(500, 512) if j != i][:10]
    assert (score == 0).all()


def test_near_copies_below_the_rounding_of_the_formula():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=64)
    x, ids = centre / np.linalg.norm(centre) * 1e4 + rng.normal(size=(2000, 64)) * 1e-5, np.arange(2000)
    query, found, _ = next(_nearest(x[:20], ids[:20], x, ids, 10))
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert found[query == i].tolist() == [j for j in np.lexsort((ids, d)) if j != i][:10]


def test_a_query_inside_a_group_of_copies(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=4) if i % 3 else np.ones(4)).tolist(), 0) for i in range(180)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 90, recall=1.0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(0, 30, 3))
