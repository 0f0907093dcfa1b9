"""Operator 5, approximate nearest neighbours: windows of several shifted Hilbert orderings.

Each curve orders all vectors by the Hilbert key of another random projection to a few dimensions,
shifted by another offset. The orderings are range-partitioned by Spark; a partition of a curve is a
block. A query looks through the blocks that are at most ``reach`` blocks from its own on each
curve; the windows of all curves are merged and ranked by the exact distance.

``reach`` is measured, not guessed: a bounded number of queries is compared with every vector, and
the reach is the least that finds the wanted share of their true neighbours. Where vectors have
near neighbours along some projection, that is a block or two; where they are spread evenly in all
directions, no ordering helps and windows become a large share of the curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stash

CURVES, DIMENSIONS, BITS = 8, 4, 12
#: Vectors of a block, about; a session's shuffle partitions are the least number of blocks of all curves.
BLOCK_ROWS = 4096
#: Queries that the reach is measured on, and the share of their neighbours it must find.
MEASURED, RECALL = 128, 0.95
#: Query rows compared with a block at a time.
STEP = 256
#: Queries of a window that one task holds, about; more are dealt in parts, each of which meets the block in a task of its own.
PART_QUERIES = 1 << 16
#: Pairs whose distance is computed exactly at a time.
PAIRS = 1 << 16


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2**bits`` (Skilling's transposed form)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_bit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projections(size: int, curves: int, dimensions: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dimensions] for _ in range(curves)]
    return turns, rng.uniform(size=(curves, dimensions))


def _nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For steps of queries: query ids, ids and distances of their ``k`` nearest rows, themselves left out."""
    squares, size = (x**2).sum(axis=1), x.shape[1]
    for s in range(0, len(q), STEP):
        some, own = q[s : s + STEP], q_id[s : s + STEP]
        # By the fast formula with its rounding: rows whose lower bound is over the k-th upper bound aren't among the nearest. All others, however many, exactly.
        rounding = 4 * (size + 8) * np.finfo(float).eps * (np.sqrt(squares) + np.sqrt((some**2).sum(axis=1).max())) ** 2
        upper = (squares + rounding)[None] - 2 * some @ x.T
        upper[own[:, None] == x_id[None]] = np.inf
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(some), np.inf)
        of, near = np.nonzero((upper - 2 * rounding <= kth[:, None]) & (own[:, None] != x_id[None]))
        exact = np.concatenate([np.zeros(0)] + [np.sqrt(((x[near[p : p + PAIRS]] - some[of[p : p + PAIRS]]) ** 2).sum(axis=1)) for p in range(0, len(near), PAIRS)])
        order = np.lexsort((x_id[near], exact, of))
        of, near, exact = of[order], near[order], exact[order]
        keep = (np.arange(len(of)) - np.searchsorted(of, of) < k) & np.isfinite(exact)
        yield own[of[keep]], x_id[near[keep]], exact[keep]


def _arrays(batch, column: str) -> np.ndarray:
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _found(parts: list) -> list[pa.Array]:
    columns = list(zip(*parts, strict=True)) if parts else [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    return [pa.array(np.concatenate(c)) for c in columns]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``vec`` of vectors that aren't null or zero and hold no null or non-finite component. Floats stay floats: they are half the size, and doubles when compared."""
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    vec = F.col(vector_column).cast(kind)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, is_query, *, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", curves: int = CURVES, dimensions: int = DIMENSIONS, recall: float = RECALL, block_rows: int = BLOCK_ROWS, part_queries: int = PART_QUERIES, seed: int = 7) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance in double precision) of each query's ``k`` nearest found.

    ``is_query``: condition on ``vec_id`` for the rows that are queries. Candidates are all rows but
    the query's own id; ties go to the smaller id; a query with fewer candidates gets all of them.
    Vectors that are null, zero, of another length than most, or hold a null or non-finite component
    take no part, nor do rows without an id. Of rows that share an id, the nearest one counts. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = sizes[0]
    kind = rows.schema["vec"].dataType.simpleString()
    rows = rows.where(F.size("vec") == size)
    turns, shifts = _projections(size, curves, min(dimensions, size), seed)
    # Scale of the grid: the spread of all vectors' components.
    scale = float(rows.select(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))).alias("x")).agg(F.max("x")).first()[0]) * np.sqrt(size) / 2

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _arrays(batch, "vec"), pa.array(np.arange(batch.num_rows))
            for c, (turn, shift) in enumerate(zip(turns, shifts, strict=True)):
                place = (x @ turn / scale + 1) / 2 + shift / 2  # within 0 to 1.5 for all but outliers
                cells = np.clip(place / 1.5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cells, BITS)), batch.column("vec_id").take(at), batch.column("vec").take(at)], ["curve", "key", "vec_id", "vec"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(np.full(batch.num_rows, block, np.int32)), batch.column("vec_id"), batch.column("vec")], ["curve", "block", "vec_id", "vec"])

    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), curves * -(-n // block_rows), curves * 8)
    keyed = rows.mapInArrow(keys, f"curve int, key long, vec_id long, vec {kind}")
    # Equal keys are told apart by a hash, so that a common vector fills as many blocks as it needs.
    curve_blocks = keyed.repartitionByRange(blocks, "curve", "key", F.xxhash64("vec_id")).mapInArrow(numbered, f"curve int, block int, vec_id long, vec {kind}")
    index = stash(curve_blocks, "curves")

    queries = index.where(is_query)
    reach = _measured_reach(index, queries, k, recall)

    def compared(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            parts = list(_nearest(_arrays(left, "vec"), left.column("vec_id").to_numpy(), _arrays(right, "vec"), right.column("vec_id").to_numpy(), k))
        return pa.Table.from_arrays(_found(parts), ["query_id", "vec_id", "score"])

    routed = queries.withColumn("block", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)))
    most = routed.groupBy("curve", "block").count().agg(F.max("count")).first()[0] or 0
    parts_of = max(1, -(-most // part_queries))
    dealt = routed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts_of)).cast("int"))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1))))
    windows = dealt.groupBy("curve", "block", "part").cogroup(spread.groupBy("curve", "block", "part")).applyInArrow(compared, "query_id long, vec_id long, score double")
    return _top(windows, k).select("query_id", "rank", "vec_id", "score")


def _measured_reach(index: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """The least distance in blocks within which ``recall`` of a bounded number of queries' true neighbours are, on the curve where they are nearest."""
    # At most MEASURED vectors come to the driver.
    some = queries.where("curve = 0").dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).select("vec_id", "vec").collect()
    if not some:
        return 0
    ids, vecs = np.array([r.vec_id for r in some]), np.array([r.vec for r in some])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_found(list(_nearest(vecs, ids, _arrays(batch, "vec"), batch.column("vec_id").to_numpy(), k))), ["query_id", "vec_id", "score"])

    truth = _top(index.where("curve = 0").select("vec_id", "vec").mapInArrow(exact, "query_id long, vec_id long, score double"), k).select("query_id", "vec_id")
    places = index.groupBy("vec_id", "curve").agg(F.min("block").alias("block"))
    of_query = places.select(F.col("vec_id").alias("query_id"), "curve", F.col("block").alias("own"))
    apart = truth.join(places, "vec_id").join(of_query, ["query_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("own") - F.col("block"))).alias("apart"))
    steps = apart.groupBy("apart").count().orderBy("apart").collect()  # as many rows as blocks on a curve, at most
    total, seen = sum(r["count"] for r in steps), 0
    for r in steps:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["apart"])
    return 0
