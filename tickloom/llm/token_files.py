"""Operator 7, token-ID / binary output: id blocks transposed into byte planes, each compressed alone.

A dataset is a folder of Parquet files that Spark commits, so a lost executor leaves no part of a
file behind. One row is one chunk: whole documents, in order, of about ``chunk_ids`` ids. Its ids
are cut in blocks of ``block_ids``; each block is transposed into four byte planes, and each plane
is one zstandard frame (an empty frame stands for a plane of zeros). The other columns are the
chunk index: shard, chunk number, ids before the chunk in its shard, ids and documents, and each
document's id and length. A reader finds a document's chunk by the index and opens that row only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.pieces import WORDS, balanced, worker_pieces
from tickloom.llm.shared import partitions

PLANES = 4
CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start_in_shard", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("planes", pa.list_(pa.binary()))])
CHUNK_SQL = "shard int, chunk int, start_in_shard long, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_ids int, planes array<binary>"


def to_planes(ids: np.ndarray, block_ids: int, level: int = 3) -> list[bytes]:
    """Unsigned 32-bit ids to compressed byte planes, four for each block."""
    pack, out = zstandard.ZstdCompressor(level=level), []
    for start in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[start : start + block_ids], dtype="<u4")
        planes = np.ascontiguousarray(block.view(np.uint8).reshape(-1, PLANES).T)
        out += [pack.compress(p.tobytes()) if p.any() else b"" for p in planes]
    return out


def from_planes(planes: list[bytes], n_ids: int, block_ids: int) -> np.ndarray:
    """What ``to_planes`` was given."""
    unpack, ids = zstandard.ZstdDecompressor(), np.zeros(n_ids, "<u4")
    view = ids.view(np.uint8).reshape(-1, PLANES)
    for k, plane in enumerate(planes):
        if plane:
            start = k // PLANES * block_ids
            raw = np.frombuffer(unpack.decompress(plane), np.uint8)
            view[start : start + len(raw), k % PLANES] = raw
    return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, order_by: tuple[str, ...] = ("doc_id",), end_id: int = 1, block_ids: int = 1 << 16, chunk_ids: int = 1 << 19, batch_bytes: int = 1 << 22) -> None:
    """Encode every text with the word-level ``tokenizers`` file, end each document with ``end_id`` and write the dataset to ``path``.

    Documents are range-partitioned by ``order_by`` (then by a hash of the text), so shards follow
    one another in that order; a shard is one partition. A null text is empty: the end id alone. A
    null ``doc_id`` is kept as null and sorts first. Repeated rows are written each. An empty table
    writes an empty dataset. Other columns are ignored. A document is never cut between chunks.
    """
    content, spark = Path(tokenizer).read_text(encoding="utf-8"), docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(content, WORDS)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        held, docs_in, lengths, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            planes = pa.array([to_planes(np.concatenate(held), block_ids)], CHUNK.field("planes").type)
            one = lambda name, values: pa.ListArray.from_arrays([0, len(values)], values).cast(CHUNK.field(name).type)
            numbers = [pa.array([v], CHUNK.field(c).type) for c, v in (("shard", shard), ("chunk", number), ("start_in_shard", before), ("n_ids", n))]
            return pa.RecordBatch.from_arrays([*numbers, one("doc_ids", pa.concat_arrays(docs_in)), one("doc_lengths", pa.array(np.concatenate(lengths))), pa.array([block_ids], pa.int32()), planes], schema=CHUNK)

        for batch in balanced(batches, "text", batch_bytes):
            ids, sizes = pieces.ids(batch.column("text"))
            upto = np.cumsum(sizes)
            ids = np.insert(ids, upto, np.uint32(end_id))
            ends, first, start = upto + np.arange(1, len(sizes) + 1), 0, 0
            while first < len(sizes):
                # Up to the document that fills the chunk, else all.
                last = min(int(np.searchsorted(ends, start + chunk_ids - n)) + 1, len(sizes))
                end = int(ends[last - 1])
                held.append(ids[start:end])
                docs_in.append(batch.column("doc_id").slice(first, last - first))
                lengths.append(sizes[first:last] + 1)
                n, first, start = n + end - start, last, end
                if n >= chunk_ids:
                    yield row()
                    number, before = number + 1, before + n
                    held, docs_in, lengths, n = [], [], [], 0
        if docs_in:
            yield row()

    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [f"_order{k}" for k in range(len(order_by))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(F.col(c).alias(k) for c, k in zip(order_by, keys, strict=True)), F.xxhash64(text).alias("_tie"))
    ordered = rows.repartitionByRange(partitions(spark), *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ordered.select("doc_id", "text").mapInArrow(chunks, CHUNK_SQL).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the dataset: ``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (binary, little-endian unsigned 32-bit)."""
    return _documents(spark, path, lambda ids: ids.tobytes(), "ids", pa.binary())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files."""
    return _documents(spark, path, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32", pa.int64())


def _documents(spark: SparkSession, path: str, value, name: str, kind: pa.DataType) -> DataFrame:
    stored = spark.read.schema(CHUNK_SQL).parquet(path)
    # One row for each shard, which are as many as the writer had partitions.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = F.coalesce(F.sum("_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored.join(F.broadcast(shards.select("shard", before.alias("_base"))), "shard").select((F.col("_base") + F.col("start_in_shard")).alias("start"), "n_ids", "doc_ids", "doc_lengths", "block_ids", "planes")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"], row["block_ids"])
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                values = [value(ids[e - n : e]) for e, n in zip(ends.tolist(), row["doc_lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["start"]), pa.array(lengths), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name])

    return placed.mapInArrow(documents, f"doc_id long, start long, n_tokens long, {name} {'binary' if kind == pa.binary() else 'long'}")
