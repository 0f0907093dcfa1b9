"""Near duplicates by the exact similarity of shingle sets: SimHash candidates, then the sets themselves.

Candidates meet under SimHash bit groups (``simhash.py``) and under MinHash bands: ``BANDS`` keys of
``BAND_ROWS`` least values each. The chance that two texts share a band depends on their similarity
alone, not on the number of rows, and unrelated texts share none, so buckets don't grow with the
corpus. Candidates whose fingerprints are too far apart are dropped, the others joined to coarse
components, and within each of these all texts are compared by their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.pieces import balanced
from tickloom.llm.shared import stash
from tickloom.llm.simhash import BLOCK, fingerprint_of, hamming_links, shingle_hashes

#: A pair of similarity s shares a band with a chance of 1 - (1 - s**6)**24: 0.9993 at 0.8.
BANDS, BAND_ROWS = 24, 6
#: Shingles hashed for all bands at a time.
STEP = 2048
#: Bytes of text of a block of a coarse component, about.
BLOCK_BYTES = 1 << 22

_rng = np.random.default_rng(11)
_TIMES = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingle hashes, as int64."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[k : k + STEP] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets as all pairs of at least that Jaccard similarity would; fewer links than sets. Empty sets are alike."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ids, at = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    owner, held = np.repeat(np.arange(len(sets)), sizes), np.zeros(len(ids), bool)
    left, links = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo and left.any():
            i = todo.pop()
            held[at[edges[i] : edges[i + 1]]] = True
            both = np.bincount(owner[held[at]], minlength=len(sets))
            held[at[edges[i] : edges[i + 1]]] = False
            near = np.flatnonzero(left & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
            left[near] = False
            links += [(i, int(j)) for j in near]
            todo.extend(near.tolist())
    return links


def near_texts(docs: DataFrame, *, words: int, bits: int, bits_apart: int, link_bits: int, similarity: float, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, batch_bytes: int = 1 << 22) -> DataFrame:
    """``id_column`` and ``component_id``, the smallest id reachable over pairs of texts whose sets of shingles of ``words`` words have a Jaccard similarity of at least ``similarity``.

    Equal texts are one node, so copies cost one comparison. Null texts and texts without words are
    alike. Rows without an id are left out; rows that share an id share its links. A coarse
    component of more than ``block`` texts (or of long ones) is dealt in blocks, and each two blocks
    are compared by a task of their own. ``bits_apart``, ``link_bits``: see ``hamming_links``.
    """
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("_t", F.md5(F.col("text").cast("binary")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", batch_bytes):
            fps, bands = [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words)  # of distinct shingles both, as the similarity is
                fps.append(fingerprint_of([found] if len(found) else [], bits))
                bands.append(band_keys(found))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_t"), pa.array(fps, pa.binary()), keys], ["id", "_t", "fp", "keys"])

    found = stash(rows.mapInArrow(hashed, "id long, _t string, fp binary, keys array<long>"), "fingerprints")
    nodes = stash(found.groupBy("_t").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    coarse = connected_components(hamming_links(nodes.select("fp", "id"), bits, bits_apart=bits_apart, link_bits=link_bits, more_keys=nodes.select(F.explode("keys").alias("key"), "id", "fp")))

    wanted = nodes.select("_t", "id").join(coarse.select(F.col("node").alias("id"), "component"), "id")
    members = stash(rows.join(wanted, ["id", "_t"]).dropDuplicates(["id", "_t"]), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length("text")).alias("_bytes"))
    n = F.greatest(F.ceil(F.col("_rows") / block), F.ceil(F.col("_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    dealt = members.join(sizes.select("component", n.alias("_n")), "component").withColumn("_own", F.pmod(F.xxhash64("_t"), F.col("_n")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = paired.select("component", F.least("_own", "_other").alias("r"), F.greatest("_own", "_other").alias("s"), "id", "text")

    def compared(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_pylist()
        links = similar_links([shingle_set(t.as_py(), words) for t in group.column("text")], similarity)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    merged = connected_components(pairs.groupBy("component", "r", "s").applyInArrow(compared, "a long, b long"))
    classes = nodes.select("_t", "id").join(merged.withColumnRenamed("node", "id"), "id", "left").select("_t", F.coalesce("component", "id").alias("component_id"))
    return found.select(F.col("id").alias(id_column), "_t").join(classes, "_t").drop("_t")
