"""Operator 3, SimHash near-dedup: a Hamming self-join by the generalised pigeonhole principle.

If ``m`` groups of bits have thresholds that sum to ``bits_apart - m + 1``, two fingerprints at most
``bits_apart`` bits apart differ within the threshold in at least one group; a threshold of -1
leaves a group out. Correlated bits share a group, so that the groups together tell more
fingerprints apart, and the thresholds, which need not be equal, come from dynamic programming on
estimated candidate counts. A fingerprint is probed in a group under its bits there with each
choice of ``threshold`` bits masked; whatever meets under one key is verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.pieces import balanced
from tickloom.llm.shared import partitions, stash

SEED = 42
#: Fingerprints that the bit groups and thresholds are fitted on.
SAMPLE = 4096
#: Costs of a key (written, shuffled, sorted) and of one comparison, in the same unit.
KEY_COST, COMPARE_COST = 1000.0, 5.0
#: Fingerprints that one task compares under one key; larger buckets are cut in blocks and all pairs of blocks compared.
BLOCK = 2048
#: Shingles hashed at a time, and hashes whose bits are counted at a time (a byte each).
SLICE, UNPACKED = 1 << 16, 1 << 12


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``words`` words, repeats included, in slices; the whole sequence where there are fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SLICE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SLICE].tolist(), ends[k : k + SLICE].tolist(), strict=True)], np.uint64)


def _spread(h: np.ndarray, lanes: int) -> np.ndarray:
    """64 bits to ``lanes`` times 64: the hash itself, then its splitmix64 successors."""
    out = [h]
    for k in range(1, lanes):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """Most significant bit first: 1 where over half the shingles' hashes have a 1. No words: zeros."""
    return fingerprint_of(shingle_hashes(text, words), bits)


def fingerprint_of(hashes: Iterable[np.ndarray], bits: int) -> bytes:
    """The fingerprint of slices of shingle hashes."""
    ones, n = np.zeros(bits, np.int64), 0
    for h in (part for some in hashes for part in np.split(some, range(UNPACKED, len(some), UNPACKED))):
        wide = np.ascontiguousarray(_spread(h, bits // 64).astype(">u8")).view(np.uint8).reshape(len(h), -1)
        ones += np.unpackbits(wide, axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, *, words: int = 3, bits: int = 64, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """``id_column`` and the binary ``fp`` of each row; a null text has no words."""
    kind = docs.schema[id_column].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", batch_bytes):
            out = [fingerprint(t, words, bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_column, "fp"])

    return docs.select(F.col(id_column), F.col(text_column).alias("text")).mapInArrow(hashed, f"`{id_column}` {kind}, fp binary")


@dataclass(frozen=True)
class Group:
    """Bits of a group, and how many of them may differ (-1: the group is not probed)."""

    bits: tuple[int, ...]
    threshold: int


def _grouped(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` groups of nearly equal size; each takes the free bit most correlated with what it has."""
    n = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    near = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(near, 0)
    free, groups = np.ones(n, bool), []
    for k in range(m):
        left = np.flatnonzero(free)
        group = [int(left[near[np.ix_(left, left)].max(axis=1).argmax()])]
        free[group[0]] = False
        with_group = near[group[0]].copy()
        while len(group) < n // m + (k < n % m):
            group.append(int(np.where(free, with_group, -1.0).argmax()))
            free[group[-1]] = False
            with_group += near[group[-1]]
        groups.append(sorted(group))
    return groups


def _distances(sample: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Probability that two fingerprints differ in 0, 1, ... ``most`` bits of the group: as seen on pairs of the sample, and at least as for independent bits."""
    one = sample[:, group].mean(axis=0)
    alone = np.zeros(most + 1)
    alone[0] = 1
    for p in one:
        differ = 2 * p * (1 - p)
        alone = alone * (1 - differ) + np.concatenate([[0], alone[:-1]]) * differ
    half = len(sample) // 2
    if not half:
        return alone
    seen, part = np.zeros(most + 1), sample[:, group]
    for shift in range(1, min(half, 64) + 1):
        d = (part != np.roll(part, shift, axis=0)).sum(axis=1)
        seen += np.bincount(np.minimum(d, most + 1), minlength=most + 2)[: most + 1]
    return np.maximum(alone, seen / (len(sample) * min(half, 64)))


def choose_groups(sample: np.ndarray, rows: int, bits_apart: int) -> list[Group]:
    """The cheapest groups and thresholds for ``rows`` fingerprints. ``sample``: rows of 0 and 1."""
    n = sample.shape[1]
    best: tuple[float, list[Group]] | None = None
    for m in range(1, min(bits_apart + 1, n) + 1):
        if n > 64 * m:
            continue
        groups = _grouped(sample, m)
        target = bits_apart - m + 1
        most = min(target + m - 1, 2)  # thresholds from -1 to 2
        cost: list[dict[int, float]] = []
        for g in groups:
            near, w = _distances(sample, g, max(most, 0)), len(g)
            cost.append({-1: 0.0} | {t: comb(w, t) * KEY_COST + COMPARE_COST * rows * sum(near[d] * comb(w - d, t - d) for d in range(t + 1)) for t in range(most + 1)})
        # table[s]: the least cost of the groups so far with thresholds that sum to s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (paid, chosen) in table.items():
                for t, x in c.items():
                    if s + t not in grown or paid + x < grown[s + t][0]:
                        grown[s + t] = (paid + x, [*chosen, t])
            table = grown
        if target in table and (best is None or table[target][0] < best[0]):
            best = table[target][0], [Group(tuple(g), t) for g, t in zip(groups, table[target][1], strict=True)]
    if best is None:
        raise ValueError(f"no groups of {n} bits guarantee {bits_apart} bits")
    return best[1]


def _unpacked(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def _keys(bits: np.ndarray, groups: list[Group]) -> np.ndarray:
    """Probe keys of each row, as int64 hashes of the group, the mask and the bits left."""
    out = []
    for number, g in enumerate(groups):
        if g.threshold < 0:
            continue
        weights = np.uint64(1) << np.arange(len(g.bits), dtype=np.uint64)
        value = (bits[:, g.bits].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        for k, gone in enumerate(combinations(range(len(g.bits)), g.threshold)):
            left = np.uint64(((1 << len(g.bits)) - 1) & ~sum(1 << x for x in gone))
            salt = np.uint64((number * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
            z = (value & left) + salt
            z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            out.append((z ^ (z >> np.uint64(33))).view(np.int64))
    return np.stack(out, axis=1)


def spanning_links(x: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join the rows of ``x`` (words of 64 bits) as all pairs at most ``most`` bits apart would; fewer links than rows."""
    left, links = np.arange(len(x)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(x[left] ^ x[at]).sum(axis=1) <= most
            links += [(at, y) for y in left[near]]
            todo.extend(left[near])
            left = left[~near]
    return links


def _linked(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Row numbers of the links within each run of rows from starts to ends."""
    a, b = [], []
    pairs = ends - starts == 2
    first = starts[pairs]
    hit = first[np.bitwise_count(words[first] ^ words[first + 1]).sum(axis=1) <= most]
    a += hit.tolist()
    b += (hit + 1).tolist()
    for s, e in zip(starts[~pairs].tolist(), ends[~pairs].tolist(), strict=True):
        x = words[s:e]
        if e - s <= 64:
            near = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= most
            if near.sum() == e - s:
                continue
        for i, j in spanning_links(x, most):
            a.append(s + int(i))
            b.append(s + int(j))
    return a, b


def hamming_links(fps: DataFrame, bits: int, *, bits_apart: int, link_bits: int | None = None, block: int = BLOCK, more_keys: DataFrame | None = None) -> DataFrame:
    """``a`` and ``b``: ids of linked fingerprints, enough links to connect whatever is connected.

    ``fps``: distinct ``fp`` (binary) and an ``id`` (long). Every pair at most ``bits_apart`` bits
    apart is probed; probed pairs at most ``link_bits`` apart (``bits_apart`` if not given) link. A
    bucket of more than ``block`` fingerprints is dealt in blocks, and each two of its blocks are
    compared by a task of their own, so that no task holds more than about two blocks. ``more_keys``
    (``key``, ``id``, ``fp``): further keys under which fingerprints meet.
    """
    spark, most = fps.sparkSession, bits_apart if link_bits is None else link_bits
    rows = fps.count()
    sample = [bytes(r.fp) for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    groups = choose_groups(_unpacked(sample) if sample else np.zeros((1, bits), np.uint8), rows, bits_apart)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_unpacked(batch.column("fp").to_pylist()), groups)
                at = np.repeat(np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(pa.array(at)) for c in (batch.column("id"), batch.column("fp")))], ["key", "id", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "r", "s", "id"]
        held: dict[str, np.ndarray] = {}

        def links(cut: int) -> pa.RecordBatch:
            same = np.ones(cut - 1, bool)
            for c in names[:3]:
                same &= held[c][1:cut] == held[c][: cut - 1]
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [cut]])
            starts, ends = edges[:-1], edges[1:]
            many = ends - starts > 1
            a, b = _linked(held["words"][:cut], starts[many], ends[many], most)
            return pa.RecordBatch.from_arrays([pa.array(held["id"][a] if a else [], pa.int64()), pa.array(held["id"][b] if b else [], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in names} | {"words": np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(batch.num_rows, -1)}
            held = {c: np.concatenate([held[c], v]) for c, v in new.items()} if held else new
            last = len(held["key"]) - 1
            same = np.ones(last + 1, bool)
            for c in names[:3]:
                same &= held[c] == held[c][last]
            cut = last + 1 - (len(same) - np.flatnonzero(~same)[-1] - 1 if not same.all() else last + 1)
            if cut:
                yield links(cut)
                held = {c: v[cut:] for c, v in held.items()}
        if held:
            yield links(len(held["key"]))

    keyed = fps.select("id", "fp").mapInArrow(probes, "key long, id long, fp binary")
    keyed = keyed if more_keys is None else keyed.unionByName(more_keys)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = F.expr(f"cast((n + {block - 1}) div {block} as int)")
    dealt = keyed.join(shared, "key").select("key", "id", "fp", n.alias("n")).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("n")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = paired.select("key", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), "id", "fp")
    by = ["key", "r", "s"]
    return pairs.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, bits: int = 64, bits_apart: int = 2, link_bits: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``fp`` (binary) and ``component_id``: the smallest id reachable over links, the row's own included.

    ``bits_apart``: fingerprints so far apart or nearer are all found; ``link_bits``: see
    ``hamming_links``. Equal fingerprints are one node, so thousands of copies cost one probe.

    A null or empty text has no words and the fingerprint zero, which links like any other. A row
    without an id is in no component (``component_id`` null). Repeated rows share a component. An
    empty table gives no rows. Other columns are dropped, whatever their names.
    """
    found = stash(fingerprints(docs, words=words, bits=bits, id_column=id_column, text_column=text_column), "fingerprints")
    with_id = found.where(F.col(id_column).isNotNull())
    nodes = stash(with_id.groupBy("fp").agg(F.min(F.col(id_column).cast("long")).alias("id")), "nodes")
    merged = connected_components(hamming_links(nodes, bits, bits_apart=bits_apart, link_bits=link_bits))
    classes = nodes.join(merged.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    placed = found.join(classes, "fp", "left")
    return placed.select(id_column, "fp", F.when(F.col(id_column).isNotNull(), F.col("component_id")).alias("component_id"))
