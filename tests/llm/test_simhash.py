import random

import numpy as np
import xxhash

from tests.llm.cases import empty_docs, odd_docs
from tickloom.llm.components import connected_components
from tickloom.llm.simhash import choose_groups, fingerprint, hamming_links, near_duplicates, spanning_links


def slow_fingerprint(text, k=3):
    words = []
    for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_equals_the_definition():
    rng = random.Random(5)
    texts = ["", "A", "a b", "A b C d", "É\xa0é x\x1cy z"] + [" ".join(rng.choice("the of And Ünd x y z".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert int.from_bytes(fingerprint(t), "big") == slow_fingerprint(t)
    assert fingerprint(None) == bytes(8)


def test_components_of_a_table(spark):
    docs = odd_docs(spark)
    got = near_duplicates(docs.withColumnRenamed("lang", "fp")).collect()
    rows = [r for r in docs.collect()]
    fps = {(r.doc_id, r.text): slow_fingerprint(r.text) for r in rows if r.doc_id is not None}
    known = sorted({f for f in fps.values()})
    at = {f: min(d for (d, _), g in fps.items() if g == f) for f in known}
    near = slow_components(at.values(), [(at[a], at[b]) for a in known for b in known if (a ^ b).bit_count() <= 2])
    want = sorted(near[at[fps[(r.doc_id, r.text)]]] for r in rows if r.doc_id is not None)
    assert sorted(r.component_id for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert near_duplicates(empty_docs(spark)).collect() == []


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(40)} | {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    want = slow_components(range(len(values)), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    fps = spark.createDataFrame([(v.to_bytes(8, "big"), i) for i, v in enumerate(values)], "fp binary, id long")
    for block in (2048, 8):  # 8: buckets are dealt in blocks
        links = hamming_links(fps, 64, bits_apart=2, block=block)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert {i: found.get(i, i) for i in range(len(values))} == want


def test_thresholds_sum_to_the_guarantee():
    sample = np.random.default_rng(1).integers(0, 2, (500, 64))
    for apart in (0, 2, 5):
        for rows in (1_000, 10**9):
            groups = choose_groups(sample, rows, apart)
            assert sum(g.threshold for g in groups) == apart - len(groups) + 1
            assert sorted(b for g in groups for b in g.bits) == list(range(64))


def test_spanning_links_are_few():
    x = np.zeros((500, 1), np.uint64)
    x[:, 0] = np.arange(500) % 7
    assert len(spanning_links(x, 3)) == 499
