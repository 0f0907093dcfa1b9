import random

import numpy as np

import corpus_pipeline
from tests.llm.cases import empty_docs
from tickloom.llm.near_texts import band_keys, near_texts, shingle_set, similar_links

SF = "/root/testdata/sf0.001"


def changed(rng, text, similarity):
    """A copy with new words until the similarity is just above (or, if negative, just below) the given one."""
    words, base = text.split(), shingle_set(text, 5)
    order = rng.sample(range(len(words)), len(words))
    for at in order:
        then = [*words[:at], f"new{rng.randrange(10**9)}", *words[at + 1 :]]
        s = jaccard(base, shingle_set(" ".join(then), 5))
        if s < abs(similarity):
            return " ".join(words if similarity > 0 else then)
        words = then


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / max(len(a) + len(b) - both, 1)


def test_pairs_of_a_similarity_over_the_limit_go_and_no_others(spark):
    rng = random.Random(6)
    rows, near, far = [], [], []
    for k in range(300):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 400)))
        other = changed(rng, text, 0.8 if k % 2 else -0.8)
        (near if k % 2 else far).append(2 * k + 1)
        rows += [(2 * k, text, "en", "s", 0), (2 * k + 1, other, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()}
    assert kept >= set(far) | {r[0] for r in rows if r[0] % 2 == 0}
    assert len(kept & set(near)) <= 1


def test_blocks_link_as_one(spark):
    text = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*text[:100], f"x{i}", *text[100:]])) for i in range(60)] + [(60, None), (61, ""), (60, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 7):
        got = near_texts(docs, words=5, bits=256, bits_apart=20, link_bits=64, similarity=0.8, block=block).collect()
        assert {r.component_id for r in got if r.doc_id < 60} == {0} and {r.component_id for r in got if r.doc_id >= 60} == {60}
    assert near_texts(empty_docs(spark), words=5, bits=256, bits_apart=20, link_bits=64, similarity=0.8).collect() == []


def test_links_and_bands():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    assert sorted(similar_links(sets, 0.8)) == [(0, 1), (1, 2), (3, 4)]
    assert sorted(similar_links(sets[:3], 0.9)) == []
    rng = np.random.default_rng(2)
    hits = 0
    for _ in range(500):  # similarity 0.8
        h = rng.integers(0, 1 << 63, 333, np.uint64)
        hits += bool((band_keys(h[:300]) == band_keys(h[33:])).any())
    assert hits >= 495
