import random
import re

from tests.llm.cases import empty_docs, odd_docs
from tickloom.llm.decontamination import decontaminate, find_contamination


def shingles(text, k=5):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow(docs, items, share=0.8):
    return sorted((d, i, len(q), len(q & s)) for i, t in items if (q := shingles(t)) for d, x in docs if (s := shingles(x)) and len(q & s) >= share * len(q) - 1e-9)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta éta zeta eta theta iota kappa ll mm nn oo pp qq rr ss tt uu".split())
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(25)] + [(90, ""), (91, None), (92, "one two three")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 300)))) for k in range(60)]
    for k in range(60, 120):
        words = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((k, " ".join(word() for _ in range(50)) + ". " + ", ".join(words).title() + " " + word()))
    docs += [(200, "One, two: THREE!"), (201, None), (202, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert len(want) > 15
    for rows in (2_000_000, 0):  # 0: sketches are joined by a shuffle
        assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in find_contamination(a, b, broadcast_rows=rows).collect()) == want
    kept = {r.doc_id for r in decontaminate(a, b).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in want}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three", "x"), (1, "one two three", "x"), (None, "one", "x")], "item_id long, text string, doc_id string")
    got = find_contamination(odd_docs(spark), items).collect()
    assert sorted({r.doc_id for r in got}) == [2, 5, 6]
    assert {r.item_id for r in got} == {1}
    assert decontaminate(odd_docs(spark), items).where("doc_id IS NULL").count() == 1
    assert find_contamination(empty_docs(spark), items).collect() == []
    assert find_contamination(odd_docs(spark), items.limit(0)).collect() == []
