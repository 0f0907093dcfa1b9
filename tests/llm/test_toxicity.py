import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs
from tickloom.llm.queries import held_out
from tickloom.llm.toxicity import BLOCK, DOUBT, EXAMPLES, LEAST_RATIO, LEAST_ROWS, NEAREST, OTHER_WORD, SAMPLE_ROWS, _numbers, fit, reject_toxic, score_toxicity


def corpus(spark, n=900):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(400)]
    bad = ["awful", "nasty", "rotten", "vile"]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), "en", "src", 0))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((d, t) for d, _, t in labels)


def test_held_out_accuracy_and_exact_neighbours(spark):
    docs, labels, truth = corpus(spark)
    index = fit(docs, labels, ~held_out())
    rows = score_toxicity(docs, index).withColumn("out", held_out()).collect()
    out = [r for r in rows if r.out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # The cosines with all examples, from the postings as a whole matrix.
    flat = np.zeros((len(index.ids), len(index.number)))
    term = np.repeat(np.repeat(np.arange(len(index.number)), np.diff(index.of_term)), np.diff(index.of_entry))
    flat[index.place, term] = index.weight
    assert (index.most == [flat[b * BLOCK : (b + 1) * BLOCK, t].max() for t in range(len(index.number)) for b in index.block[index.of_term[t] : index.of_term[t + 1]]]).all()
    for r in docs.limit(60).collect():
        found, others = _numbers(r.text, index.number)
        if found:
            at, n = np.unique(np.array(found), return_counts=True)
            w = index.weigh(at, n, others)
            cosines = flat[:, at] @ w
            order = [k for k in np.lexsort((index.ids, -cosines)) if cosines[k] > 0][:NEAREST]
            places, scores = index.nearest(at, w)
            assert np.allclose(scores, cosines[order]) and np.allclose(sorted(scores), sorted(cosines[places]))
    kept = {r.doc_id for r in reject_toxic(docs, index).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted == 0}


def plain_scores(spark, docs, labels):
    """The whole rule once more, with dictionaries: no index, no blocks, no numbers of terms."""
    told = {r.doc_id: r.toxic for r in labels.where(~held_out()).collect()}
    hashed = spark.createDataFrame([(d,) for d in told], "d long").select("d", F.xxhash64("d", F.lit("sample")).alias("h"), F.pmod(F.xxhash64("d", F.lit("role")), F.lit(10)).alias("role")).collect()
    order = [(r.d, r.role) for r in sorted(hashed, key=lambda r: (r.h, r.d))][:SAMPLE_ROWS]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def split(text):
        words = re.findall(r"\w+", text.lower())
        return words, ["~" + w[:n] for w in words for n in (4, 5, 6, 7) if len(w) > n]

    learned = [d for d, role in order if role > 1]
    n = [sum(told[d] == y for d in learned) for y in (0, 1)]
    seen = {}
    for d in learned:
        for t in set(sum(split(texts[d]), [])):
            seen.setdefault(t, [0, 0])[told[d]] += 1
    xlog = lambda a, b: a * math.log(a / b) if a > 0 and b > 0 else 0.0
    vocabulary = set()
    for t, (c, x) in seen.items():
        share = (c + x) / sum(n)
        ratio = 2 * (xlog(c, share * n[0]) + xlog(x, share * n[1]) + xlog(n[0] - c, (1 - share) * n[0]) + xlog(n[1] - x, (1 - share) * n[1]))
        if ratio >= LEAST_RATIO and c + x >= LEAST_ROWS:
            vocabulary.add(t)
    df = Counter(t for text in texts.values() for t in set(sum(split(text), [])) & vocabulary)
    idf = {t: math.log1p(len(texts) / max(df[t], 1)) for t in vocabulary}

    def vector(text):
        words, stems = split(text)
        tf = Counter(t for t in words + stems if t in vocabulary)
        w = {t: (1 + math.log(k)) * idf[t] for t, k in tf.items()}
        length = math.sqrt(sum(v * v for v in w.values()) + OTHER_WORD * sum(x not in vocabulary for x in words))
        return {t: v / length for t, v in w.items()}

    vectors = {d: vector(t) for d, t in texts.items()}
    examples = [d for y in (1, 0) for d in [d for d in learned if told[d] == y and vectors[d]][:EXAMPLES]]

    def vote(d):
        cosines = sorted(((-sum(v * vectors[e].get(t, 0.0) for t, v in vectors[d].items()), e) for e in examples))[:NEAREST]
        w = [(c * c, e) for c, e in cosines if c < 0]
        return sum(x * told[e] for x, e in w) / (sum(x for x, _ in w) + DOUBT)

    votes = {d: vote(d) for d in texts}
    fitted = [(votes[d], told[d]) for d, role in order if role <= 1]
    n1 = sum(y for _, y in fitted)
    goal = [(n1 + 1) / (n1 + 2) if y else 1 / (len(fitted) - n1 + 2) for _, y in fitted]
    a = b = 0.0
    for _ in range(200):  # Newton steps on the penalised likelihood, written out
        p = [1 / (1 + math.exp(-(a * v + b))) for v, _ in fitted]
        g1 = sum((g - q) * v for g, q, (v, _) in zip(goal, p, fitted, strict=True)) - 1e-3 * a
        g0 = sum(g - q for g, q in zip(goal, p, strict=True)) - 1e-3 * b
        h11 = sum(q * (1 - q) * v * v for q, (v, _) in zip(p, fitted, strict=True)) + 1e-3
        h10 = sum(q * (1 - q) * v for q, (v, _) in zip(p, fitted, strict=True))
        h00 = sum(q * (1 - q) for q in p) + 1e-3
        det = h11 * h00 - h10 * h10
        a += max(-5.0, min(5.0, (h00 * g1 - h10 * g0) / det))
        b += max(-5.0, min(5.0, (h11 * g0 - h10 * g1) / det))
    return {d: 1 / (1 + math.exp(-(a * v + b))) for d, v in votes.items()}


def test_scores_equal_the_rule_written_out(spark):
    docs, labels, _ = corpus(spark, 700)
    got = {r.doc_id: r.score for r in score_toxicity(docs, fit(docs, labels, ~held_out())).collect()}
    want = plain_scores(spark, docs, labels)
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-7
    assert len({round(s, 6) for s in want.values()}) > 50


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit(docs, x, ~held_out()) for x in (labels, flipped))
    assert a.number == b.number and (a.weight == b.weight).all() and (a.place == b.place).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_repeated_ids_come_once(spark):
    docs, labels, _ = corpus(spark, 200)
    again = docs.union(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    a, b = fit(docs, labels, ~held_out()), fit(again, labels, ~held_out())
    assert len(set(b.ids.tolist())) == len(b.ids) and set(a.ids.tolist()) == set(b.ids.tolist())


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 200)
    odd = odd_docs(spark).withColumn("score", F.lit("clash"))
    assert score_toxicity(odd, fit(docs, labels, ~held_out())).count() == odd.count()
    nothing = fit(docs, labels.limit(0), ~held_out())
    assert {r.predicted for r in score_toxicity(odd, nothing).collect()} == {0}
    assert reject_toxic(odd, nothing).count() == odd.count()
    assert score_toxicity(empty_docs(spark), nothing).collect() == []
