"""Operator 8, toxicity: nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms are words and the first four to seven letters of longer words. A bounded sample of labelled rows
(``SAMPLE_ROWS``) gives the vocabulary (all terms whose presence tells the labels apart, by the
log-likelihood ratio), at most ``EXAMPLES`` examples of either label and the rows for calibration;
document frequencies are counted over all documents. The nearest examples vote with the square of
their cosine, and a logistic curve fitted on sampled rows that are no examples turns the vote into a
probability.

The index is inverted: of each term it has the blocks of examples that hold it, with the term's
largest weight there, and of each such block the postings, examples and weights. A text's terms and
those maxima bound its cosine with all examples of a block; blocks are opened from the largest bound
down until no other can hold one of the nearest, so the nearest are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pieces import balanced
from tickloom.llm.shared import numbered

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
#: Labelled rows that the vocabulary, the examples and the calibration are taken from; those with the smallest hashes of the id.
SAMPLE_ROWS = 8192
#: The least log-likelihood ratio and rows of a term of the vocabulary.
LEAST_RATIO, LEAST_ROWS = 16.0, 3
#: Examples of either label at most, examples of a block, and how many vote.
EXAMPLES, BLOCK, NEAREST = 512, 64, 16
#: Blocks that are opened before the bounds are looked at again.
TOGETHER = 4
#: Added to the votes' weights: a text like no example has vote 0.
DOUBT = 0.5
#: Squared weight of each word outside the vocabulary: such words match nothing and count in a text's norm, so one term in a long text is less than one in a short text.
OTHER_WORD = 1.0


def terms(text: str | None) -> tuple[list[str], list[str]]:
    """Words, and their stems."""
    words = WORD.findall((text or "").lower())
    return words, ["~" + w[:n] for n in STEMS for w in words if len(w) > n]


def _numbers(text: str | None, number: dict[str, int]) -> tuple[list[int], int]:
    """Numbers of all occurrences of terms of the vocabulary; how many words are outside it."""
    words, stems = terms(text)
    known = [k for k in map(number.get, words) if k is not None]
    return known + [k for k in map(number.get, stems) if k is not None], len(words) - len(known)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` numbers from each of ``starts`` on."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


@dataclass
class Index:
    """Term ``t`` has the entries ``of_term[t]`` to ``of_term[t + 1]``, one for each block that holds it; entry ``e`` the postings ``of_entry[e]`` to ``of_entry[e + 1]``. Examples are ordered so that similar ones share blocks."""

    number: dict[str, int]
    idf: np.ndarray
    of_term: np.ndarray
    block: np.ndarray
    most: np.ndarray
    of_entry: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def of(cls, number: dict[str, int], idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int]], toxic: list[int], ids: list[int]) -> Index:
        """``examples``: numbers and occurrences of the terms of each, and its other words."""
        none = np.zeros(0, np.int64)
        index = cls(number, idf, none, none, np.zeros(0), none, none, np.zeros(0), np.array(toxic, float), np.array(ids, np.int64))
        term = np.concatenate([none, *(at for at, _, _ in examples)])
        place = np.repeat(np.arange(len(examples)), [len(at) for at, _, _ in examples])
        weight = np.concatenate([np.zeros(0), *(index.weigh(at, n, others) for at, n, others in examples)])
        order = np.lexsort((place, term))
        term, index.place, index.weight = term[order], place[order], weight[order]
        begins = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(index.place // BLOCK, prepend=-1))
        index.block, index.of_entry = index.place[begins] // BLOCK, np.concatenate([begins, [len(term)]])
        index.most = np.maximum.reduceat(index.weight, begins) if len(begins) else np.zeros(0)
        index.of_term = np.searchsorted(term[begins], np.arange(len(number) + 1))
        return index

    def weigh(self, at: np.ndarray, n: np.ndarray, others: int) -> np.ndarray:
        """Weights of terms that occur ``n`` times, in a vector of length 1."""
        w = (1 + np.log(n)) * self.idf[at]
        return w / np.sqrt((w**2).sum() + OTHER_WORD * others)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples, nearest first, ties by id; none with cosine 0."""
        many = self.of_term[at + 1] - self.of_term[at]
        entries, w = _ragged(self.of_term[at], many), np.repeat(w, many)
        block = self.block[entries]
        bound = np.bincount(block, w * self.most[entries], minlength=1)
        places, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        best = np.argsort(-bound, kind="stable")
        best = best[bound[best] > 0]
        for k0 in range(0, len(best), TOGETHER):
            if len(scores) == k and bound[best[k0]] < least - 1e-9:
                break
            opened = np.zeros(len(bound), bool)
            opened[best[k0 : k0 + TOGETHER]] = True
            mine = opened[block]
            here = entries[mine]
            sizes = self.of_entry[here + 1] - self.of_entry[here]
            posts = _ragged(self.of_entry[here], sizes)
            found = np.bincount(self.place[posts], np.repeat(w[mine], sizes) * self.weight[posts])
            known = np.flatnonzero(found > 0)
            places, scores = np.concatenate([places, known]), np.concatenate([scores, found[known]])
            order = np.lexsort((self.ids[places], -scores))[:k]
            places, scores = places[order], scores[order]
            least = scores[-1] if len(scores) else 0.0
        return places, scores

    def vote(self, scores: np.ndarray, places: np.ndarray) -> float:
        w = scores**2
        return float((w * self.toxic[places]).sum() / (w.sum() + DOUBT))

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))


def _calibrated(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, on Platt's smoothed targets."""
    if not len(votes):
        return 4.0, -2.0
    n1 = toxic.sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (len(toxic) - n1 + 2))
    x, theta = np.stack([votes, np.ones_like(votes)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * theta)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _sampled(labels: DataFrame, is_training, id_column: str, label_column: str, rows: int) -> DataFrame:
    """Labelled training rows of the smallest hashes: ``_id``, ``_toxic``, ``_hash`` and ``_role`` (0 to 9; 0 and 1 are for calibration)."""
    known = labels.where(is_training & F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
    one = known.groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("_toxic"))
    digest = F.xxhash64("_id", F.lit("sample"))
    return one.withColumn("_hash", digest).orderBy("_hash", "_id").limit(rows).withColumn("_role", F.pmod(F.xxhash64("_id", F.lit("role")), F.lit(10)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, is_training, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Index:
    """The index. ``is_training``: condition on ``id_column`` for the labels that may be used.

    To the driver come the vocabulary and, of at most ``sample_rows`` labelled ids, the numbers of
    the terms they hold: sizes that don't grow with the input. Of documents that share a sampled id
    the one with the smallest text counts.
    """
    # At most sample_rows rows of three small columns.
    sample = F.broadcast(_sampled(labels, is_training, id_column, label_column, sample_rows))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(sample, "_id").groupBy("_id", "_toxic", "_hash", "_role").agg(F.min("text").alias("text"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", 1 << 22):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                for t in set().union(*terms(text)):
                    seen.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["term", "clean", "toxic"])

    learned = rows.where("_role > 1")
    of_label = {r["_toxic"]: r["count"] for r in learned.groupBy("_toxic").count().collect()}
    n0, n1 = of_label.get(0, 0), of_label.get(1, 0)
    counts = learned.select("text", "_toxic").mapInArrow(present, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    part = lambda seen, expected: F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
    share = (c + t) / max(n0 + n1, 1)
    ratio = 2 * (part(c, share * n0) + part(t, share * n1) + part(n0 - c, (1 - share) * n0) + part(n1 - t, (1 - share) * n1))
    vocabulary = [r.term for r in counts.withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (c + t >= LEAST_ROWS)).select("term").orderBy("term").collect()]
    number = {w: k for k, w in enumerate(vocabulary)}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(number) + 1, np.int64)
        for batch in balanced(batches, "text", 1 << 22):
            for text in batch.column("text").to_pylist():
                n[-1] += 1
                n[[k for k in map(number.get, set().union(*terms(text))) if k is not None]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["k", "n"])

    totals = docs.select(F.col(text_column).alias("text")).mapInArrow(frequencies, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(number) + 1)
    for r in totals:
        df[r.k] = r.n
    idf = np.log1p(df[-1] / np.maximum(df[:-1], 1))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", 1 << 22):
            found = [_numbers(x, number) for x in batch.column("text").to_pylist()]
            pairs = [np.unique(np.array(f, np.int64), return_counts=True) for f, _ in found]
            columns = [pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_toxic", "_hash", "_role")), *columns], ["_id", "_toxic", "_hash", "_role", "at", "n", "others"])

    kind = docs.schema[id_column].dataType.simpleString()
    labelled = rows.select("_id", "_toxic", "_hash", "_role", "text").mapInArrow(numbered, f"_id {kind}, _toxic int, _hash long, _role int, at array<long>, n array<long>, others long")
    # By hash, so that examples are of all ids alike, however ids follow time or source.
    sampled = sorted(labelled.collect(), key=lambda r: (r._hash, r._id, r._toxic, r.at, r.n, r.others))

    chosen = [r for y in (1, 0) for r in [x for x in sampled if x._role > 1 and x._toxic == y and x.at][:EXAMPLES]]
    # Examples whose rarest terms are alike come together, which keeps blocks' bounds low.
    chosen.sort(key=lambda r: (-r._toxic, max(r.at, key=lambda k: (idf[k], -k)), r._id))
    index = Index.of(number, idf, [(np.array(r.at), np.array(r.n), r.others) for r in chosen], [r._toxic for r in chosen], [r._id for r in chosen])
    votes, truth = [], []
    for r in sampled:
        if r._role <= 1:
            at = np.array(r.at, np.int64)
            places, scores = index.nearest(at, index.weigh(at, np.array(r.n), r.others))
            votes.append(index.vote(scores, places))
            truth.append(r._toxic)
    index.slope, index.offset = _calibrated(np.array(votes), np.array(truth))
    return index


def score_toxicity(docs: DataFrame, index: Index, *, id_column: str = "doc_id", text_column: str = "text", evidence: int = 3) -> DataFrame:
    """``id_column``, ``score`` (0 to 1, higher: label 1 is likelier), ``predicted`` (1 from 0.5) and ``evidence``, the nearest examples with their labels and cosines.

    Whole texts are scored. A null or empty text, like any text without a term of the vocabulary,
    has vote 0 and no evidence. Without labels no text is toxic. A null id stays null; repeated rows
    are scored each; an empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    item = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = index.probability(0.0)
        for batch in balanced(batches, "text", 1 << 22):
            scores, why = [], []
            for text in batch.column("text").to_pylist():
                found, others = _numbers(text, index.number)
                if not found:
                    scores.append(plain)
                    why.append([])
                    continue
                at, n = np.unique(np.array(found, np.int64), return_counts=True)
                places, near = index.nearest(at, index.weigh(at, n, others))
                scores.append(index.probability(index.vote(near, places)))
                why.append([{"doc_id": int(index.ids[p]), "toxic": int(index.toxic[p]), "cosine": float(s)} for p, s in zip(places[:evidence], near[:evidence], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, pa.list_(item))], [id_column, "score", "evidence"])

    rows = docs.select(F.col(id_column), F.col(text_column).alias("text")).mapInArrow(scored, f"`{id_column}` {kind}, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    return rows.select(id_column, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, index: Index, *, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose score is below ``threshold``. Nulls, repeated rows and empty tables: as for ``score_toxicity``. Columns may have any names."""
    rows, plain = numbered(docs)
    text_column = plain[text_column]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = index.probability(0.0)
        for batch in balanced(batches, text_column, 1 << 22):
            keep = []
            for text in batch.column(text_column).to_pylist():
                found, others = _numbers(text, index.number)
                score = plain
                if found:
                    at, n = np.unique(np.array(found, np.int64), return_counts=True)
                    places, near = index.nearest(at, index.weigh(at, n, others))
                    score = index.probability(index.vote(near, places))
                keep.append(score < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(kept, rows.schema).toDF(*docs.columns)
