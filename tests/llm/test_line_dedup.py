import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.cases import DOCS, empty_docs, odd_docs
from tickloom.llm.line_dedup import chunk_lines, dedup_lines, passage_windows, several
from tickloom.llm.queries import QUERIES


def slow(rows, apart=4):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        lines, kept, lost = text.split("\n"), [], 0
        for k, (a, b) in enumerate(chunk_lines(lines, apart)):
            chunk = lines[a:b]
            if several(chunk) and seen.setdefault("\n".join(chunk), (doc, k)) != (doc, k):
                lost += len(chunk)
            else:
                kept += chunk
        out[doc] = ("\n".join(kept), lost)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(9)
    passage = [f"shared line {k} {rng.random()}" for k in range(20)]
    rows = []
    for i in range(80):
        lines = [f"own {i} {rng.random()}" for _ in range(rng.randint(1, 12))]
        if i % 2:
            at = rng.randrange(len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines), "en", "s", 0))
    rows += [(80, rows[1][1], "en", "s", 0), (81, rows[1][1], "en", "s", 0)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = slow([(r[0], r[1]) for r in rows])
    assert got == want
    assert sum(lost for _, lost in want.values()) > 300


def test_boundaries_resist_shifts():
    lines = [f"line {k}" for k in range(200)]
    ends = {lines[b - 1] for _, b in chunk_lines(lines)}
    shifted = {x for x in (["new"] + lines)[0:1]}
    moved = [(["new"] + lines)[b - 1] for _, b in chunk_lines(["new"] + lines)]
    assert len(ends ^ (set(moved) - shifted)) <= 2


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("n_lines", F.lit("clash"))
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.text) for r in got if r.removed_lines == 0) <= Counter((r.doc_id, r.text) for r in docs.collect())
    assert [r.text for r in got if r.doc_id == 1] == [None]
    none = [(None, "a b\nc d\ne f"), (None, "x\ny"), (1, "a b\nc d\ne f")]
    some = dedup_lines(spark.createDataFrame(none, "doc_id long, text string")).collect()
    assert sum(r.removed_lines for r in some if r.doc_id is None) == 0
    assert dedup_lines(empty_docs(spark)).collect() == []


def test_every_repeated_passage_goes(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shapes = [[60], [30, 30], [51], [3, 45, 4], [20] * 3, [10] * 6, [7] * 8, [26, 0, 26], [60, 0, 60]]
    rows, passages = [], []
    for k, shape in enumerate(shapes * 4):
        passages.append("\n".join(words(n) for n in shape))
        for copy in range(3):
            rows.append((3 * k + copy, "\n".join([words(rng.randint(1, 80)), passages[-1], words(rng.randint(1, 80))])))
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=50).collect()}
    for doc, text in rows:
        lines = text.split("\n")
        assert got[doc].text == (text if doc % 3 == 0 else f"{lines[0]}\n{lines[-1]}")
        assert (got[doc].n_lines, got[doc].removed_lines) == (len(lines), 0 if doc % 3 == 0 else len(lines) - 2)


def test_windows_cover_whole_passages_only():
    rng = random.Random(4)
    for _ in range(200):
        lines = [" ".join("w" * rng.choice([0, 1, 5, 20, 60])) for _ in range(rng.randint(1, 12))]
        counts = [len(x.split()) for x in lines]
        windows = passage_windows(lines, 50)
        assert all(sum(counts[a:b]) > 50 and counts[a] and counts[b - 1] for a, b in windows)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(counts[a:b]) > 50 and counts[a] and counts[b - 1]:
                    assert {i for s, e in windows if a <= s and e <= b for i in range(s, e) if counts[i]} == {i for i in range(a, b) if counts[i]}


def test_no_line_is_lost_altogether(spark):
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "xyz"]
    rows = [(i, "\n".join(long[(i + j) % 3] for j in range(7))) for i in range(6)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=50).collect()
    assert Counter(x for r in got for x in r.text.split("\n") if x) == Counter(long)


def plain_dedup(docs, words=50):
    """The registered form by its definition: runs of lines compared as texts, windows by trying every end."""
    spans, first = {}, {}
    for doc, text in sorted(docs.items()):
        lines = text.split("\n")
        counts = [len(x.split()) for x in lines]
        own = {(a, b) for a, b in chunk_lines(lines) if sum(1 for x in lines[a:b] if x.strip()) > 1}
        filled = [i for i, n in enumerate(counts) if n]
        for i in filled:
            ahead = [j + 1 for j in filled if j >= i and sum(counts[i : j + 1]) > words]
            behind = [j for j in filled if j <= i and sum(counts[j : i + 1]) > words]
            own |= {(i, ahead[0])} if ahead else set()
            own |= {(behind[-1], i + 1)} if behind else set()
        spans[doc] = {(a, b): "\n".join(lines[a:b]) for a, b in own}
        for (a, b), run in spans[doc].items():
            first[run] = min(first.get(run, (doc, a, b)), (doc, a, b))
    out = {}
    for doc, text in docs.items():
        lines = text.split("\n")
        lost = {i for (a, b), run in spans[doc].items() if first[run] != (doc, a, b) for i in range(a, b)}
        filled = [i for i, x in enumerate(lines) if x.strip()]
        for a, b in zip(filled, filled[1:], strict=False):
            if a in lost and b in lost:
                lost |= set(range(a, b)) if lost else set()
        kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
        chunks = list(chunk_lines(lines))
        out[doc] = (len(lines), len(chunks), sum(all(i in lost for i in range(a, b)) for a, b in chunks), len(lost), len(kept), hashlib.md5(kept.encode()).hexdigest())
    return out


def test_op10_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_lines, r.n_chunks, r.removed_chunks, r.removed_lines, r.kept_chars, r.kept_md5) for r in QUERIES["op10_line_dedup"](spark, sf).collect()}
    want = plain_dedup(docs)
    assert got == want
    assert sum(w[3] for w in want.values()) > 20
