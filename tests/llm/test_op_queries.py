"""The registered queries without SQL, over the smallest tables, against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickloom.llm.queries import QUERIES, TRICKY
from tickloom.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def rows(spark, query):
    return QUERIES[query](spark, SF).collect()


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op2_counts_whole_texts(spark):
    whole, docs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts(spark)
    want = {d: len(whole.encode(t, add_special_tokens=False).ids) for d, t in docs.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op2_token_counts")} == {(d, len(docs[d].encode()), n, n > 512) for d, n in want.items()}


def test_op3_links_at_two_bits(spark):
    fps = {d: fingerprint(t, 3, 64) for d, t in texts(spark).items()}
    number = {d: int.from_bytes(f) for d, f in fps.items()}
    component, todo = {}, sorted(number)
    for d in todo:
        if d not in component:
            reached = [d]
            for at in reached:
                component[at] = d
                reached += [o for o in todo if o not in component and o not in reached and (number[o] ^ number[at]).bit_count() <= 2]
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op3_simhash_dedup")} == {(d, f.hex(), component[d]) for d, f in fps.items()}


def test_op5_recall_and_order(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], float)
    got = defaultdict(list)
    for r in rows(spark, "op5_nearest"):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:10]
        own = sorted(got[int(ids[i])])
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & set(near)), total + len(near)
    assert hits >= 0.9 * total


def test_op7_reads_back_what_the_library_gives(spark):
    whole, docs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), texts(spark)
    start, want = 0, []
    for d in sorted(docs):
        ids = [*whole.encode(docs[d], add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op7_token_files")) == want


def test_op8_scores_every_document(spark):
    got = rows(spark, "op8_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts(spark))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op9_digests(spark):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    turns += [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]
    by = defaultdict(list)
    for conv, turn, role, text in sorted(turns):
        by[conv].append((role, text))
    want = set()
    for conv, own in by.items():
        loss = "".join(t for role, t in own if role == "assistant")
        want.add((conv, len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, "op9_chat_format")} == want


def test_op10_keeps_every_line_somewhere(spark):
    docs, got = texts(spark), rows(spark, "op10_line_dedup")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.n_lines == docs[r.doc_id].count("\n") + 1 and 0 <= r.removed_lines <= r.n_lines for r in got)
    assert all(r.removed_lines or r.kept_md5 == hashlib.md5(docs[r.doc_id].encode()).hexdigest() for r in got)
