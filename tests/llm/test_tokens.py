import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import ODD, empty_docs, odd_docs
from tickloom.llm.pieces import WITH_SPACE, WORDS, Pieces
from tickloom.llm.shared import new_path
from tickloom.llm.token_counts import count_tokens
from tickloom.llm.token_files import from_planes, read_tokens, to_planes, token_digests, write_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "É", "é", "́", " ", "  ", "\n", "\t", "\xa0", "\x85", " ", "　", "​", "12", "²", "'s", " 'll", "<|endoftext|>", "<|startoftext|>", "\x1c", "᠎", "ß", "Σ", "的", "!?", "\r\n", "\x0b", "İ", "ﬁ", "word", "the ", "Word.", "éÀ,", "...", "it's, ", "<|ENDOFTEXT|>", "a.b", "ǅ", "ª."]


@pytest.mark.parametrize(("path", "cut"), [(BYTE, WITH_SPACE), (WORD, WORDS)])
def test_pieces_equal_the_library_on_whole_texts(path, cut):
    whole, pieces = Tokenizer.from_file(path), Pieces(open(path, encoding="utf-8").read(), cut, kept_bytes=2000)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
    def same(text):
        texts = ["one word", text, "", text]
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        found, sizes = pieces.ids(pa.array(texts))
        assert found.tolist() == [k for ids in want for k in ids]
        assert sizes.tolist() == pieces.lengths(pa.array(texts)).tolist() == [len(ids) for ids in want]

    same()


def test_pieces_under_one_hash_and_of_real_texts(spark, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for path, cut in ((BYTE, WITH_SPACE), (WORD, WORDS)):
        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
        for one_hash in (False, True):
            if one_hash:
                monkeypatch.setattr("tickloom.llm.pieces.hashes", lambda pieces: np.zeros(len(pieces), np.uint64))
            pieces = Pieces(open(path, encoding="utf-8").read(), cut, kept_bytes=200_000)
            for k in range(0, len(texts), 40):
                assert pieces.lengths(pa.array(texts[k : k + 40])).tolist() == want[k : k + 40]
            monkeypatch.undo()


def test_counts_equal_the_library(spark):
    whole = Tokenizer.from_file(BYTE)
    docs = odd_docs(spark).withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit("clash"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, BYTE, batch_bytes=64).collect())
    want = Counter()
    for r in docs.collect():
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
    assert got == want
    assert count_tokens(empty_docs(spark), BYTE).collect() == []


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 70))
def test_planes_round_trip(ids, block):
    array = np.array(ids, "<u4")
    assert from_planes(to_planes(array, block), len(array), block).tolist() == ids


def test_files_round_trip(spark):
    whole = Tokenizer.from_file(WORD)
    docs = odd_docs(spark).withColumn("shard", F.lit("clash"))
    path = new_path(spark, "test")
    write_tokens(docs, path, WORD, end_id=1, block_ids=1000, chunk_ids=3000)
    want = Counter((r.doc_id, np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect())
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert rows[0].doc_id is None and known == sorted(known)
    assert {(r.start, zlib.crc32(bytes(r.ids))) for r in rows} == {(r.start, r.ids_crc32) for r in token_digests(spark, path).collect()}
    assert len(rows) == docs.count() > len(ODD)


def test_empty_files(spark):
    path = new_path(spark, "test")
    write_tokens(empty_docs(spark), path, WORD)
    assert token_digests(spark, path).collect() == []
