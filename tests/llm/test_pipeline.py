from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import DOCS, empty_docs, odd_docs
from tickloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "mixing", "token_output"]
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len(got) < docs.count() and {r.doc_id for r in got} <= ids
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k * 7 % 389}" for k in range(300))
    near = text.replace(" w70 ", " changed ", 1)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([text, text, near, "another short text of its own", "", None])] + [(None, text, "en", "s", 0)]
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, DOCS), SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 3), (False, 4), (True, 0)]


def test_mixed_order_reaches_the_token_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mixing(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    order = [r.doc_id for r in mixed.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()]
    out = corpus_pipeline.token_output(spark, mixed, SF).orderBy("start").collect()
    assert [r.doc_id for r in out] == order


def test_every_stage_on_odd_and_empty_tables(spark, tmp_path):
    clash = {"score": F.lit("own"), "component_id": F.lit(7), "_src": F.lit("own"), "_bin": F.lit(None).cast("int"), "mix_place": F.lit(1.5), "_doc": F.lit("own"), "_t": F.lit("own"), "shard": F.lit("own"), "id": F.lit(-1), "a.b": F.lit("dot"), "c`d": F.lit("tick"), "_metadata": F.lit("own"), "mix_slot": F.lit(2.5), "mix_block": F.lit("own"), "mix_offset": F.lit(None).cast("int"), "c0": F.lit("own"), "c1": F.lit(8)}
    for name, first in (("odd", odd_docs(spark).withColumns(clash)), ("empty", empty_docs(spark).withColumns(clash))):
        docs = first
        for number, (stage, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{stage}")
            f(spark, docs, SF).write.parquet(path)
            then = spark.read.parquet(path)
            if number < 4:
                assert then.columns == docs.columns and then.exceptAll(docs).isEmpty()
            else:
                assert then.count() == docs.count()
            if stage == "mixing":
                assert docs.exceptAll(then).isEmpty()
            docs = then
        # Of 20 rows those go that are like an earlier one: of the texts without words 1, 2 and 11, of the same three words 2, 5 and 6, and the second "tie".
        assert docs.count() == (0 if name == "empty" else 13)
