"""The corpus pipeline: documents in, token files out. Each stage is one operator of ``tickloom.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontamination import decontaminate
from tickloom.llm.mixing import in_mixed_order, mix_sources, tempered_weights
from tickloom.llm.queries import CONTAINMENT, MIX_BLOCK, MIX_EXPONENT, held_out
from tickloom.llm.near_texts import near_texts
from tickloom.llm.shared import columns, new_path, numbered, partitions, stash, table
from tickloom.llm.token_files import token_digests, write_tokens
from tickloom.llm.toxicity import fit, reject_toxic

#: Texts of so many shared shingles, as a share of all shingles of both, are near duplicates.
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of two such texts differ in 39 of 256 bits on average; candidates up to NEAR_BITS apart (five standard deviations more) are compared by their shingles.
NEAR_WIDTH, SURE_BITS, NEAR_BITS = 256, 20, 72


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. Null texts are empty and judged like texts without a known term; rows without an id and repeated rows are judged each; other columns pass as they are, whatever their names."""
    return reject_toxic(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out()))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Null and empty texts are alike, one of them stays; a row without an id stays; rows that share an id stay or go together. Other columns pass as they are."""
    classes = near_texts(docs, words=NEAR_WORDS, bits=NEAR_WIDTH, bits_apart=SURE_BITS, link_bits=NEAR_BITS, similarity=SIMILARITY)
    gone = stash(classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go. Null and empty texts hold none; a row without an id stays; rows that share an id count as one document. Other columns pass as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), words=5, containment=CONTAINMENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order: through the files by number, and within a file by row. Null sources are one source; nulls elsewhere and repeated rows each have a place. Other columns pass as they are."""
    rows, plain = numbered(docs)
    mixed = mix_sources(rows, tempered_weights(rows, source_column=plain["source"], exponent=MIX_EXPONENT), id_column=plain["doc_id"], source_column=plain["source"], block_rows=MIX_BLOCK)
    return in_mixed_order(mixed, partitions(spark)).toDF(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the files of ``docs``; what is read back from them, by document. A null text is empty: the end id alone. Null ids stay null, repeated rows are written each, other columns are left out."""
    file = docs.metadataColumn("_metadata")  # also where a column has that name
    name = file["file_name"]
    placed = docs.select("doc_id", "text", F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long").alias("_part"), name.alias("_file"), file["row_index"].alias("_row"))
    path = new_path(spark, "tokens")
    write_tokens(placed, path, public_tokenizers.path("word_bpe_49k.json"), order_by=("_part", "_file", "_row"))
    return token_digests(spark, path)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: No stage but the last has an SQL form that DuckDB could run: hashes and tokenizers are not its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
