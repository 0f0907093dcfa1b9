"""Operator 2, token counts: Arrow batches balanced by bytes go to the tokenizer, which returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pieces import WITH_SPACE, balanced, worker_pieces

#: Bytes of text in one tokenizer call.
BATCH_BYTES = 1 << 20


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``tokenizer``: path of a byte-level ``tokenizers`` file, read by the driver. No begin, end or
    added special tokens; a special string inside a text counts as the library's default has it.
    Texts are cut where the tokenizer itself cuts, before white space, so a long text is counted
    piece by piece and no sum differs from the library's on the whole text.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows are counted
    each. An empty table gives no rows. Other columns are dropped, whatever their names.
    """
    content = Path(tokenizer).read_text(encoding="utf-8")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(content, WITH_SPACE)
        for batch in balanced(batches, "text", batch_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n_bytes"), pa.array(pieces.lengths(batch.column("text")))], [id_column, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema[id_column].dataType.simpleString()
    counted = rows.mapInArrow(lengths, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
