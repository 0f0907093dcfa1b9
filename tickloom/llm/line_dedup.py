"""Operator 10, line dedup: content-defined chunks of lines, of which global repeats are removed.

A rolling hash over the hashes of two lines ends a chunk where it is divisible by ``lines_apart``,
so an insertion moves boundaries near it only. Chunks of several lines that occur more than once in
the corpus are compared byte by byte, and all but the first are removed.

Boundaries that depend on content seldom fall on both ends of a short passage. Passages of over a
number of words are therefore found by windows too: for each line the shortest run of whole lines
of so many words that begins with it, and the shortest that ends with it. They depend on the
passage alone, and every line of a repeated passage is in one that lies inside the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pieces import balanced
from tickloom.llm.shared import stash

LINES_APART = 4
LONGEST = 64
_MASK = (1 << 64) - 1


def chunk_lines(lines: list[str], lines_apart: int = LINES_APART, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """First line and the line after the last of each chunk; a chunk has ``longest`` lines at most."""
    start, last = 0, 0
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled, last = (h * 0x9E3779B97F4A7C15 + last) & _MASK, h
        if (rolled >> 32) % lines_apart == 0 or i + 1 - start >= longest:
            yield start, i + 1
            start = i + 1
    if start < len(lines):
        yield start, len(lines)


def several(chunk: list[str]) -> bool:
    """Whether a chunk is of several lines that aren't blank; others are never removed."""
    return sum(1 for x in chunk if x.strip()) > 1


def passage_windows(lines: list[str], words: int) -> set[tuple[int, int]]:
    """First line and the line after the last of the shortest runs of over ``words`` words that begin with a line or end with one; blank lines do neither."""
    filled = [(i, n) for i, n in enumerate(len(x.split()) for x in lines) if n]
    found, first, held = set(), 0, 0
    for end, n in filled:
        held += n
        while held > words:
            found.add((filled[first][0], end + 1))
            held -= filled[first][1]
            first += 1
        if first:
            found.add((filled[first - 1][0], end + 1))
    return found


def _spans(lines: list[str], apart: int, longest: int, words: int | None) -> set[tuple[int, int]]:
    """Runs of lines that are removed where they are repeated."""
    chunks = {(a, b) for a, b in chunk_lines(lines, apart, longest) if several(lines[a:b])}
    return chunks if words is None else chunks | passage_windows(lines, words)


def _key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def dedup_lines(docs: DataFrame, *, lines_apart: int = LINES_APART, longest: int = LONGEST, passage_words: int | None = None, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """``id_column``, ``text`` without repeated chunks, ``n_lines``, ``n_chunks``, ``removed_chunks`` and ``removed_lines`` of each row.

    Lines end at ``\\n``. The first occurrence, which stays, is that with the smallest id (null
    first), then by the hash of the whole text, then by place in the text. Chunks with equal 128-bit hashes
    are removed only if all their bytes are equal: the smallest and the largest text under a hash
    are compared, which needs no task that holds a group.

    With ``passage_words``, runs of whole lines of over so many words are removed wherever they are
    repeated, one long line too (``passage_windows``); a line goes if one repeated run covers it, and
    blank lines go between two lines that go. The earliest occurrence of a line that isn't
    blank is in no later occurrence of a run, so no such line is lost altogether.

    A null text stays null, with no lines. An empty text has one line. Rows that are equal in id and
    text count as one occurrence, so a repeated row keeps what its twin keeps. An empty table gives
    no rows. Other columns are dropped, whatever their names.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_tie"), F.col(text_column).alias("text"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", batch_bytes):
            at, number, keys = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines = text.split("\n") if text is not None else []
                for a, b in _spans(lines, lines_apart, longest, passage_words):
                    at.append(i)
                    number.append(a << 32 | b)
                    keys.append(_key("\n".join(lines[a:b])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), batch.column(1).take(pa.array(at, pa.int32())), pa.array(number, pa.int64()), pa.array(keys, pa.binary())], ["_id", "_tie", "_span", "_key"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", batch_bytes):
            keys, found = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("_wanted").to_pylist(), strict=True):
                lines = text.split("\n")
                for span in set(wanted):
                    found.append("\n".join(lines[span >> 32 : span & 0xFFFFFFFF]))
                    keys.append(_key(found[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["_key", "_text"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", batch_bytes):
            out: list[tuple] = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                if text is None:
                    out.append((None, 0, 0, 0, 0))
                    continue
                lines, n_chunks, lost_chunks = text.split("\n"), 0, 0
                lost = {i for span in gone or () for i in range(span >> 32, span & 0xFFFFFFFF)}
                if lost and passage_words is not None:
                    filled = [i for i, x in enumerate(lines) if x.strip()]
                    lost.update(i for a, b in pairwise(filled) if a in lost and b in lost for i in range(a + 1, b))
                for a, b in chunk_lines(lines, lines_apart, longest):
                    n_chunks, lost_chunks = n_chunks + 1, lost_chunks + all(i in lost for i in range(a, b))
                out.append(("\n".join(x for i, x in enumerate(lines) if i not in lost), len(lines), n_chunks, lost_chunks, len(lost)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_column, "text", "n_lines", "n_chunks", "removed_chunks", "removed_lines"])

    places = stash(rows.mapInArrow(chunked, f"_id {kind}, _tie long, _span long, _key binary").distinct(), "chunks")
    place = F.struct("_id", "_tie", "_span")
    repeated = places.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n")
    again = places.join(repeated, "_key")

    by = lambda df: df.withColumn("_none", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.lit(0).cast(kind)))  # noqa: E731  null ids join too
    keyed, join = by(rows), ["_id", "_none", "_tie"]
    wanted = by(again).groupBy(*join).agg(F.collect_list("_span").alias("_wanted"))
    compared = keyed.join(wanted, join).select("text", "_wanted").mapInArrow(texts, "_key binary, _text string")
    equal = compared.groupBy("_key").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b")).where(F.col("_a") == F.col("_b")).select("_key")
    gone = by(again.join(equal, "_key").where(place != F.col("_first"))).groupBy(*join).agg(F.collect_list("_span").alias("_gone"))
    whole = keyed.join(gone, join, "left").select(F.when(~F.col("_none"), F.col("_id")).alias("_id"), "text", "_gone")
    return whole.mapInArrow(cleaned, f"`{id_column}` {kind}, text string, n_lines long, n_chunks long, removed_chunks long, removed_lines long")
