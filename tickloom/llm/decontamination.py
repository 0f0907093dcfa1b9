"""Operator 4, benchmark decontamination: size-partitioned MinHash containment search, then exact shingles.

DataFrame functions only. A document's own MinHash values would almost never be those of a short item
inside it, so the search is for containment: an item's sketch is the ``L`` smallest of its ``q``
shingle hashes, a random sample of them, and the share of the sketch that a document holds estimates
how much of the item it holds. A document that contains the item to the share ``t`` misses at most
``m = q - ceil(t * q)`` shingles, and so holds at least ``L - m`` of the sketch.

Items are partitioned by size, in classes of a power of two. Each class has its own ``L - m``
(``SKETCH_SHARE`` of the class's smallest size, one at least), and with it sketches that are long
enough for its sizes: candidates of a class are the pairs whose estimate is that high, which loses
no document, however long. The candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import columns

#: Shingles of a sketch that a document must hold, as a share of the size at which the item's class begins.
SKETCH_SHARE = 0.25
#: Rows of the sketch table that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; empty for null. Only the first and the last part of a split can be empty."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _places(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep``, ``_words`` and the first place ``_i`` (from 0) of each shingle: one shingle where there are fewer words than ``k``, none without words.

    The outer form, as Spark would otherwise split every text once more to leave out those without words.
    """
    return rows.select(*keep, "_words", F.posexplode_outer("_words").alias("_i", "_word")).where((F.col("_i") == 0) | (F.col("_i") <= F.size("_words") - k))


def _hashed(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep`` and the hash ``_h`` of each shingle. No lambda and no copy of the words, so that it is one generated loop."""
    return _places(rows, k, *keep).select(*keep, F.xxhash64(*(F.get("_words", F.col("_i") + j) for j in range(k))).alias("_h"))


def _spelled(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep`` and the distinct shingles as text, ``_shingle``."""
    return _places(rows, k, *keep).select(*keep, F.concat_ws(" ", F.slice("_words", F.col("_i") + 1, k)).alias("_shingle")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, words: int = 5, containment: float = 0.8, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id_column``, ``item_column``, ``n_shingles``, ``n_shared`` and ``containment`` of each document that holds at least that share of an item's distinct shingles.

    Words are runs of letters and digits, lower-cased; a text of fewer than ``words`` words is one
    shingle, a text without words has none and matches nothing. Sketches of more than
    ``broadcast_rows`` rows are joined by a shuffle of document ids and hashes.

    Rows that share an id count as one document (or item). A row without an id is not reported.
    Null and empty texts match nothing; empty tables give no rows. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_column).alias("_item"), words_of(F.col(text_column)).alias("_words")).where(F.col("_item").isNotNull())
    texts = _spelled(items, words, "_item")
    sizes = texts.groupBy("_item").agg(F.count(F.lit(1)).alias("_q")).withColumn("_need", F.ceil(F.col("_q") * F.lit(containment) - 1e-9))

    # The size class, what its documents must hold of a sketch, and the sketches' length.
    classes = sizes.withColumn("_class", F.floor(F.log2("_q")).cast("int")).withColumn("_hits", F.least(F.greatest(F.floor(F.pow(F.lit(2.0), "_class") * SKETCH_SHARE), F.lit(1)), "_need").cast("long"))
    smallest = Window.partitionBy("_class", "_item").orderBy("_h")
    sketch = _hashed(items, words, "_item").distinct().join(classes, "_item").withColumn("_place", F.row_number().over(smallest))
    sketch = sketch.where(F.col("_place") <= F.col("_q") - F.col("_need") + F.col("_hits")).select("_class", "_item", "_hits", "_h")
    probe = F.broadcast(sketch) if sketch.count() <= broadcast_rows else sketch

    known = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text")).where(F.col("_doc").isNotNull())
    split = lambda df: df.select("_doc", words_of(F.col("_text")).alias("_words"))
    met = _hashed(split(known), words, "_doc").join(probe, "_h").select("_doc", "_class", "_item", "_hits", "_h").distinct()
    candidates = met.groupBy("_doc", "_class", "_item", "_hits").agg(F.count(F.lit(1)).alias("_n")).where("_n >= _hits").select("_doc", "_item")

    # What is left is read once more: candidates alone. Whole texts are joined, which are smaller than their lists of words.
    held = _spelled(split(known.join(candidates.select("_doc").distinct(), "_doc", "left_semi")), words, "_doc")
    wanted = candidates.join(texts, "_item").select("_doc", "_item", "_shingle")
    shared = wanted.join(held, ["_doc", "_shingle"]).groupBy("_doc", "_item").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(sizes, "_item").where(F.col("n_shared") >= F.col("_need"))
    return found.select(F.col("_doc").alias(id_column), F.col("_item").alias(item_column), F.col("_q").alias("n_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("_q"), 6).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``; options as for ``find_contamination``."""
    key = options.get("id_column", "doc_id")
    return docs.join(find_contamination(docs, benchmark, **options).select(key).distinct(), key, "left_anti").select(columns(docs))
