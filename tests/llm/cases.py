"""Small tables with the odd cases that every operator must handle."""

from pyspark.sql import Row, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = ["", None, " ", "one", "one two", "One  two\tthree", "one two three", "é É ß ẞ 的", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1dz a", "line\nline\nline\n", "\n\n", LONG, "tie", "tie", "a\xa0b  c　d"]


def odd_docs(spark: SparkSession):
    rows = [(i, t, "en", "src0" if i % 3 else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [(2, "one two three", "en", "src1", 3), (None, "no id here", None, "src1", None), (3, "one", "en", "src1", 3), (3, "one", "en", "src1", 3)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark: SparkSession):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    """Rows as sorted tuples by column name."""
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


__all__ = ["DOCS", "LONG", "ODD", "Row", "empty_docs", "odd_docs", "rows_of"]
