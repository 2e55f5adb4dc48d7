"""Small awkward tables and plain rules that the operators are held against."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("key", T.StringType())])
LONG = " ".join(f"word{i % 977}" for i in range(9000))


def awkward_rows():
    """Null and empty texts, null ids, ties, repeated rows, a very long text, one long word, clashing column names."""
    texts = [None, "", "   \n\t ", "One two", "ÀÉ façade Ünïcode \U0001f600 text", "a" * 60000, LONG, "1" * 5000, "line one\nline two\n\nline one"]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None, None, None), (None, "no id here", None, None, 1, None, None), (50, "One two", "en", None, 7, "x", "y")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(spark, texts, first=0):
    return frame(spark, [(i, t, "en", f"src{i % 3}", 0, "x", "y") for i, t in enumerate(texts, first)])


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
