"""Helpers shared by the corpus operators: row keys, let-binding, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Steps, scratch_root, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters, digits and everything beyond ASCII; the text has been lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where df has a column of that name in any case: what is joined to df cannot clash with it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Two hashes that stand for (doc_id, text); never null, equal for repeated rows."""
    return F.struct(
        F.xxhash64(F.col(doc_id), F.col(text).isNull(), F.col(text)).alias("a"),
        F.coalesce(F.crc32(F.col(text)), F.lit(-1)).alias("b"),
    )


def long_array(values) -> Column:
    """A constant array<long>; one literal string for the planner, folded once."""
    values = list(values)
    if not values:
        return F.array().cast("array<long>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
