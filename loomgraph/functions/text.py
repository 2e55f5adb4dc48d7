"""Text rules: label spelling, folding of spaces, chat markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of a label that count as the label.
SYNONYMS = {
    "experimentally induced diabetes": ["diabetes mellitus experimental"],
    "diabetes mellitus type1": ["diabetes mellitus type 1"],
    "diabetes mellitus type2": ["diabetes mellitus type 2"],
}
SPACES = r"[ \t\n\r\x0b\x0c]+"


def folded(text: Column) -> Column:
    """Lower case, underscores and runs of spaces as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "_", " ")), SPACES, " "))


def compact(text: Column) -> Column:
    return F.translate(folded(text), " ", "")


def spellings(label: Column) -> Column:
    """Folded spellings of a label, its synonyms among them."""
    pairs = [F.lit(x) for k, v in SYNONYMS.items() for x in (k, "\x1f".join(v))]
    other = F.split(F.create_map(*pairs)[folded(label)], "\x1f")
    return F.array_distinct(F.concat(F.array(folded(label)), F.coalesce(other, F.array().cast("array<string>"))))


def mentions(answer: Column, label: Column) -> Column:
    """Whether any spelling stands in the answer, with or without its spaces."""
    plain, tight = folded(answer), compact(answer)
    return F.exists(spellings(label), lambda s: F.contains(plain, s) | F.contains(tight, F.translate(s, " ", "")))


def word_list(text: Column) -> Column:
    """Words between ASCII spaces; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def seeded(seed: int, *parts: Column) -> Column:
    """A hash order that any engine can reproduce: md5 of seed and parts, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))
