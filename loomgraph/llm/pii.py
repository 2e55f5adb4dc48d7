"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

All of it is column expressions. A match's place follows from the lengths of the matches and of
the gaps between them, summed by doubling steps; its surroundings are read from a few of the
text's blocks of BLOCK characters, never from the whole text. Runs that cannot be part of a match are
entered at their first character only, and repeats never give back. So long texts, and texts
that are nothing but matches, take linear time (sums and sorting add a logarithm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: In the order in which spans with one start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text needs to hold for a kind's expression to be tried at all.
NEEDS = {"email": r"@", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|kontakt|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta|swift|bic)\b",
    "ssn": r"(?i)\b(?:ssn|social security|security number|tax id)\b",
}
AGAINST = r"(?i)\b(?:version|release|order|invoice|build|isbn|chapter)\b"
#: A match by its form alone; a confirmed checksum and a context word raise it, a word against it lowers it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.4}
CHECKED, NEAR, FAR, KEEP = 0.3, 0.2, -0.2, 0.6
REACH, BLOCK = 40, 256
SPAN = "array<struct<start:int,rank:int,end:int,value:string,score:double>>"


def running_sum(values: Column) -> Column:
    """Prefix sums of an array of up to 2**24 numbers, in log2 passes."""

    def step(acc, k):
        shift = F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.size(acc) > shift, F.transform(acc, lambda x, i: x + F.when(i >= shift, F.get(acc, i - shift)).otherwise(F.lit(0)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), values, step)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The account number check: first four characters last, letters as 10 to 35, remainder 1."""
    flat = F.translate(value, " ", "")
    moved = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return F.length(F.translate(value, " ", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def blocks_of(text: Column) -> Column:
    """The text in pieces of BLOCK code points: any place of it is then reached in a fixed time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _window(blocks: Column, start: Column, size: Column) -> Column:
    """size characters from start on, REACH at most."""
    k = F.floor(start / BLOCK).cast("int")
    two = F.concat_ws("", F.get(blocks, k), F.get(blocks, k + 1))
    return F.substring(two, start - k * BLOCK + 1, size)


def _score(kind: str, blocks: Column, start: Column, end: Column) -> Column:
    left = F.greatest(start - REACH, F.lit(0))
    near = F.concat_ws(" ", _window(blocks, left, start - left), _window(blocks, end, F.lit(REACH)))
    known = PRIOR[kind] + (CHECKED if kind in ("card", "iban") else 0.0)
    return let(near, lambda s: F.round(F.least(F.lit(1.0), F.lit(known) + F.when(F.rlike(s, F.lit(CONTEXT[kind])), NEAR).otherwise(0.0) + F.when(F.rlike(s, F.lit(AGAINST)), FAR).otherwise(0.0)), 3))


def spans(kind: str, text: Column, blocks: Column) -> Column:
    """Array of (start, rank, end, value, score) of a kind's confirmed matches; code points, end exclusive. blocks is blocks_of(text)."""
    pattern, rank = F.lit(PATTERNS[kind]), KINDS.index(kind)

    def located(found):
        def with_gaps(gaps):
            steps = F.transform(found, lambda m, i: F.get(gaps, i) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)))
            return let(running_sum(steps), lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(rank).alias("rank"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"))))

        return let(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), with_gaps)

    def scored(found):
        good = F.filter(located(found), lambda s: _valid(kind, s["value"]))
        out = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["value"].alias("value"), _score(kind, blocks, s["start"], s["end"]).alias("score")))
        return F.filter(out, lambda s: s["score"] >= KEEP) if kind not in BASE else out

    none = F.array().cast(SPAN)
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, scored(m)).otherwise(none).cast(SPAN))).otherwise(none)


def find_spans(docs: DataFrame, text_col: str = "text") -> Column:
    """All kinds' spans, by start and then kind; empty for null and empty texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = lambda t: let(blocks_of(t), lambda b: F.concat(*(spans(k, t, b) for k in KINDS)))
    every = let(text, lambda t: F.when(F.rlike(t, F.lit("[@0-9]")), found(t)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(every)


def listed(found: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts per kind, the spans, and their best score.

    Null and empty texts have none, and a very long text takes time in proportion to its
    characters and matches; rows stand for themselves, so repeated rows, null ids,
    empty tables and further columns change nothing for others. Equal starts are listed in
    the order of KINDS. Base matches stay whatever their score; the added kinds need KEEP.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), find_spans(docs).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS) if k not in BASE),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("best_score"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; overlapping spans are cut once. Null texts stay null, and other columns stay, whatever their names."""
    names, found = list(docs.columns), fresh(docs, "found")[0]
    kinds = F.array(*(F.lit(k) for k in KINDS))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cut(acc, s):
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(kinds, s["rank"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col(found), start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.withColumn(found, find_spans(docs, text_col)).withColumn(text_col, F.when(F.size(found) > 0, done).otherwise(F.col(text_col))).select(*(F.col(f"`{c}`") for c in names))
