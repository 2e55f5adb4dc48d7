"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected copies follow from it: each octave of
length has a weight, 2 ** (-tilt * octave), so that longer documents are drawn more seldom, and
expected copies are that weight times one factor a source, never over `most`, whose words add up
to the target. Whole copies are certain. The fraction left over is the document's inclusion
probability p: with u uniform by hash, documents are ranked by u / (1 - u) over p / (1 - p), and
the first ones whose words fill what certain copies leave of the target are drawn once more.

Nothing ranks a source in one task. v = q / (1 + q) of a ranking value q is cut into bins, words are
summed a bin, and every bin before the one in which the target is reached is drawn whole. Only
that bin, of some BIN_ROWS documents however many the source holds (MOST_BINS bins at most), is
gone through in order.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_index
from .common import Steps, fresh, stash

#: Words, as the size of a document counts them.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, over and over; the words of the mix over those of the table; copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Each doubling of length divides a document's expected copies by 2 ** TILT, as far as its source's target allows.
TILT = 0.25
#: Documents of the bin that is gone through in order, about; bins a source, at most.
BIN_ROWS, MOST_BINS = 256, 1 << 16
SEED = 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number strictly between 0 and 1 that follows from parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def filled_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """sources(size, weight, ...) with target: shares of total by weight, none over most times its size.

    What is above a cap is shared again among the others by weight, until none is above: a round is
    two sums, and caps at least one source more.
    """
    cap = F.lit(float(most)) * F.col("size")
    rate, capped = -1.0, F.lit(False)
    while True:
        full, open_, words = sources.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count_if(~capped)).first()
        new = (total - full) / open_ if words and open_ else rate
        if new <= rate:  # the rounds only raise it
            break
        rate = new
        capped = cap < F.lit(rate) * F.col("weight")
    return sources.withColumn("target", F.when(F.lit(rate) < 0, F.lit(0.0)).otherwise(F.least(cap, F.lit(rate) * F.col("weight"))))


def octave(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size))).otherwise(F.lit(0)).cast("int")


def _factor(target: Column, octaves: Column, most: float, tilt: float) -> Column:
    """The factor c for which the words of octaves (octave, words), rising, times min(most, c * weight) add up to target.

    The sum is concave in c. Taking the first k octaves as full, for each k, gives a line that is
    nowhere below it, so that the largest of the lines' solutions is the sum's.
    """
    weight = lambda o: F.pow(F.lit(2.0), F.lit(-tilt) * o["octave"])

    def line(_, k):
        full = F.aggregate(F.slice(octaves, F.lit(1), k), F.lit(0.0), lambda s, o: s + F.lit(float(most)) * o["words"])
        rest = F.aggregate(F.slice(octaves, k + 1, F.size(octaves)), F.lit(0.0), lambda s, o: s + weight(o) * o["words"])
        return F.when(rest > 0, (target - full) / rest)

    return F.coalesce(F.array_max(F.transform(octaves, line)), F.lit(0.0))


def _drawn(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's last bin: documents in order, each that still fits; then one more, if that ends nearer to what is wanted."""
    rows = rows.sort_values(["v", "doc", "row", "size"], kind="stable", na_position="last").reset_index(drop=True)
    left, picked = float(rows.left.iloc[0]), [0] * len(rows)
    size = rows["size"].tolist()
    for i, s in enumerate(size):
        if 0 < s <= left:
            picked[i], left = 1, left - s
    over = [(s, i) for i, s in enumerate(size) if not picked[i] and 0 < s < 2 * left]
    if over:
        picked[min(over)[1]] = 1
    return rows.assign(more=picked)


def drawn_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = TILT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, row, source, size, source_size, target, expected, copies) of every row of docs.

    row is a hash of id and text; two rows with the same id and text are drawn each on its own,
    and which of them is drawn cannot be told apart. Sources are compared as strings, null is one
    of its own and comes last. Null, empty and blank texts have no words; they are never drawn.
    Where share asks for more than most copies of all, all are taken most times.
    """
    source = F.col(source_col).cast("string")
    with Steps(docs.sparkSession) as steps:
        rows = steps.written(docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("row"), source.alias("source"), word_count(F.col(text_col)).alias("size"), uniform(seed, F.col(id_col), F.col(text_col)).alias("u")), "sizes")
        by_octave = rows.groupBy("source", octave(F.col("size")).alias("octave")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        per = steps.written(by_octave.groupBy("source").agg(F.sum("words").alias("size"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("octave", "words"))).alias("octaves")), "sources")
        ordered = steps.written(with_index(per, F.col("source").asc_nulls_last(), name="at"), "ordered")
        weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("at"), F.lit(len(weights))).cast("int"))
        total = float(min(share, most)) * (ordered.agg(F.sum("size")).first()[0] or 0)
        target = filled_targets(ordered.withColumn("weight", weight), total, most)
        rates = steps.written(target.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "n", _factor(F.col("target"), F.col("octaves"), most, tilt).alias("factor")), "rates")

        expected = F.when(F.col("size") > 0, F.round(F.least(F.lit(float(most)), F.col("factor") * F.pow(F.lit(2.0), F.lit(-tilt) * octave(F.col("size")))), 9)).otherwise(0.0)
        joined = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("int"))
        p = F.col("expected") - F.col("sure")
        value = F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
        bins = F.least(F.lit(MOST_BINS), F.ceil(F.col("n") / BIN_ROWS))
        ranked = steps.written(joined.withColumn("q", value).withColumn("v", F.col("q") / (1 + F.col("q"))).withColumn("bin", F.when(F.col("v").isNotNull(), F.least(bins - 1, F.floor(F.col("v") * bins))).cast("int")).select("doc", "row", "source", "size", "source_size", "target", "expected", "sure", "v", "bin"), "ranked")

        sums = ranked.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure_words"), F.max("target").alias("target"))
        all_of, before = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        filled = sums.withColumn("want", F.col("target") - F.sum("sure_words").over(all_of)).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        last = steps.written(filled.where((F.col("bin").isNotNull()) & (F.col("before") + F.col("words") > F.col("want"))).groupBy(F.col("source").alias("of")).agg(F.min(F.struct("bin", (F.col("want") - F.col("before")).alias("left"))).alias("m")).select("of", F.col("m.bin").alias("last"), F.col("m.left").alias("left")), "last")

        near = ranked.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        clear = near.where(F.col("bin").isNull() | F.col("last").isNull() | (F.col("bin") != F.col("last")))
        plain = clear.withColumn("more", F.when(F.col("bin").isNotNull() & (F.col("last").isNull() | (F.col("bin") < F.col("last"))), 1).otherwise(0).cast("long"))
        edge = near.where(F.col("bin") == F.col("last"))
        # A null source has no group of its own name in pandas: the bin's rows are grouped by a flag as well.
        gone_through = edge.groupBy(F.col("source").isNull(), F.coalesce("source", F.lit(""))).applyInPandas(_drawn, edge.withColumn("more", F.lit(0).cast("long")).schema)
        taken = plain.unionByName(gone_through).withColumn("copies", (F.col("sure") + F.col("more")).cast("long"))
        return stash(taken.select("doc", "row", "source", "size", "source_size", "target", "expected", "copies"), "mix")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as often as the mix takes it; columns and their names stay. Further arguments are those of drawn_copies().

    Rows with the same id and text share the copies that any of them is given; where their other
    columns differ, any of them stands for all.
    """
    names = list(docs.columns)
    key, n, number, each = fresh(docs, "row", "copies", "rows", "each")
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    drawn = drawn_copies(docs, **how).where("copies > 0").groupBy("row").agg(F.sum("copies").alias(n)).withColumnRenamed("row", key)
    repeated = docs.withColumn(number, F.xxhash64(id_col, text_col)).join(drawn, F.col(number) == F.col(key)).dropDuplicates([key])
    return repeated.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*(F.col(f"`{c}`") for c in names))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its size and its source's in words, its source's target, and the words that the mix takes of it, repeats counted.

    Null, empty and blank texts have size 0 and are not taken; an empty table gives none; other
    columns are not read. See drawn_copies() for null sources and repeated rows.
    """
    return drawn_copies(docs).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "expected")
