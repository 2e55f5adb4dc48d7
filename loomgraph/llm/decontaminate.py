"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Each training text is cut into words once, and each word hashed. The windows of the text then
leave the row one by one, as a hash each, and meet the hash set of the benchmark's windows in a
broadcast join. A window that is found is verified by its words. All of that is one stage of
compiled code, in which a text's words stay where they are. A benchmark whose set is larger than
BROADCAST_BYTES is joined by shuffle, and its hits are verified by a second hash of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, row_key, stash, words_of

WINDOW = 10
#: The set of windows is broadcast up to this size: their words, and ENTRY_BYTES for each.
BROADCAST_BYTES, ENTRY_BYTES = 48 << 20, 150
#: Flagged documents that are broadcast at most, 16 bytes each.
BROADCAST_KEYS = 200_000


def _hashes(hashes: Column, at: Column, n: int) -> tuple[Column, Column]:
    """Two hashes of the n words from at on, from those of the words."""
    own = [F.get(hashes, at + k) for k in range(n)]
    return F.xxhash64(*own), F.xxhash64(F.lit(n), *own[::-1])


def benchmark_windows(bench: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, hash, check, items): distinct windows with two hashes and the ids of their items, as strings.

    An item of fewer than n words, but not none, is one window; a null text has no words; a
    null id counts as the empty string.
    """
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    size = F.size("w")
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).when(size > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    windows = items.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), n).alias("w"))
    windows = windows.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("len")).agg(F.collect_set("item").alias("items"))
    words = windows.withColumn("h", F.transform(F.split("window", " "), lambda x: F.xxhash64(x)))
    both = {k: _hashes(F.col("h"), F.lit(0), k) for k in range(1, n + 1)}
    hash_, check = (F.coalesce(*(F.when(F.col("len") == k, both[k][i]) for k in both)) for i in (0, 1))
    return words.select("window", "len", hash_.alias("hash"), check.alias("check"), "items")


class WindowSet:
    """The benchmark's windows by hash; windows that share one, should there be any, are told apart by rank."""

    def __init__(self, bench: DataFrame):
        windows = stash(benchmark_windows(bench), "windows")
        self.lengths, size = [], 0
        for n, count, letters in sorted(windows.groupBy("len").agg(F.count(F.lit(1)), F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")))).collect()):  # WINDOW rows at most
            self.lengths.append(n)
            size += letters + ENTRY_BYTES * count
        self.small = size <= BROADCAST_BYTES
        rank = F.row_number().over(Window.partitionBy("hash").orderBy("window"))
        self.table = windows.select(F.col("hash").alias("known"), F.col("window").alias("k_window"), F.col("check").alias("k_check"), F.col("len").alias("k_len"), "items", rank.alias("rank"))

    def hits(self, docs: DataFrame, keep: list[Column], every_row: bool) -> DataFrame:
        """keep, n_words, pos, len and the items of each hit, none where there is no hit, and first, which one row a document has: of every document if every_row, else of those with hits.

        What is built from a text's words is small before it leaves the compiled stage: that
        keeps all rows of a document there at once.
        """
        lengths, kept = self.lengths or [WINDOW], docs.select(*keep).columns
        scan = let(words_of(F.col("text")), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
        rows = docs.select(*keep, scan.alias("scan")).select(*kept, F.col("scan.w").alias("w"), F.col("scan.h").alias("h"))
        # outer: else a filter on the generated array would be pushed down and cut every text twice
        rows = rows.select(*kept, "w", "h", F.size("h").alias("n"), F.posexplode_outer("h").alias("pos", "one")).drop("one")
        if len(lengths) > 1:
            rows = rows.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
        else:
            rows = rows.select("*", F.lit(lengths[0]).alias("len"))
        of = {k: _hashes(F.col("h"), F.col("pos"), k) for k in lengths}
        fits = lambda i: F.coalesce(*(F.when((F.col("len") == k) & (F.col("pos") + k <= F.col("n")), of[k][i]) for k in lengths))
        first = F.coalesce((F.col("pos") == 0) & (F.col("len") == lengths[0]), F.lit(True)).alias("first")
        rows = rows.select(*kept, "n", "pos", "len", first, fits(0).alias("hash"), *([F.col("w")] if self.small else [fits(1).alias("check")]))
        joined = rows.join(F.broadcast(self.table) if self.small else self.table, F.col("hash") == F.col("known"), "left" if every_row else "inner")
        if every_row:
            joined = joined.where(F.col("first") | F.col("known").isNotNull())
        same = F.col("k_window") == F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ") if self.small else F.col("k_check") == F.col("check")
        items = F.when((F.col("k_len") == F.col("len")) & same, F.col("items")).alias("items")
        return joined.select(*kept, F.col("n").cast("long").alias("n_words"), "pos", "len", (F.col("first") & (F.coalesce("rank", F.lit(1)) == 1)).alias("first"), items)


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per row of docs: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window. Null and empty texts have no
    words and are clean; repeated rows each get their row; overlapping and repeated windows
    count each word once; with an empty benchmark every document is clean. Only doc_id and
    text are read.
    """
    rows = WindowSet(bench).hits(docs, [F.col("doc_id").alias("doc_id"), row_key().alias("key")], every_row=True)
    per = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if("first").alias("copies"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "len"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc, x):
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    per = per.withColumn("n_hit", F.aggregate(F.array_sort("hits"), start, cover, lambda acc: acc["n"])).withColumn("items", F.array_sort("items"))
    return per.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns stay as they are, whatever their names.

    Null and empty texts stay, and with an empty benchmark all. The flagged keys are broadcast
    only while they are few; the join shuffles otherwise.
    """
    a, b = fresh(docs, "a", "b")
    rows = WindowSet(bench).hits(docs, [row_key().alias("key")], every_row=False).where(F.col("items").isNotNull())
    flagged = stash(rows.select(F.col("key.a").alias(a), F.col("key.b").alias(b)).distinct(), "contaminated", at_most=docs.count())
    few = flagged.count() <= BROADCAST_KEYS
    at = row_key()
    return docs.join(F.broadcast(flagged) if few else flagged, (at["a"] == F.col(a)) & (at["b"] == F.col(b)), "left_anti")
