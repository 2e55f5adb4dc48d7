"""Sharding and batching of records: blocks, rounds, length groups, padding, resuming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from .graph import SEED
from .order import with_index


def block_shards(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df, index and shard: contiguous blocks of ceil(rows / n) rows by order."""
    rows = with_index(df, *order)
    size = max(1, -(-rows.count() // n))
    return rows.withColumn("shard", F.floor(F.col("index") / size))


def round_robin(df: DataFrame, n: int, *order: str) -> DataFrame:
    return with_index(df, *order).withColumn("shard", F.col("index") % n)


def row_slice(df: DataFrame, start: int, stop: int, *order: str) -> DataFrame:
    return with_index(df, *order).where((F.col("index") >= start) & (F.col("index") < stop))


def merge_shards(shards: list[DataFrame], n_full: int, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """All shards' rows of this sharding (id, e, shard_id, num_shards), and the ids below n_full that none has."""
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    every = every.where(F.col("num_shards") == n_shards)
    missing = every.sparkSession.range(n_full).join(every, "id", "left_anti")
    return every, missing


def not_yet_written(todo: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def shuffled(df: DataFrame, *key: str, seed: int = SEED) -> DataFrame:
    """df with place: its index in a hash order of key."""
    return with_index(df.withColumn("__h", seeded(seed, *(F.col(k) for k in key))), "__h", *key, name="place").drop("__h")


def length_batches(df: DataFrame, megabatch: int, id_col: str = "id", length: str = "length", seed: int = SEED) -> DataFrame:
    """df with megabatch and rank: shuffled, cut into windows, the longest first inside each."""
    rows = shuffled(df, id_col, seed=seed).withColumn("megabatch", F.floor(F.col("place") / megabatch))
    w = Window.partitionBy("megabatch").orderBy(F.col(length).desc(), "place")
    return rows.withColumn("rank", F.row_number().over(w) - 1)


def even_chunks(ids: list[int], lengths: list[int], n: int) -> list[list[int]]:
    """Positions of ids dealt to n chunks: to the shortest with room, or in turn if they do not divide."""
    if len(ids) % n:
        return [list(range(k, len(ids), n)) for k in range(n)]
    room, chunks, load = len(ids) // n, [[] for _ in range(n)], [0] * n
    for i in range(len(ids)):
        k = min((c for c in range(n) if len(chunks[c]) < room), key=lambda c: (load[c], c))
        chunks[k].append(i)
        load[k] += lengths[i]
    return chunks


def balanced_chunks(batches: DataFrame, n: int) -> DataFrame:
    """(id, megabatch, chunk, at) of length_batches' rows: a megabatch is one small group."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        chunks = even_chunks(pdf.id.tolist(), pdf.length.tolist(), n)
        rows = [(int(pdf.id.iloc[i]), int(pdf.megabatch.iloc[0]), c, at) for c, own in enumerate(chunks) for at, i in enumerate(own)]
        return pd.DataFrame(rows, columns=["id", "megabatch", "chunk", "at"])

    return batches.select("id", "megabatch", "rank", "length").groupBy("megabatch").applyInPandas(deal, "id long, megabatch long, chunk int, at int")


def modality_batches(df: DataFrame, megabatch: int, seed: int = SEED) -> DataFrame:
    """(id, length, modality, megabatch, rank): length groups for each sign of length, the incomplete last ones of both merged as the last."""
    parts = []
    for sign in (1, -1):
        own = df.where(F.signum("length") == sign).select("id", F.abs("length").alias("length"))
        n = own.count()
        whole = n // megabatch if n % megabatch else max(0, n // megabatch - 1)  # the last one, complete or not, is merged
        b = length_batches(own, megabatch, seed=seed).select("id", "length", F.lit(sign).alias("modality"), "megabatch", "rank")
        parts.append(b.withColumn("tail", F.col("megabatch") >= whole).withColumn("whole", F.lit(whole)))
    first = parts[0].unionByName(parts[1])
    at = F.when(F.col("modality") == 1, F.col("megabatch")).otherwise(F.col("megabatch") + F.lit(0))
    name = F.concat(F.when(F.col("tail"), F.lit("tail")).when(F.col("modality") == 1, F.lit("graph")).otherwise(F.lit("text")), F.when(F.col("tail"), F.lit("")).otherwise(F.concat(F.lit("-"), at.cast("string"))))
    return first.select("id", "length", "modality", name.alias("batch"), "rank")


def padded(tokens: Column, length: Column, value) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(tokens)).cast("int")))


def pad_spliced(df: DataFrame, batch: int, order: str = "id", value: str = "<pad>", ignored: str = "-100") -> DataFrame:
    """(id, batch, tokens, labels, mask) of (id, pieces), pieces an array of (token, label, seen): filled up on the right to the batch's longest."""
    rows = with_index(df.select("id", "pieces"), order).withColumn("batch", F.floor(F.col("index") / batch))
    longest = F.max(F.size("pieces")).over(Window.partitionBy("batch"))
    one = lambda field: F.transform("pieces", lambda p: p[field])
    full = rows.withColumn("longest", longest)
    return full.select("id", "batch", padded(one("token"), F.col("longest"), value).alias("tokens"), padded(one("label"), F.col("longest"), ignored).alias("labels"), padded(one("seen"), F.col("longest"), False).alias("mask"))


def pad_batches(df: DataFrame, batch: int, most: int, order: str = "id", value: str = "<pad>") -> DataFrame:
    """(id, batch, tokens, mask): cut at most, then filled up to the batch's longest."""
    rows = with_index(df, order).withColumn("batch", F.floor(F.col("index") / batch)).withColumn("tokens", F.slice("tokens", 1, most))
    longest = F.max(F.size("tokens")).over(Window.partitionBy("batch"))
    full = rows.withColumn("longest", longest)
    return full.select("id", "batch", padded(F.col("tokens"), F.col("longest"), value).alias("tokens"), padded(F.transform("tokens", lambda t: F.lit(1)), F.col("longest"), 0).alias("mask"))
