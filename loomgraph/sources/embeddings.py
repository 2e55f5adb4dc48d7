"""One vector a node from a model's states, kept shard by shard: a shard is there whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import group_sums
from ..session import files_of, publish


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Shards that are there."""
    at, files = files_of(spark, path)
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("shard="))


def pooled_states(states: DataFrame, size: int) -> DataFrame:
    """(id, e) of (id, pos, e, seen): the mean over the positions that are seen; zeros for an id without any."""
    seen = states.where("seen and e is not null")
    zero = F.array_repeat(F.lit(0.0), size)
    return states.select("id").distinct().join(group_sums(seen.select("id", "e"), ["id"], size, F.avg, name="mean"), "id", "left").select("id", F.coalesce("mean", zero).alias("e"))


def dump(states: DataFrame, path: str, size: int, shards: int = 64, at_once: int = 16, only: range | None = None) -> int:
    """Pool states into shards below path, those that are not there yet; how many were made. only names a run's share of them.

    Shards are made at_once at a time: they are written beside, and each is renamed into place. A run
    that is cut off loses the group it was at; the next one goes on with what lacks.
    """
    spark = states.sparkSession
    there = set(committed(spark, path))
    lacking = [k for k in only or range(shards) if k not in there]
    made = 0
    for a in range(0, len(lacking), at_once):
        group = lacking[a : a + at_once]
        own = f"{path}/.writing-{uuid.uuid4().hex}"
        some = states.where(shard_of(shards).isin(group))
        pooled_states(some, size).withColumn("shard", shard_of(shards)).repartition("shard").write.partitionBy("shard").parquet(own)
        for k in group:
            part, files = files_of(spark, f"{own}/shard={k}")
            files.mkdirs(part)  # one that no id falls in is committed too
            made += publish(spark, f"{own}/shard={k}", f"{path}/shard={k}")
        at, files = files_of(spark, own)
        files.delete(at, True)
    return made


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, e array<double>, shard int").parquet(path).select("id", "e")


def missing(ids: DataFrame, path: str) -> DataFrame:
    """Ids of ids that the dump does not hold."""
    return ids.select("id").distinct().join(read_dump(ids.sparkSession, path).select("id"), "id", "left_anti")
