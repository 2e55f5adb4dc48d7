"""Sharding through fixed virtual slots.

Every record hashes to one of N_SLOTS virtual slots, which never change. Bytes and rows are
summed per slot, and a versioned slot-to-shard map says where each slot lives. Rebalancing
and growing edit that map, a few thousand numbers, and move whole slots.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import long_array, scratch_root, stash

N_SLOTS = 4096


@dataclass
class SlotMap:
    """shard[slot] is where a slot lives in this version of the map; editing makes the next version."""

    n_shards: int
    shard: np.ndarray
    version: int = 0

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        return cls(n_shards, np.arange(n_slots) % n_shards)

    def rebalance(self, weight: np.ndarray) -> SlotMap:
        """The version in which slots have moved, or changed places, until no such edit evens the shards further; this one if there is none.

        Each edit shrinks the gap between the fullest shard and another, so the loop ends.
        """
        shard, w = self.shard.copy(), np.asarray(weight, dtype=np.int64)
        load = np.bincount(shard, weights=w, minlength=self.n_shards).astype(np.int64)
        for _ in range(8 * len(w)):
            high, done = int(load.argmax()), True
            mine = np.flatnonzero((shard == high) & (w > 0))
            for low in np.argsort(load, kind="stable")[: max(1, self.n_shards // 2)]:
                gap = int(load[high] - load[low])
                if low == high or gap < 2 or not len(mine):
                    continue
                theirs = np.append(np.flatnonzero(shard == low), -1)
                given = np.sort(np.append(w[theirs[:-1]], 0))
                order = np.append(theirs[:-1], -1)[np.argsort(np.append(w[theirs[:-1]], 0), kind="stable")]
                want = w[mine] - gap / 2  # what should come back for each slot given
                at = np.clip(np.searchsorted(given, want), 1, len(given) - 1) if len(given) > 1 else np.zeros(len(mine), int)
                prev = np.maximum(at - 1, 0)
                at = np.where(np.abs(given[prev] - want) <= np.abs(given[at] - want), prev, at)
                moved = w[mine] - given[at]
                off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
                best = int(off.argmin())
                if not np.isfinite(off[best]):
                    continue
                shard[mine[best]] = low
                if order[at[best]] >= 0:
                    shard[order[at[best]]] = high
                load[high] -= moved[best]
                load[low] += moved[best]
                done = False
                break
            if done:
                break
        return self if (shard == self.shard).all() else SlotMap(self.n_shards, shard, self.version + 1)

    def grow(self, weight: np.ndarray) -> SlotMap:
        """The version with one more shard; slots move into it only, from the fullest shards."""
        shard, w, new = self.shard.copy(), np.asarray(weight, dtype=np.int64), self.n_shards
        load = np.bincount(shard, weights=w, minlength=new + 1).astype(np.int64)
        goal = w.sum() / (new + 1)
        for slot in np.argsort(-w, kind="stable"):
            if w[slot] and load[new] + w[slot] <= goal and load[shard[slot]] - w[slot] >= goal * 0.995:
                load[shard[slot]] -= w[slot]
                load[new] += w[slot]
                shard[slot] = new
        return SlotMap(new + 1, shard, self.version + 1)


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_map(slots: SlotMap, spark: SparkSession, path: str) -> bool:
    """Publish a version beside the others, which stay as they are; False if that version is there already.

    The version is written under a name of its own and renamed when it is whole, so that a run
    that is cut off leaves nothing that counts, and of two runs at once one is the first. A
    folder that a cut-off run left under the version's name, without the mark of success, goes.
    """
    table = spark.range(len(slots.shard)).select(F.col("id").alias("virtual_slot"), F.get(long_array(slots.shard.tolist()), F.col("id").cast("int")).cast("int").alias("shard"), F.lit(slots.n_shards).alias("n_shards"))
    own, final = f"{path}/.writing-{uuid.uuid4().hex}", f"{path}/version={slots.version}"
    table.coalesce(1).write.parquet(own)
    source, files = _files(spark, own)
    to, _ = _files(spark, final)
    if files.exists(to) and not _whole(spark, final):
        files.delete(to, True)
    # rename() puts a folder into one that is there already, so that is looked at first and afterwards.
    done = not files.exists(to) and files.rename(source, to)
    inside, _ = _files(spark, f"{final}/{source.getName()}")
    if done and files.exists(inside):
        files.delete(inside, True)
        done = False
    files.delete(source, True)
    return done


def _whole(spark: SparkSession, version: str) -> bool:
    mark, files = _files(spark, f"{version}/_SUCCESS")
    return files.exists(mark)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, the last whole one if none is named; None if there is no map. A version is as many rows as slots."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return None
    names = [f.getPath().getName() for f in files.listStatus(at)]
    there = [int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n)) and _whole(spark, f"{path}/{n}")]
    if not there:
        return None
    version = max(there) if version is None else version
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard", "n_shards").collect()))
    return SlotMap(rows[0][2], np.array([r[1] for r in rows]), version)


def current_map(spark: SparkSession, path: str, n_shards: int, n_slots: int, weight: np.ndarray) -> SlotMap:
    """The last stored map, grown to n_shards and rebalanced by weight, with each version on the way stored.

    Where another run has stored a version meanwhile, that one counts, and the editing goes on from it.
    """
    slots = read_map(spark, path)
    while True:
        if slots is None:
            new = SlotMap.initial(n_shards, n_slots)
        elif len(slots.shard) != n_slots or slots.n_shards > n_shards:
            raise ValueError(f"the map at {path} has {len(slots.shard)} slots and {slots.n_shards} shards")
        else:
            new = slots.grow(weight) if slots.n_shards < n_shards else slots.rebalance(weight)
            if new is slots:
                return slots
        if write_map(new, spark, path):
            slots = new
            continue
        slots = read_map(spark, path)
        if slots is None or slots.version < new.version:
            raise RuntimeError(f"version {new.version} can't be stored at {path}")


def slot_digest(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; a null text has size 1 and checksum 0."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)))


def slot_loads(digest: DataFrame, n_slots: int = N_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per virtual slot; n_slots numbers each reach the driver, whatever the input."""
    size, rows = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    for s, b, n in digest.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[s], rows[s] = b, n
    return size, rows


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every row of docs in a shard, by the law `bytes`: shards' sizes are near equal.

    A row's slot number is its place in its shard, gapless from 0: rows are counted inside
    their virtual slot only, and the slots' row counts give each one its first number.
    The map at map_path is read, edited and stored under its next version; the same table
    leaves it as it is. Without a path, a new map is begun in the shared folder. Null ids and
    texts, repeated rows and an empty table are placed like any others; other columns of docs
    are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    digest = stash(slot_digest(docs, n_slots), "slots")
    size, rows = slot_loads(digest, n_slots)
    slots = current_map(spark, map_path or f"{scratch_root(spark)}/loomgraph/slot_maps/{uuid.uuid4().hex}", n_shards, n_slots, size)
    first = np.zeros(n_slots, np.int64)
    for shard in range(n_shards):
        own = np.flatnonzero(slots.shard == shard)
        first[own] = np.cumsum(rows[own]) - rows[own]
    at = F.col("virtual_slot").cast("int")
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return digest.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(long_array(slots.shard.tolist()), at).cast("int").alias("shard"),
        (F.get(long_array(first.tolist()), at) + F.row_number().over(place) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )

