"""Conflict-constrained best-fit packing of documents into sequences of CAPACITY words.

A document longer than a sequence fills whole ones first; what remains is packed, largest first.
Open bins are ordered by what they have left, and carry a bitmap of their sources and one of
their duplicate clusters. A piece goes to the tightest bin it fits that holds neither its source
nor its cluster: the search starts at the piece's size and moves to the successor, bin by bin,
until one is compatible; failing all, a bin is opened. Documents are dealt by hash into groups of
about GROUP, each packed by itself, so that a group's bins fit one task whatever the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY, GROUP = 1024, 4096
WORDS = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins by residual: level[r] lists the bins with r words left, in order of opening."""

    def __init__(self, capacity: int):
        self.capacity, self.levels = capacity, 0
        self.level: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.common = [0] * (capacity + 1)  # sources that every bin of a level holds
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The tightest bin with room for size that holds neither bit."""
        rest = self.levels >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            if not self.common[r] & source:
                for b in self.level[r]:
                    if not (self.sources[b] & source or self.clusters[b] & cluster):
                        return b
            rest >>= step + 1
            r += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        b = self.find(size, source, cluster)
        if b is None:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            r = self.left[b]
            own = self.level[r]
            del own[bisect_left(own, b)]
            if own:
                common = self.sources[own[0]]
                for x in own:
                    common &= self.sources[x]
                    if not common:
                        break
                self.common[r] = common
            else:
                self.levels &= ~(1 << r)
        at = self.capacity - self.left[b]
        self.left[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        r = self.left[b]
        if r:
            own = self.level[r]
            self.common[r] = self.common[r] & self.sources[b] if own else self.sources[b]
            insort(own, b)
            self.levels |= 1 << r
        return b, at


def pack_group(size: list[int], source: list, cluster: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(row, first word, words, bin, offset) of every piece; rows without words have none."""
    out, bins, rest = [], 0, []
    for i, n in enumerate(size):
        at = 0
        while n - at >= capacity:
            out.append((i, at, capacity, bins, 0))
            bins, at = bins + 1, at + capacity
        if n > at:
            rest.append((i, at, n - at))
    bit: dict = {}
    sources = [1 << bit.setdefault(s, len(bit)) for s in source]
    seen: dict = {}
    for c in cluster:
        seen[c] = seen.get(c, 0) + 1
    many: dict = {}
    clusters = [1 << many.setdefault(c, len(many)) if seen[c] > 1 else 0 for c in cluster]
    state = Bins(capacity)
    for i, at, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        b, offset = state.put(n, sources[i], clusters[i])
        out.append((i, at, n, bins + b, offset))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster_col: str | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, bin, offset) of every piece of every row of docs.

    Sizes count words between ASCII spaces. The duplicate cluster is cluster_col, or that of
    texts equal but for case and spaces; null sources are a source of their own. The full
    sequences of a long document hold nothing else. Null, empty and wordless texts have one
    row with 0 words and a null bin. Repeated rows are dealt to groups one by one, so that no
    group gathers them, and conflict inside one as copies do. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cluster = F.col(cluster_col) if cluster_col else F.translate(F.lower(text), " \t\n\r\x0b\x0c", "")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n"), F.xxhash64(cluster).alias("cluster"), F.xxhash64("doc_id", "text").alias("row"))
    groups = max(1, -(-docs.count() // group))
    rows = rows.groupBy("doc_id", "source", "n", "cluster", "row").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).withColumn("part", F.pmod(F.xxhash64("row", "copy"), F.lit(groups)))
    n = max(1, min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.select("part", "doc_id", "source", "n", "cluster", "row", "copy").repartition(n, "part").sortWithinPartitions("part", "doc_id", "row", "copy")
    long = T.LongType()
    schema = T.StructType([docs.select("doc_id").schema["doc_id"], *(T.StructField(c, long) for c in ("first_word", "n_words", "bin", "offset"))])

    def done(part, held):
        columns = [pa.concat_arrays(x) for x in zip(*held)]
        size = columns[2].to_pylist()
        pieces = pack_group(size, columns[1].to_pylist(), columns[3].to_pylist(), capacity)
        got = np.array(pieces, np.int64).reshape(-1, 5)
        empty = np.array([i for i, n in enumerate(size) if not n], np.int64)
        at = pa.array(np.concatenate([got[:, 0], empty]))
        zero, none = np.zeros(len(empty), np.int64), np.r_[np.zeros(len(got), bool), np.ones(len(empty), bool)]
        bins = np.concatenate([got[:, 3] + (part << 32), zero])
        yield pa.RecordBatch.from_arrays([columns[0].take(at), pa.array(np.concatenate([got[:, 1], zero])), pa.array(np.concatenate([got[:, 2], zero])), pa.array(bins, mask=none), pa.array(np.concatenate([got[:, 4], zero]), mask=none)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if part is not None and parts[x] != part:
                    yield from done(part, held)
                    held = []
                part = int(parts[x])
                held.append([batch.column(c).slice(x, y - x) for c in ("doc_id", "source", "n", "cluster")])
        if held:
            yield from done(part, held)

    return rows.mapInArrow(run, schema)
