"""Compressing vectors to product codes by delta-maintained Lloyd.

Vectors become integers and are cut into equal parts; each part position has a codebook. A round
assigns every part to the nearest entry and writes the assignments beside the ones of the round
before. The codebooks' sums and counts are kept as running integers: only a part whose
assignment changed contributes, plus to its new entry and minus to its old one. A task adds up
its contributions before they are shuffled, and what reaches the driver is as large as the
codebooks. Integer sums have no order, so that any partitioning gives the same codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this after scaling (65,536 before), so that no distance leaves 64 bits.
LIMIT = 1 << 26
#: Distances computed at once: rows times entries.
AT_ONCE = 1 << 21


def usable(vector: Column) -> Column:
    """Not null, and neither are its components, which are finite as well."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    whole = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x))).cast("int")
    return F.transform(vector.cast("array<double>"), whole)


class Codebooks:
    """Entries of every part position, int64, and how many vectors are cut to fit them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # part, entry, component
        self.parts, self.n, self.width = entries.shape

    @classmethod
    def initial(cls, first: list[list[int]], size: int, parts: int = PARTS) -> Codebooks:
        width = -(-size // parts)
        rows = np.zeros((len(first), parts * width), np.int64)
        for i, v in enumerate(first):
            rows[i, : len(v)] = v
        return cls(rows.reshape(len(first), parts, width).transpose(1, 0, 2).copy())

    def matrix(self, vectors: pa.ListArray) -> np.ndarray:
        """rows, part, component; shorter vectors are filled up with zeros."""
        flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
        out = np.zeros((len(vectors), self.parts * self.width), np.int64)
        out[np.repeat(np.arange(len(at)), at), np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
        return out.reshape(len(vectors), self.parts, self.width)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part, the lower of equals, and the squared distances summed over the parts.

        Products of numbers below 2**53 are exact as doubles; larger ones are computed as integers.
        """
        code, error = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
        biggest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = np.float64 if biggest * biggest * 4 * max(1, self.width) < 1 << 53 else np.int64
        for p in range(self.parts):
            book = self.entries[p].astype(exact)
            norms = (book * book).sum(axis=1)
            for a in range(0, len(x), step := max(1, AT_ONCE // max(1, self.n))):
                v = x[a : a + step, p].astype(exact)
                far = norms - 2 * (v @ book.T)
                best = far.argmin(axis=1)
                code[a : a + step, p] = best
                error[a : a + step] += (far[np.arange(len(v)), best] + (v * v).sum(axis=1)).astype(np.int64)
        return code, error

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry at the floored mean of its parts; unused ones stay."""
        return Codebooks(np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows with code, the one before as old, and the error; none before is an empty list."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = [c for c in rows.columns if c not in ("code", "old", "error")]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("old", T.ArrayType(T.ShortType())), T.StructField("code", T.ArrayType(T.ShortType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            code, error = own.nearest(own.matrix(batch.column("v")))
            flat = pa.array(code.astype(np.int16).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, own.parts, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("code"), listed, pa.array(error)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _contributions(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(at, delta): what parts whose assignment changed add to the running sums and counts, summed a task. at is a place in the sums, and the counts follow after them."""
    shape = books.entries.shape
    empty = Codebooks(np.zeros(shape, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            x = empty.matrix(batch.column("v"))
            new = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            had = np.diff(batch.column("old").offsets.to_numpy()) > 0
            old = np.full(new.shape, -1, np.int64)
            old[had] = batch.column("old").flatten().to_numpy(zero_copy_only=False).reshape(-1, new.shape[1])
            for p in range(shape[0]):
                changed = new[:, p] != old[:, p]
                for entry, which, sign in ((new, changed, 1), (old, changed & (old[:, p] >= 0), -1)):
                    np.add.at(sums[p], entry[which, p], sign * x[which, p])
                    np.add.at(counts[p], entry[which, p], sign)
        every = np.concatenate([sums.ravel(), counts.ravel()])
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["at", "delta"])

    changed = rows.where(F.col("old") != F.col("code")).select("v", "old", "code")
    return changed.mapInArrow(run, "at long, delta long").groupBy("at").agg(F.sum("delta").alias("delta"))


def fit(vectors: DataFrame, steps: Steps, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, list[int]]:
    """Assigned rows, the codebooks, and how many rows changed in each round. vectors is (id, v, ...), v array<int>; the codebooks are those of the smallest ids first."""
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    first = [list(r[0]) for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]  # entries rows
    books = Codebooks.initial(first, size, parts)
    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    rows, changes, before = vectors.withColumn("code", F.array().cast("array<smallint>")), [], None
    for turn in range(rounds + 1):
        rows = steps.written(_assigned(rows, books), "codes")
        if before is not None:
            steps.drop(before)
        before = rows
        if turn == rounds:
            break
        changes.append(rows.where(F.col("old") != F.col("code")).count())
        delta = np.zeros(sums.size + counts.size, np.int64)
        for at, d in _contributions(rows, books).collect():  # as many as the codebooks have numbers, at most
            delta[at] = d
        sums += delta[: sums.size].reshape(sums.shape)
        counts += delta[sums.size :].reshape(counts.shape)
        books = books.moved(sums, counts)
    return rows, books, changes


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector is usable.

    Rows with a null vector, or null or non-finite components in it, are left out. Vectors of
    several lengths are filled up with zeros to the longest one's, and that to a multiple of
    parts. Components beyond 65,536 count as that. Null ids are kept and come last; of repeated
    ids, the smaller vector is first, and repeated rows are rows of their own. Fewer rows than
    entries give as many entries; an empty table gives no rows. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    with Steps(embeddings.sparkSession) as steps:
        vector = F.col(vector_col)
        vectors = steps.written(embeddings.where(usable(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector).alias("v")), "vectors")
        rows, books, _ = fit(vectors, steps, parts, entries, rounds)
        by_label = steps.written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
        hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
        out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
        return stash(out, "codes")
