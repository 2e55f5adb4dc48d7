"""Importance resampling towards a target distribution, over hashed runs of words.

A feature is a run of one or two words, its bucket the CRC of its bytes modulo the number of
buckets. No run is ever put together: a word's CRC is computed once, byte position by byte
position for all words at once, and a run's follows from those of its parts. A CRC is linear
over GF(2), so crc(a + b) is crc(a), shifted by as many zero bytes as b has, plus crc(b). A
shift by 2 ** k bytes is a 32 x 32 matrix; it is applied as four tables of 256 entries, for
those words whose length has that bit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import with_index
from .arrow import slices, small_batches
from .common import Steps, fresh, stash
from .shingles import _LOWER, LETTERS

N_BUCKETS, RUN, LEAST_WORDS, DRAWN_PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Longer words are left to zlib, one by one: the loop over byte positions would have one word left.
LONG_WORD = 64
_ONES = np.uint32(0xFFFFFFFF)


# -- CRC algebra ----------------------------------------------------------------------------


@cache
def byte_table() -> np.ndarray:
    """What a byte does to an empty register: 256 numbers by the rule of the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


def _applied(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def _as_tables(matrix: np.ndarray) -> np.ndarray:
    """A matrix of 32 columns, as what each value of each byte of the argument adds."""
    value = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(value >> (bit % 8) & 1, matrix[bit], 0).astype(np.uint32)
    return out


@cache
def shift_tables(k: int) -> np.ndarray:
    """The shift by 2 ** k zero bytes: each matrix is the one before it, applied to itself."""
    if k == 0:
        unit = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        return _as_tables(byte_table()[unit & 255] ^ (unit >> np.uint32(8)))
    half = shift_tables(k - 1)
    unit = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    return _as_tables(_applied(half, _applied(half, unit)))


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC, moved past size[i] bytes."""
    out, k = crc.copy(), 0
    while len(size) and int(size.max()) >> k:
        at = np.flatnonzero(size >> k & 1)
        out[at] = _applied(shift_tables(k), out[at])
        k += 1
    return out


def followed_by_space(crc: np.ndarray) -> np.ndarray:
    c = crc ^ _ONES
    return byte_table()[(c ^ np.uint32(32)) & 255] ^ (c >> np.uint32(8)) ^ _ONES


def word_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC of raw[start[i]:end[i]] for every i."""
    size, table = end - start, byte_table()
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    long = int((size > LONG_WORD).sum())
    c = np.full(len(start), _ONES, np.uint32)
    s, rest = start[order][long:], size[order][long:]
    reg = np.full(len(s), _ONES, np.uint32)
    alive = np.searchsorted(-rest, -np.arange(LONG_WORD), side="left")  # words longer than k, k = 0, 1, ...
    for k in range(LONG_WORD):
        n = int(alive[k])
        if n == 0:
            break
        reg[:n] = table[(reg[:n] ^ raw[s[:n] + k]) & 255] ^ (reg[:n] >> np.uint32(8))
    c[order[long:]] = reg ^ _ONES
    for i in order[:long].tolist():
        c[i] = zlib.crc32(raw[start[i] : end[i]])
    return c


def features(texts: list[bytes], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and text of every run of one to run words, and the number of words of each text."""
    raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    within = np.concatenate([[False], LETTERS[raw], [False]])
    edge = np.flatnonzero(within[1:] != within[:-1])
    start, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    word, size = word_crcs(raw, start, end), end - start
    so_far, crcs, owners = word, [word], [owner]
    for k in range(1, run):
        left = so_far[: len(word) - k] if len(word) > k else so_far[:0]
        so_far = shifted(followed_by_space(left), size[k:]) ^ word[k:]
        same = owner[k:] == owner[: len(word) - k] if len(word) > k else np.zeros(0, bool)
        crcs.append(so_far[same])
        owners.append(owner[k:][same])
    return np.concatenate(crcs), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


# -- on tables ------------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, n_buckets: int = N_BUCKETS, run: int = RUN, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket; each task sums its own, n_buckets numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in slices(batches):
            crc, _, _ = features([(t or "").encode() for t in batch.column("text").to_pylist()], run)
            sums += np.bincount(crc % np.uint32(n_buckets), minlength=n_buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    out = np.zeros(n_buckets, np.int64)
    for b, n in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to every bucket on both sides."""
    n, s, t = len(of_docs), of_docs.astype(np.float64), of_target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(1000 times a Gumbel variate) that follows from seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row of docs: the floored mean gain of its features, 0 without any."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, n_buckets, run, text_col), bucket_counts(target, n_buckets, run, text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_features", "n_words", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gain.value
        for batch in slices(batches):
            crc, owner, words = features([(t or "").encode() for t in batch.column("text").to_pylist()], run)
            n = np.bincount(owner, minlength=batch.num_rows)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner, own[crc % np.uint32(n_buckets)])
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, words, weight))], names=names)

    return rows.mapInArrow(weigh, T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:])]))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: features, weight, score, and its rank among those drawn (from 1; else null).

    Of the rows with least_words words, percent in a hundred with the highest scores are drawn: a
    Gumbel variate added to a log weight draws without replacement by weight. Ties go to the
    smaller id, null ids first among equals. Null and empty texts have no features, weight 0, and
    are not drawn; repeated rows share score and neighbouring ranks; an empty table gives none,
    an empty target the same gain a bucket as one that holds nothing. Other columns are not read.
    """
    with Steps(docs.sparkSession) as steps:
        rows = steps.written(weighed(docs, target), "weights").withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
        enough = rows.where(F.col("n_words") >= least_words)
        drawn = enough.count() * percent // 100
        ranked = with_index(enough, F.col("score").desc(), F.col("doc_id"), "n_features", name="at")
        rank = F.when(F.col("at") < drawn, F.col("at") + 1).cast("long").alias("rank")
        few = rows.where(F.col("n_words") < least_words)
        every = ranked.select("doc_id", "n_features", "weight", "score", rank).unionByName(few.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
        return stash(every, "drawn")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """docs without the rows that are not drawn; columns and their names stay. Rows that share an id go together: all stay if one is drawn."""
    (name,) = fresh(docs, "drawn")
    ids = resampled(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
