"""Document fingerprints by improved consistent weighted sampling.

A text is a bag of five-word shingles, weighted by how often each occurs. For every one of
SAMPLES draws a term has fixed variates r, c ~ Gamma(2, 1) and beta ~ U(0, 1); with weight w,
t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r, and the pair (term, t) of least
a is the sample. Two texts draw the same pair with a probability equal to their generalised
Jaccard similarity.

Variates are hashes of term and draw. With weight 1, a is exponential, and so falls with a uniform
hash, which alone orders the terms. Given that a, the other variates of a repeated term follow: c = a + a'
with a' exponential, r = -ln(a / c) - ln u, beta = -ln u / r have the distributions above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, small_batches, texts
from .common import long_array
from .shingles import mix, shingles

SHINGLE, SAMPLES, SEED = 5, 64, 20240501
#: Terms handled at once, so that the arrays of a draw stay in the processor's cache.
BLOCK = 1 << 15
#: Rows aimed at in a part of neighbouring documents, and the most parts; what a part holds is sorted on disk if need be.
GROUP_ROWS, MOST_PARTS = 4096, 20_000


#: Low bits of a repeated term's key that tell it and its t apart; those above hold its rank.
_LOW = np.uint64((1 << 20) - 1)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers inside (0, 1), in the same order."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Sampler:
    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.samples, self.shingle = samples, shingle
        self.salt, self.odd = (rng.integers(0, 1 << 63, samples, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))

    def __call__(self, batch: list[bytes]) -> np.ndarray:
        """Signatures, one row of uint16 per text; row of a text without words: zeros, see has_terms."""
        out = np.zeros((len(batch), self.samples), np.uint16)
        self.has_terms = np.zeros(len(batch), bool)
        term, owner = shingles(batch, self.shingle)
        if len(term) == 0:
            return out
        sizes = np.bincount(owner, minlength=len(batch))
        self.has_terms = sizes > 0
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(batch):
            a = ends[lo] - sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
            self._block(term[a : ends[hi - 1]], owner[a : ends[hi - 1]], out)
            lo = hi
        return out

    def _block(self, term: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        if len(term) == 0:
            return
        base = owner[0]
        order = np.argsort(term, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")] if owner[-1] != base else order
        term, owner = term[order], owner[order]
        new = np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]
        at = np.flatnonzero(new)
        weight = np.diff(np.r_[at, len(term)])
        term, owner = term[at], owner[at]
        heavy = np.flatnonzero(weight > 1)
        ln_w = np.log(weight[heavy])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for k in range(self.samples):
            key = (term ^ self.salt[k]) * self.odd[k]
            key ^= key >> np.uint64(32)
            key *= self.odd[k]
            if len(heavy):
                key[heavy] = self._heavy(key[heavy], ln_w)
            best = np.minimum.reduceat(key, first)
            out[owner[first], k] = (mix(best) >> np.uint64(48)).astype(np.uint16)

    @staticmethod
    def _heavy(key: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """The keys of repeated terms, from what they would be with weight 1."""
        once = -np.log1p(-_uniform(key))
        c = once - np.log(_uniform(mix(key + np.uint64(1))))
        rest = -np.log(_uniform(mix(key + np.uint64(2))))
        r = np.log(c / once) + rest
        beta = rest / r
        t = np.floor(ln_w / r + beta)
        a = c * np.exp(-r * (t - beta) - r)
        rank = np.minimum(-np.expm1(-a), 1 - 2.0**-52)
        new = ((rank * 2.0**64).astype(np.uint64) & ~_LOW) | (mix(key + mix(t.astype(np.uint64))) & _LOW)
        return np.where(t > 0, new, key)


def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray) -> np.ndarray:
    """The share of equal samples: an estimate of the similarity. Two texts without words are alike, one is like no other."""
    return np.where(a_has & b_has, (a == b).mean(axis=1), (a_has == b_has).astype(float))


def hexed(sig: np.ndarray, has: np.ndarray) -> list[str]:
    raw = sig.astype(">u2").tobytes().hex()
    n = sig.shape[1] * 4
    return [raw[i * n : i * n + n] if h else "" for i, h in enumerate(has)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: the general form, without the edited texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in slices(batches):
            sig = sampler([t.encode() for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexed(sig, sampler.has_terms), pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def next_in_order(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (part, last, doc_id, text) by descending doc_id: part numbers ranges of ids in that order.

    Each part also holds, as its row with last = 1, a copy of the first document of the part
    after it (of the first part, for the last one), so that every document meets the next one
    without a global sort in one task. Rows that share an id go by their texts' hash; null
    ids come last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n, lowest = rows.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    if not n:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("last"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("tie"), "*").limit(0)
    parts = min(MOST_PARTS, max(1, -(-n // group_rows)))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000 if parts < 1000 else 10 * parts).alias("q")).first().q or [])) if parts > 1 and lowest is not None else []
    part = F.lit(len(cuts))
    if cuts:
        ids = long_array(cuts)
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - _below(ids, len(cuts)))
    keyed = rows.select(part.cast("int").alias("part"), F.lit(0).alias("last"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "*")
    heads = keyed.groupBy("part").agg(F.max("doc_id").alias("head")).withColumnRenamed("part", "p")
    used = sorted(r[0] for r in heads.select("p").collect())
    before = [0] * (len(cuts) + 1)
    for p, q in zip(used, [used[-1], *used[:-1]]):
        before[p] = q
    to = F.get(long_array(before), F.col("part")).cast("int").alias("part")
    first = keyed.join(F.broadcast(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min_by(F.struct("no_id", "tie", "doc_id", "text"), F.col("tie")).alias("row"))
    sent = first.select(to, F.lit(1).alias("last"), "row.no_id", "row.tie", "row.doc_id", "row.text")
    return keyed.unionByName(sent)


def _below(ids, n: int):
    """How many of the sorted cuts are at most doc_id, by halving; an expression of one size, however many cuts there are."""

    def halved(pos, step):
        nxt = pos + step
        return F.when((nxt <= n) & (F.get(ids, nxt - 1) <= F.col("doc_id")), nxt).otherwise(pos)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length())))), F.lit(0), halved)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they have in common.

    The edited text has its last floor(n_chars / 2) code points replaced by as many from the
    start of the next document by descending doc_id (or all of it); after the last comes the
    first. Null texts are empty; a text without words has the empty fingerprint, alike only
    to another such; equal texts have equal fingerprints; rows that share an id are ordered
    by their texts' hash; a single document is its own next.
    """
    small_batches(docs.sparkSession)
    ordered = next_in_order(docs)
    n = max(ordered.sparkSession.sparkContext.defaultParallelism, int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = ordered.repartition(n, "part").sortWithinPartitions("part", "last", "no_id", F.col("doc_id").desc(), "tie").select("part", "last", "doc_id", "text")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(), None
        for batch in slices(batches):
            part, last, ids, text = batch.column("part").to_pylist(), batch.column("last").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch)
            sig = sampler([t.encode() for t in text])
            has = sampler.has_terms
            if held is not None:  # the row whose next one comes only now
                part, last, ids, text = [held[0], *part], [held[1], *last], [held[2], *ids], [held[3], *text]
                sig, has = np.vstack([held[4], sig]), np.r_[held[5], has]
            held = (part[-1], last[-1], ids[-1], text[-1], sig[-1:], has[-1:])
            own = [i for i in range(len(part) - 1) if not last[i]]
            if not own:
                continue
            edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in own]
            raw = [e.encode() for e in edited]
            e_sig = sampler(raw)
            e_has, at = sampler.has_terms, np.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(text[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
                    pa.array(hexed(sig[at], has[at]), pa.string()),
                    pa.array(hexed(e_sig, e_has), pa.string()),
                    pa.array(likeness(sig[at], has[at], e_sig, e_has)),
                    pa.array(likeness(sig[at], has[at], sig[at + 1], has[at + 1])),
                ],
                names=schema.names,
            )

    return sorted_rows.mapInArrow(run, schema)
