"""Line dedup by pairwise alignment.

A line is a stretch of words up to a line break or a sentence's end (ASCII case and spaces do not
count). One of over WHOLE words is broken further, after the word of the least hash of every
NEAR neighbouring words, so that what a passage inside it is broken into depends on the passage
but for its outermost words.

Documents that overlap are found by what is rare: from every line on, the fewest following lines
that hold LEAST words are hashed together, and so are the last lines of a text that do. For each
hash that several documents hold, every later document is linked to the earliest holder, a star
and not all pairs: a frequent hash costs a link a holder, so none has to be left out.

Linked documents are aligned line by line by patience diff: equal lines at either end of a
range, then lines that are single in it on both sides, of which the longest chain that rises in
both splits the range into gaps that are aligned in the same way. Aligned lines that follow one
another on both sides are a common block. What is deleted from the later document is

* every aligned block of BLOCK words or more,
* and, off the alignment, stretches of LEAST words that the other document holds elsewhere:
  blocks that moved.

A passage of 51 words is always hit, wherever it stands: of its lines but the outermost 13 words
at either end are the same, and that leaves 25. An aligned line of BLOCK words goes only between
documents that share such a stretch; elsewhere a short line says little, and stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, small_batches
from .common import Steps, fresh, stash
from .shingles import SPACED, mix, powers, spans_and_sums

#: Words of a stretch by which documents are linked, and of a block that moved, at least.
LEAST = 25
#: Words of an aligned block that is deleted, at least.
BLOCK = 8
#: Words of a line that is not broken, at most, and the neighbours of which one ends a piece of a longer one.
WHOLE, NEAR = 14, 7
#: A later document with this share of its words deleted, and nowhere LEAST words left together, is a copy and goes as a whole.
COPY = 0.8
#: Hashes with their holders that are broadcast at most: 200,000 are some 10 MB.
BROADCAST_HASHES = 200_000
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Lines:
    """The lines of some texts: first word, word after the last, and text of each."""

    def __init__(self, raw: list[bytes]):
        self.start, end, total, inverse, owner = spans_and_sums(raw, SPACED)
        self.texts, self.raw = len(raw), raw
        self.count = np.bincount(owner, minlength=len(raw))
        self.before = np.cumsum(self.count) - self.count  # words of earlier texts
        if len(self.start) == 0:
            self.first = self.end = self.owner = np.empty(0, np.int64)
            return
        buffer = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self.word = mix((total[end] - total[self.start]) * inverse[self.start])
        last = _STOP[buffer[end - 1]] | np.r_[owner[1:] != owner[:-1], True]
        before = np.searchsorted(self.start, np.flatnonzero((buffer == 10) | (buffer == 13))) - 1
        last[before[before >= 0]] = True  # the word before a line break
        close = np.flatnonzero(last)
        size = np.diff(np.r_[-1, close])
        line = np.repeat(np.arange(len(close)), size)
        if len(self.word) >= NEAR:
            near = np.lib.stride_tricks.sliding_window_view(self.word, NEAR)
            inside = np.flatnonzero((line[: len(near)] == line[NEAR - 1 :]) & (size[line[: len(near)]] > WHOLE))
            last[inside + near[inside].argmin(axis=1)] = True
        self.end = np.flatnonzero(last) + 1
        self.first = np.r_[0, self.end[:-1]]
        power, self.inverse = powers(len(self.word) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * power[: len(self.word)], dtype=np.uint64)])
        self.owner = owner[self.first]

    def _hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words begin to end, as signed numbers, never 0."""
        h = mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)).view(np.int64)
        return np.where(h == 0, 1, h)

    def index(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line: hash, words, and hash of the stretch that begins with it, 0 if none does; of each text: how many lines, and the hash of its last stretch."""
        n, last = np.zeros(self.texts, np.int64), np.zeros(self.texts, np.int64)
        if len(self.first) == 0:
            return *(np.zeros(0, np.int64) for _ in range(3)), n, last
        n += np.bincount(self.owner, minlength=self.texts)
        close = np.minimum(np.searchsorted(self.end, self.first + least), len(self.end) - 1)
        fits = (self.end[close] - self.first >= least) & (self.owner[close] == self.owner)
        stretch = np.zeros(len(self.first), np.int64)
        stretch[fits] = self._hash(self.first[fits], self.end[close][fits])
        full = np.flatnonzero(self.count >= least)
        done = self.before[full] + self.count[full]
        last[full] = self._hash(self.first[np.searchsorted(self.first, done - least, side="right") - 1], done)
        return self._hash(self.first, self.end), self.end - self.first, stretch, n, last


def word_starts(text: bytes) -> np.ndarray:
    """Where each word begins."""
    inside = SPACED[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(inside & ~np.r_[False, inside[:-1]])


def without(text: bytes, start: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """A text without some spans of words and the spaces after them; start: where each word begins."""
    at, out, done = [*start.tolist(), len(text)], [], 0
    for a, b in spans:
        out.append(text[done : at[a]])
        done = at[b]
    return b"".join([*out, text[done:]])


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    order = np.argsort(begin, kind="stable")
    begin, far = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > far[:-1]]
    return begin[new], far[np.r_[np.flatnonzero(new)[1:] - 1, len(far) - 1]]


# -- alignment ------------------------------------------------------------------------------


def increasing(b: list[int], a: list[int]) -> list[int]:
    """Indices of a longest chain with both b (given in order) and a strictly rising."""
    tails, tail_at, back = [], [], [-1] * len(b)
    i = 0
    while i < len(b):
        j = i
        while j < len(b) and b[j] == b[i]:
            j += 1
        for k in sorted(range(i, j), key=lambda k: -a[k]):  # of equal b, one at most
            p = bisect_left(tails, a[k])
            back[k] = tail_at[p - 1] if p else -1
            if p == len(tails):
                tails.append(a[k])
                tail_at.append(k)
            else:
                tails[p], tail_at[p] = a[k], k
        i = j
    out, k = [], tail_at[-1] if tail_at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(b: list[int], a: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of equal lines that align, rising in both."""
    out, ranges = [], [(0, len(b), 0, len(a))]
    while ranges:
        b0, b1, a0, a1 = ranges.pop()
        while b0 < b1 and a0 < a1 and b[b0] == a[a0]:
            out.append((b0, a0))
            b0, a0 = b0 + 1, a0 + 1
        while b0 < b1 and a0 < a1 and b[b1 - 1] == a[a1 - 1]:
            b1, a1 = b1 - 1, a1 - 1
            out.append((b1, a1))
        if b0 == b1 or a0 == a1:
            continue
        often, other = Counter(b[b0:b1]), Counter(a[a0:a1])
        at = {h: j for j, h in enumerate(a[a0:a1], a0) if other[h] == 1}
        lone = [(i, at[h]) for i, h in enumerate(b[b0:b1], b0) if often[h] == 1 and h in at]
        chain = [lone[k] for k in increasing([i for i, _ in lone], [j for _, j in lone])]
        for (i, j), (k, m) in zip([(b0 - 1, a0 - 1), *chain], [*chain, (b1, a1)]):
            if chain and k - i > 1 and m - j > 1:
                ranges.append((i + 1, k, j + 1, m))
        out += chain
    return sorted(out)


def common(b: np.ndarray, a: np.ndarray, size: np.ndarray, b_shared: np.ndarray, a_shared: np.ndarray, stretches: np.ndarray, least: int = LEAST, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Spans of words of b to delete, first word and the one after the last, and how many of its stretches moved.

    b and a are lines; size the words of b's. b_shared and a_shared tell the lines that both hold,
    stretches those of b's that a holds. Only shared lines are aligned; whether they follow one
    another is asked of all lines.
    """
    at, done = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    own, other = np.flatnonzero(b_shared), np.flatnonzero(a_shared)
    gone, parts = np.zeros(len(b), bool), []
    found = patience(b[own].tolist(), a[other].tolist())
    if found:
        pairs = np.array(found)
        i, j = own[pairs[:, 0]], other[pairs[:, 1]]
        new = np.flatnonzero((i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)) + 1
        first, last = i[np.concatenate([[0], new])], i[np.concatenate([new, [len(i)]]) - 1]
        large = at[last + 1] - at[first] >= block
        first, last = first[large], last[large]
        for x, y in zip(first.tolist(), last.tolist()):
            gone[x : y + 1] = True
        parts.append((at[first], at[last + 1]))
    k = np.flatnonzero(stretches)
    close = np.searchsorted(at, at[np.minimum(k, len(b))] + least)  # the fewest lines from each on that hold least words
    if len(k) and k[-1] == len(b):  # the last lines that do
        k[-1], close[-1] = np.searchsorted(at, at[-1] - least, side="right") - 1, len(b)
    np.cumsum(gone, out=done[1:])
    off = done[close] - done[k] < close - k
    parts.append((at[k[off]], at[close[off]]))
    starts, ends = (np.concatenate(x) for x in zip(*parts))
    return (*united(starts, ends), int(off.sum())) if len(starts) else (starts, ends, 0)


class Ragged:
    """A list column: all values end to end, where each row's begin, and a key that is equal only for equal values of one row."""

    def __init__(self, column: pa.ListArray):
        self.values = column.flatten().to_numpy()
        self.start = column.offsets.to_numpy() - column.offsets[0].as_py()  # a slice of a batch need not begin at 0
        row = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(self.start))
        self.key = mix(row + np.uint64(1)) + self.values.astype(np.int64).view(np.uint64)

    def of(self, values: np.ndarray, k: int) -> np.ndarray:
        return values[self.start[k] : self.start[k + 1]]


def common_of_all(batch: pa.RecordBatch, least: int = LEAST, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """common() of every row; what rows share is looked up for all of them at once."""
    b, size, b_stretch, a, a_stretch = (Ragged(batch.column(c)) for c in ("lines", "sizes", "stretches", "a_lines", "a_stretches"))
    there = lambda x, y: pd.Series(x.key).isin(y.key).to_numpy()
    b_shared, a_shared = there(b, a), there(a, b)
    held = there(b_stretch, a_stretch) & (b_stretch.values != 0)
    return [common(b.of(b.values, k), a.of(a.values, k), size.of(size.values, k), b.of(b_shared, k), a.of(a_shared, k), b_stretch.of(held, k), least, block) for k in range(batch.num_rows)]


# -- on tables ------------------------------------------------------------------------------


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """The order of documents, null ids last, and a hash of id and text: the row that a span refers to."""
    kind = docs.schema["doc_id"].dataType
    whole = isinstance(kind, T.IntegralType)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit("\U0010ffff"))
    return order, F.xxhash64("doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    order, row = _identity(docs)
    return docs.select(order.alias("ord"), row.alias("row"), F.col("text").alias("text"))


def index_table(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(ord, row, lines, sizes, stretches) of every text: hash and words of each line, and the hash of the stretch from it on, 0 if there is none; one more stretch is the text's last."""
    keyed = _keyed(docs)
    long = T.ArrayType(T.LongType())
    schema = T.StructType([keyed.schema["ord"], T.StructField("row", T.LongType()), T.StructField("lines", long), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("stretches", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            line, size, stretch, n, last = Lines([(t or "").encode() for t in batch.column("text").to_pylist()]).index(least)
            ends = np.cumsum(n)
            listed = lambda values, stops: pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("row"), listed(line, ends), listed(size.astype(np.int32), ends), listed(np.insert(stretch, ends, last), ends + np.arange(1, len(n) + 1))], names=schema.names)

    small_batches(docs.sparkSession)
    return keyed.mapInArrow(run, schema)


def deletions(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(row, ord, starts, ends, moved): spans of words to delete from later documents, each held by an earlier one, and how many stretches stand off the alignment.

    An earlier document may lose a block itself, to one before it, so every word stays with
    the earliest document that holds it. Spans may overlap.
    """
    with Steps(docs.sparkSession) as steps:
        index = steps.written(index_table(docs, least), "index", plain=True)
        each = index.select("ord", "row", F.explode("stretches").alias("h")).where("h <> 0")
        holders = each.groupBy("h").agg(F.min("ord").alias("first"), F.max("ord").alias("final")).where("first < final").select(F.col("h").alias("sh"), "first")
        met = each.join(_small(steps.written(holders, "holders", plain=True)), F.col("h") == F.col("sh"))
        linked = steps.written(met.where("ord > first").select("row", "ord", "first").distinct(), "linked")
        # Which row of the earlier document holds it: the only one of that id, or else the least row that has the hash.
        of_id = steps.written(index.groupBy(F.col("ord").alias("of")).agg(F.min("row").alias("held"), F.max("row").alias("last")), "ids")
        pairs = linked.join(of_id.where("held = last").select("of", "held"), F.col("first") == F.col("of")).select("row", "ord", "first", "held")
        if not (several := of_id.where("held < last").select("of")).isEmpty():
            shared = steps.written(met.join(several, F.col("first") == F.col("of")).select("h", "row", "ord", "first"), "shared")
            places = shared.where("ord = first").groupBy("h").agg(F.min("row").alias("held")).select(F.col("h").alias("sh"), "held")
            more = shared.where("ord > first").join(_small(steps.written(places, "places")), F.col("h") == F.col("sh"))
            pairs = pairs.unionByName(more.select("row", "ord", "first", "held").distinct())
        pairs = steps.written(pairs, "pairs")
        # Rows that are repeated with their id are one holder, and have their spans once.
        later = index.join(_small(pairs), ["row", "ord"])
        other = index.select(F.col("ord").alias("first"), F.col("row").alias("held"), F.col("lines").alias("a_lines"), F.col("stretches").alias("a_stretches"))
        earlier = other.join(_small(pairs.select("first", "held").distinct()), ["first", "held"], "left_semi").dropDuplicates(["first", "held"])
        both = later.join(steps.written(earlier, "earlier"), ["first", "held"])
        found = _aligned(both, least, block).groupBy("row", "ord").agg(F.collect_set(F.struct("first", "held", "starts", "ends", "moved")).alias("each"))  # as many as documents that it is linked to
        every = lambda c: F.flatten(F.col(f"each.{c}")).alias(c)
        return stash(found.select("row", "ord", every("starts"), every("ends"), F.aggregate("each.moved", F.lit(0), lambda n, m: n + m).alias("moved")), "spans")


def _small(df: DataFrame) -> DataFrame:
    """df for a broadcast if it is small. If not, both sides of a join with it shuffle, so that adaptive execution can split a hash that very many documents share."""
    return F.broadcast(df) if df.count() <= BROADCAST_HASHES else df


def _aligned(both: DataFrame, least: int, block: int) -> DataFrame:
    """(row, ord, first, held, starts, ends, moved) of every pair of linked documents."""
    spans, names = T.ArrayType(T.IntegerType()), ["row", "ord", "first", "held"]
    schema = T.StructType([*(both.schema[c] for c in names), T.StructField("starts", spans), T.StructField("ends", spans), T.StructField("moved", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = common_of_all(batch, least, block)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=schema.names)

    return both.select(*names, "lines", "sizes", "stretches", "a_lines", "a_stretches").mapInArrow(run, schema)


def _joined(docs: DataFrame, least: int, block: int) -> tuple[DataFrame, list[str]]:
    """docs with the spans to delete, and the names of their columns: starts, ends, moved."""
    row_name, ord_name, *names = fresh(docs, "row", "ord", "starts", "ends", "moved")
    gone = deletions(docs, least, block).toDF(row_name, ord_name, *names)
    order, row = _identity(docs)
    return docs.join(gone, (row == F.col(row_name)) & (order == F.col(ord_name)), "left").drop(row_name, ord_name), names


class Cut:
    """A text without some spans of its words; how many words it had and lost, and whether it is a copy."""

    def __init__(self, text: str | None, starts: list[int] | None, ends: list[int] | None, least: int = LEAST, copy: float = COPY):
        raw = (text or "").encode()
        if not starts:
            self.text, self.words, self.blocks, self.gone, self.copy = text, len(raw.split()), 0, 0, False
            return
        starts, ends = (x.tolist() for x in united(np.array(starts), np.array(ends)))
        at = word_starts(raw)
        self.text, self.words = without(raw, at, list(zip(starts, ends))).decode(), len(at)
        self.blocks, self.gone = len(starts), sum(ends) - sum(starts)
        left = [b - a for a, b in zip([0, *ends], [*starts, self.words])]
        self.copy = self.gone >= copy * self.words and max(left) < least


def dedup_lines(docs: DataFrame, least: int = LEAST, block: int = BLOCK, copy: float = COPY) -> DataFrame:
    """docs with common blocks deleted from later documents; documents that are nothing but copies go.

    A copy has lost four fifths of its words and has nowhere least words left together: what
    goes with it are scraps, never a passage. Every column stays as it is but text; n_chars,
    where docs has it, follows the new text. Documents are ordered by doc_id, as strings if
    it is one, null ids last; rows that share an id, or have none, count as one document,
    between which nothing is deleted. Null and empty texts, and those of fewer than least
    words, stay; repeated rows are each cut alike. Other columns may have any names, but none
    may be repeated.
    """
    names = list(docs.columns)
    joined, (starts, ends, _) = _joined(docs, least, block)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    at = {c: i for i, c in enumerate(names)}
    # Columns go by number through Python: a name may hold a dot.
    both = joined.where(F.col(starts).isNotNull()).select(*(F.col(f"`{c}`") for c in names), starts, ends).toDF(*schema.names, "starts", "ends")
    text, n_chars = at["text"], at.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{text}"):
            cuts = [Cut(*x, least, copy) for x in zip(*(batch.column(c).to_pylist() for c in (f"c{text}", "starts", "ends")))]
            kept = batch.take(pa.array([i for i, c in enumerate(cuts) if not c.copy], pa.int64()))
            new = [c.text for c in cuts if not c.copy]
            columns = [kept.column(c) for c in schema.names]
            columns[text] = pa.array(new, pa.string())
            if n_chars is not None:
                columns[n_chars] = pa.array([len(t) for t in new]).cast(columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    untouched = joined.where(F.col(starts).isNull()).select(*(F.col(f"`{c}`") for c in names))
    return untouched.union(both.mapInArrow(run, schema).toDF(*names))


def line_report(docs: DataFrame, least: int = LEAST, block: int = BLOCK, copy: float = COPY) -> DataFrame:
    """One row per row of docs: its words, blocks and words deleted, stretches that moved, whether it is a copy, and the cleaned text's length and hash.

    The rules are dedup_lines()'s. A null or empty text has no words and the hash of an empty one;
    repeated rows and null ids keep a row each; an empty table gives none.
    """
    joined, (starts, ends, moved) = _joined(docs.select("doc_id", "text"), least, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches):
            out = []
            for d, t, s, e, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", starts, ends, moved))):
                cut = Cut(t, s, e, least, copy)
                clean = cut.text or ""
                out.append((d, cut.words, cut.blocks, cut.gone, m or 0, cut.copy, len(clean), hashlib.sha256(clean.encode()).hexdigest()))
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=schema.names)

    long = T.LongType()
    kinds = {"n_words": long, "blocks_cut": long, "words_cut": long, "stretches_moved": long, "is_copy": T.BooleanType(), "clean_chars": long, "clean_sha256": T.StringType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in kinds.items())])
    return joined.select("doc_id", "text", starts, ends, moved).mapInArrow(run, schema)
