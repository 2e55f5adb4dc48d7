"""Token counts by rank-synchronous merging of ragged symbol arrays.

The distinct pre-tokens of a slice of texts lie end to end in one numpy array. Each round looks
up the rank of every adjacent pair, finds each sequence's lowest, merges all its occurrences in
all sequences at once, and retires the sequences with no pair left; the symbols that survive
are the tokens. Counts of short pre-tokens are remembered, up to a fixed number.

A sequence of over LONG symbols may need as many rounds as it has pairs, and each would read all of
it. There the places of each rank are kept in lists, and a round touches those of the lowest
rank and their neighbours: n symbols take n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, small_batches, texts

#: The vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, REMEMBERED_CHARS = 300_000, 40
LIMIT = 512
#: Symbols of a sequence that is merged among others in arrays, at most.
LONG = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Pairs of symbol ids, sorted, with their ranks and results. A few MB, whatever the input."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.base = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_key: dict[int, tuple[int, int]] | None = None  # for long pieces, when there is one

    @classmethod
    def read(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty piece."""
        out = np.zeros(len(pieces), np.int64)
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG] if long else range(len(pieces))
        if len(short):
            out[list(short)] = self.count_short([pieces[i] for i in short] if long else pieces)
        for i in long:
            out[i] = self.count_long(pieces[i])
        return out

    def count_long(self, piece: bytes) -> int:
        """Tokens of one piece: the lowest rank's pairs are merged from the left, and only pairs beside them are looked up anew."""
        if self.by_key is None:
            self.by_key = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.results.tolist())))
        sym = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, base, known = len(sym), self.base, self.by_key
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        places: dict[int, list[int]] = {}
        waiting: list[int] = []

        def put(i: int) -> None:
            if (hit := known.get(sym[i] * base + sym[after[i]])) is not None:
                if hit[0] not in places:
                    places[hit[0]] = []
                    heapq.heappush(waiting, hit[0])
                places[hit[0]].append(i)

        for i in range(n - 1):
            put(i)
        left = n
        while waiting:
            rank = heapq.heappop(waiting)
            for i in sorted(places.pop(rank)):
                j = after[i]
                if sym[i] < 0 or j < 0 or (hit := known.get(sym[i] * base + sym[j])) is None or hit[0] != rank:
                    continue  # merged meanwhile
                sym[i], sym[j], after[i] = hit[1], -1, after[j]
                left -= 1
                if after[i] >= 0:
                    before[after[i]] = i
                    put(i)
                if before[i] >= 0:
                    put(before[i])
        return left

    def count_short(self, pieces: list[bytes]) -> np.ndarray:
        none = np.iinfo(np.int32).max
        size = np.array([len(p) for p in pieces], np.int64)
        out = size.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        while len(sym) > 1:
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(found, self.ranks[at], none), none)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[first, len(seq)])
            low = np.minimum.reduceat(rank, first)
            pick = np.flatnonzero((rank == np.repeat(low, length)) & (rank < none))
            if len(pick) == 0:
                break
            # of occurrences that overlap, every other one, from the left
            run = np.r_[True, np.diff(pick) > 1]
            offset = np.arange(len(pick)) - np.maximum.accumulate(np.where(run, np.arange(len(pick)), 0))
            pick = pick[offset % 2 == 0]
            sym[pick] = self.results[at[pick]]
            np.subtract.at(out, seq[pick], 1)
            keep = np.repeat(low < none, length)
            keep[pick + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class Counter:
    def __init__(self, table: MergeTable):
        import regex

        self.table, self.known = table, {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in table.special)) if table.special else None

    def __call__(self, batch: list[str]) -> list[int]:
        out, cut = [0] * len(batch), []
        for i, t in enumerate(batch):
            parts = [t]
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
                out[i] += len(parts) - 1
            cut.append([p for part in parts for p in self.split(part)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list({p for pieces in cut for p in pieces if p not in self.known})
        counts = dict(zip(fresh, self.table.count([p.encode() for p in fresh]).tolist())) if fresh else {}
        self.known.update(x for x in counts.items() if len(x[0]) <= REMEMBERED_CHARS)
        for i, pieces in enumerate(cut):
            try:
                out[i] += sum(map(self.known.__getitem__, pieces))
            except KeyError:
                out[i] += sum(self.known[p] if p in self.known else counts[p] for p in pieces)
        return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, over whole texts.

    vocabulary is the path of a byte-level BPE file on the driver; its merge table, a few MB,
    is broadcast. Strings of special tokens in a text count one each, as in the library's
    default. A text takes time in proportion to its length, and to that times its logarithm where it
    is one word or run of marks. Null and empty texts have no tokens; null ids and repeated rows keep their rows;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable.read(vocabulary))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in slices(batches):
            n = np.array(counter(texts(batch)), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
