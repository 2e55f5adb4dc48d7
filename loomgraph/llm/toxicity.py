"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding beside the sum of embeddings of its leading and trailing
characters. The network reads every overlapping window of WINDOW words, in both directions, and
pools its states by attention to one logit. A logistic layer turns the logits of all of a
document's windows (the two highest, the mean, their number) into its score.

Only labelled rows train it: at most SAMPLE of each label, the least by a hash of the id, and of
each at most SAMPLE_WINDOWS windows, drawn on the executors: SAMPLE * SAMPLE_WINDOWS * 2 windows
of WINDOW words, 16 bytes each, are what reaches the driver at most, whatever the texts. The network is trained on windows that bear their
document's label, then on those that it itself rates highest; the logistic layer is fitted on
sampled documents that the network has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import release, slices, small_batches, texts
from .common import fresh
from .shingles import LETTERS, mix, spans_and_sums

WINDOW, STRIDE = 48, 24
SAMPLE, SAMPLE_WINDOWS = 1500, 40
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 14, 8, 8, 8, 8
#: Lengths in bytes of the leading and trailing pieces of a word. Chosen by rule, among (3, 4), (2 to 5) and (3 to 8), with
#: (), (4) and (3, 4): the least log loss, averaged over two tables, on a fifth (checksum 1) of the rows that may train.
LEADING, TRAILING = (2, 3, 4, 5), (4,)
SEED, FOLDS = 7, 5
#: Bytes of a text read at once; a longer one is read in parts that end between words, and its windows run on from part to part.
PIECE = 1 << 20
BLOCK = 1024
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


# -- inputs ---------------------------------------------------------------------------------


def word_inputs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of every word (the word, then its pieces), and the text each belongs to."""
    start, end, total, inverse, owner = spans_and_sums(raw, LETTERS)
    if len(start) == 0:
        return np.empty((0, 1 + len(LEADING) + len(TRAILING)), np.int32), owner
    size = end - start

    def piece(a, b, salt):
        h = mix((total[b] - total[a]) * inverse[a] + np.uint64(salt * 0x1FB21C651E98DF25))
        return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)

    columns = [piece(start, end, 1)]
    for k in LEADING:
        columns.append(np.where(size >= k, piece(start, np.minimum(start + k, end), 2), columns[0] * 0))
    for k in TRAILING:
        columns.append(np.where(size >= k, piece(np.maximum(end - k, start), end, 3), columns[0] * 0))
    return np.stack(columns, axis=1), owner


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; the last one of a text ends with it."""
    n = np.where(counts == 0, 0, np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(counts) - counts
    begin = np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return first[text] + begin, np.minimum(counts[text], WINDOW), text


# -- the network ----------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in a dict of float32 arrays: two tables, a cell for each direction, the pooling and the output."""

    def __init__(self, seed: int = SEED, params: dict[str, np.ndarray] | None = None):
        if params is not None:
            self.p = params
            return
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": g(BUCKETS, WORD_DIM, k=0.1), "char": g(BUCKETS, CHAR_DIM, k=0.1), "att": g(2 * h, ATTENTION, k=0.3), "att_v": g(ATTENTION, k=0.3), "out": g(2 * h, k=0.3), "out_b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": g(d, 3 * h, k=0.4), f"h{way}": g(h, 3 * h, k=0.3), f"b{way}": np.zeros(3 * h, np.float32)}

    def embed(self, ids: np.ndarray) -> np.ndarray:
        char = self.p["char"][ids[:, 1]]
        for k in range(2, ids.shape[1]):
            char += self.p["char"][ids[:, k]]
        return np.concatenate([self.p["word"][ids[:, 0]], char], axis=1)

    def logits(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """One logit per window; words are embedded and projected once, however many windows they are in."""
        x = self.embed(ids)
        xs = {way: x @ self.p[f"x{way}"] + self.p[f"b{way}"] for way in "fb"}
        out = np.empty(len(begin), np.float32)
        for a in range(0, len(begin), BLOCK):
            at, mask = _index(begin[a : a + BLOCK], size[a : a + BLOCK])
            states = np.concatenate([self._run(xs[way], at, mask, way)[0] for way in "fb"], axis=2)
            out[a : a + BLOCK] = self._pool(states, mask)[0]
        return out

    def _run(self, xs, at, mask, way, keep=False):
        """States (step, window, HIDDEN) of one direction."""
        steps, n = at.shape
        h, u, out, trace = np.zeros((n, HIDDEN), np.float32), self.p[f"h{way}"], np.empty((steps, n, HIDDEN), np.float32), []
        full = mask.all(axis=1)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            gx, gh = xs[at[t]], h @ u
            zr = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                trace.append((t, h, z, r, c, gh[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out, trace

    def _pool(self, states, mask):
        key = np.tanh(states @ self.p["att"])
        e = np.where(mask, key @ self.p["att_v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        return pooled @ self.p["out"] + self.p["out_b"][0], pooled, w, key

    def gradient(self, ids, begin, size, label, weight) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted log loss over windows, and its gradient by every parameter."""
        at, mask = _index(begin, size)
        x = self.embed(ids)
        runs = {way: self._run(x @ self.p[f"x{way}"] + self.p[f"b{way}"], at, mask, way, keep=True) for way in "fb"}
        states = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        logit, pooled, w, key = self._pool(states, mask)
        prob = _sigmoid(logit)
        total = weight.sum()
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / total)
        d = (weight * (prob - label) / total).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        d_pool = d[:, None] * self.p["out"]
        d_state = w[:, :, None] * d_pool
        d_w = np.einsum("nh,tnh->tn", d_pool, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_e, key)
        d_key = d_e[:, :, None] * self.p["att_v"] * (1 - key * key)
        g["att"] = np.einsum("tnh,tna->ha", states, d_key)
        d_state += d_key @ self.p["att"].T
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            g_states, u = d_state[:, :, i * HIDDEN : (i + 1) * HIDDEN], self.p[f"h{way}"]
            g_u, d_gx = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(begin), HIDDEN), np.float32)
            for t, h, z, r, c, ghc in reversed(runs[way][1]):
                d_new = (g_states[t] + carry) * mask[t][:, None]
                skip = (g_states[t] + carry) * ~mask[t][:, None]
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * ghc * r * (1 - r)
                d_gh = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g_u += h.T @ d_gh
                carry = d_new * z + d_gh @ u.T + skip
                _add_rows(d_gx, at[t], np.concatenate([d_z, d_r, d_c], axis=1), mask[t])
            g[f"h{way}"], g[f"b{way}"] = g_u, d_gx.sum(axis=0)
            g[f"x{way}"] = x.T @ d_gx
            d_x += d_gx @ self.p[f"x{way}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], ids[:, 0], d_x[:, :WORD_DIM])
        for k in range(1, ids.shape[1]):
            np.add.at(g["char"], ids[:, k], d_x[:, WORD_DIM:])
        return loss, g


def _index(begin, size):
    step = np.arange(int(size.max()) if len(size) else 0)[:, None]
    mask = step < size
    return begin + np.minimum(step, size - 1), mask


def _add_rows(target, at, rows, mask):
    """Windows of a training batch share no words: each has its own copy."""
    target[at[mask]] += rows[mask]


class Adam:
    def __init__(self, params, rate):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grad):
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        shrink = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grad.items():
            g = g * np.float32(shrink)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.p[k] -= np.float32(self.rate) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + np.float32(1e-7))


# -- training -------------------------------------------------------------------------------


def _gathered(ids, begin, size):
    """The words of some windows, each window with its own copy of them."""
    keep = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, size)])
    return ids[keep], np.cumsum(size) - size, size


def _fit(net, ids, begin, size, label, weight, epochs, rate, rng, batch=256):
    adam = Adam(net.p, rate)
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            own, b, s = _gathered(ids, begin[at], size[at])
            adam.step(net.gradient(own, b, s, label[at].astype(np.float32), weight[at].astype(np.float32))[1])


def document_features(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: its two highest window logits, their mean, the log of their number; zeros without windows."""
    out = np.zeros((n, 5))
    if len(text) == 0:
        return out
    order = np.lexsort((-logit, text))
    first = np.flatnonzero(np.r_[True, np.diff(text[order]) > 0])
    count = np.diff(np.r_[first, len(order)])
    who = text[order][first]
    top = logit[order][first]
    second = np.where(count > 1, logit[order][np.minimum(first + 1, len(order) - 1)], top)
    mean = np.add.reduceat(logit[order].astype(float), first) / count
    out[who] = np.stack([np.ones(len(who)), top, second, mean, np.log(count)], axis=1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    net: Network
    final: np.ndarray

    def scores(self, batch: list[str]) -> np.ndarray:
        raw = [t.encode() for t in batch]
        x = np.zeros((len(raw), 5))
        short = [i for i, b in enumerate(raw) if len(b) <= PIECE]
        ids, of = word_inputs([raw[i] for i in short])
        begin, size, text = windows_of(np.bincount(of, minlength=len(short)))
        x[short] = document_features(self.net.logits(ids, begin, size), text, len(short))
        for i in set(range(len(raw))) - set(short):
            logit = self._long_logits(raw[i])
            x[i] = document_features(logit, np.zeros(len(logit), np.int64), 1)[0]
        return np.where(x[:, 0] > 0, _sigmoid(x @ self.final), 0.0)

    def _long_logits(self, raw: bytes) -> np.ndarray:
        """Of the same windows as if the text were read at once."""
        out, ids, first, begin = [], word_inputs([b""])[0], 0, 0  # first: of the words held; begin: of the next window
        for part in _parts(raw):
            ids = np.concatenate([ids, word_inputs([part])[0]])
            at = np.arange(begin, first + len(ids) - WINDOW + 1, STRIDE)
            out.append(self.net.logits(ids, at - first, np.full(len(at), WINDOW)))
            begin += STRIDE * len(at)
            keep = max(first, min(begin, first + len(ids) - WINDOW))
            ids, first = ids[keep - first :], keep
        count = first + len(ids)
        if count and (not begin or begin - STRIDE + WINDOW < count):  # the last window ends with the text
            size = min(count, WINDOW)
            out.append(self.net.logits(ids, np.array([count - size - first]), np.array([size])))
        return np.concatenate(out)


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of PIECE bytes and the rest of the last word."""
    at = 0
    while at + PIECE < len(raw) and (gap := _BETWEEN.search(raw, at + PIECE)):
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:]


def sampled_windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of at most SAMPLE_WINDOWS windows of each text, each window with its own copy of them, chosen by the text alone; windows' sizes and texts."""
    ids, of = word_inputs(raw)
    begin, size, text = windows_of(np.bincount(of, minlength=len(raw)))
    counts = np.bincount(text, minlength=len(raw))
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    seed = np.array([zlib.crc32(b) for b in raw], np.uint64)
    order = np.lexsort((mix(place.astype(np.uint64) + (seed[text] << np.uint64(31))), text))
    rank = np.empty(len(text), np.int64)
    rank[order] = place
    keep = np.flatnonzero(rank < SAMPLE_WINDOWS)
    words = _gathered(ids, begin[keep], size[keep])[0] if len(keep) else ids[:0]
    return words.astype(np.uint16), size[keep], text[keep]


def _all_logits(net: Network, ids, begin, size) -> np.ndarray:
    """Of windows with their own copies of words, some at a time."""
    out = np.empty(len(begin), np.float32)
    for a in range(0, len(begin), 2 * BLOCK):
        b = min(a + 2 * BLOCK, len(begin))
        words = ids[begin[a] : begin[b - 1] + size[b - 1]]
        out[a:b] = net.logits(words, begin[a:b] - begin[a], size[a:b])
    return out


def train(given: list[str], label: np.ndarray, seed: int = SEED) -> Model | None:
    """None if there is but one label."""
    ids, size, text = sampled_windows([t.encode() for t in given])
    return train_on_windows(ids, size, text, np.asarray(label, int), seed)


def train_on_windows(ids: np.ndarray, size: np.ndarray, text: np.ndarray, label: np.ndarray, seed: int = SEED) -> Model | None:
    """train() on windows that have their own copies of words, by texts in rising order."""
    if len(set(label.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    begin, n = np.cumsum(size) - size, len(label)
    fold = rng.permutation(n) % 3  # 0: for the final layer
    own = fold[text] > 0
    y = label[text]
    net = Network(seed)

    def chosen(at):
        few = min((y[at] == 1).sum(), (y[at] == 0).sum())
        picks = [rng.permutation(at[y[at] == v])[: max(1, (3 - v) * few, 2000)] for v in (0, 1)]
        at = np.concatenate(picks)
        pos = max(1, (y[at] == 1).sum())
        return at, np.where(y[at] == 1, len(at) / (2 * pos), len(at) / (2 * max(1, len(at) - pos)))

    if not (own & (y == 1)).any() or not (own & (y == 0)).any():
        return None
    at, weight = chosen(np.flatnonzero(own))
    epochs = int(np.clip(60_000 // max(1, len(at)), 2, 20))
    _fit(net, ids, begin[at], size[at], y[at], weight, epochs, 0.01, rng)
    for _ in range(3):  # windows that the network rates highest, and others of clean documents
        logit = _all_logits(net, ids, begin, size)
        order = np.lexsort((-logit, text))
        place = np.empty(len(order), int)
        firsts = np.cumsum(np.bincount(text, minlength=n)) - np.bincount(text, minlength=n)
        place[order] = np.arange(len(order)) - firsts[text[order]]
        take = own & np.where(y == 1, place < 2, (place < 4) | (rng.random(len(y)) < 0.1))
        at = np.flatnonzero(take)
        pos = max(1, (y[at] == 1).sum())
        weight = np.where(y[at] == 1, len(at) / (2 * pos), len(at) / (2 * max(1, len(at) - pos)))
        _fit(net, ids, begin[at], size[at], y[at], weight, int(np.clip(20_000 // max(1, len(at)), 2, 12)), 0.004, rng)
    logit = _all_logits(net, ids, begin, size)
    x = document_features(logit, text, n)
    part = (fold == 0) & (x[:, 0] > 0)
    if len(set(label[part].tolist())) < 2:
        part = x[:, 0] > 0
    return Model(net, _logistic(x[part], label[part]))


# -- on tables ------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """A fifth of the ids, by checksum, whose labels nothing learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What train_on_windows takes, of at most per_label texts of each label outside the held-out fold; the same for the same tables."""
    known = labels.select(F.col("doc_id").alias("k"), F.col("toxic").alias("toxic")).where(F.col("k").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out("k")).groupBy("k").agg(F.max("toxic").alias("toxic"))
    taken = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("k"), "k").limit(per_label) for v in (0, 1)]
    few = F.broadcast(taken[0].unionByName(taken[1]))  # 2 x per_label rows at most
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(few, F.col("doc_id") == F.col("k")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, size, text = sampled_windows([t.encode() for t in texts(batch)])
            ends = np.searchsorted(text, np.arange(batch.num_rows), side="right")
            at = np.r_[0, np.cumsum(size)]
            cuts = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()))
            columns = [pa.array([words[at[x] : at[y]].tobytes() for x, y in cuts], pa.binary()), pa.array([size[x:y].astype(np.uint16).tobytes() for x, y in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "h")), *columns], names=["doc_id", "toxic", "h", "words", "sizes"])

    small_batches(docs.sparkSession)
    drawn = rows.select("doc_id", "toxic", F.xxhash64("text").alias("h"), "text").mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["toxic"], T.StructField("h", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "sizes"))]))
    # rows that share an id: one of them
    drawn = drawn.groupBy("doc_id").agg(F.min("h").alias("h"), F.min_by(F.struct("toxic", "words", "sizes"), "h").alias("r")).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label)
    got = drawn.toArrow()
    label = got.column("toxic").to_numpy().astype(int)
    sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in got.column("sizes").to_pylist()]
    words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in got.column("words")] or [np.empty(0, np.uint16)]).reshape(-1, 1 + len(LEADING) + len(TRAILING))
    return words, np.concatenate([*sizes, np.empty(0, np.int64)]), np.repeat(np.arange(len(sizes)), [len(x) for x in sizes]), label


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    try:
        return train_on_windows(*labelled_sample(docs, labels))
    finally:
        release()  # the driver is done with the sample


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and score, with a longer name if one of them has it. Without a model, for want of labels, every score is 0."""
    small_batches(docs.sparkSession)
    # Columns go by number through Python: a name may hold a dot.
    numbers = [f"c{i}" for i in range(len(keep))]
    text = numbers[keep.index("text")] if "text" in keep else "text"
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, numbers)), *([] if "text" in keep else [F.col("text").alias("text")]))
    schema = T.StructType([*(rows.schema[n] for n in numbers), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.net.p, model.final) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Network(params=shared.value[0]), shared.value[1]) if shared.value else None
        for batch in slices(batches, text, size=PIECE):
            s = own.scores(texts(batch, text)) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in numbers), pa.array(s)], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, fresh(docs, "score")[0])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, over all windows of whole texts.

    Scores depend on the text alone. Null, empty and wordless texts score 0. Labels that are
    null, double or of unknown documents do no harm: of double ones the larger holds, others
    are left out; with labels of one kind or none every score is 0. Null ids are not held
    out; repeated rows keep their rows.
    """
    scored = score(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """docs without those scored most or above; every column stays as it is, whatever its name.

    Null and wordless texts stay. Rows with equal texts have one score, so that repeated rows stay
    or go together; an empty table stays empty.
    """
    names = list(docs.columns)
    scored = score(docs, fit(docs, labels), names)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < most).select(*(F.col(f"`{c}`") for c in names))
