"""What turns a node's context, a ragged sequence of vectors, into the tokens that a language model reads.

A projector's weights come as a table (read_weights). Sequences of several lengths lie end to end
in one matrix, so that each layer is one product a batch; means, softmaxes and sums over a
sequence are reductions between offsets. Pads are left out beforehand and count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neural import gelu

#: Tokens that a pooling projector makes of a sequence.
TOKENS = 5
#: Numbers of the vectors that are worked on at once.
AT_ONCE = 1 << 22
#: Kinds that pool, and how: evenly spaced means, one head, several heads.
POOLING = {"vicuna_2layer": "means", "vicuna_2layersh": "single", "vicuna_2layermh": "heads"}


def layers_of(kind: str) -> int:
    """Layers of a kind that does not pool: one for linear, N for N-layer-mlp."""
    if kind == "linear":
        return 1
    if m := re.fullmatch(r"(\d+)-layer-mlp", kind):
        return int(m[1])
    raise ValueError(f"no projector of kind {kind}")


def shapes(kind: str, size: int, hidden: int, heads: int = 8, tokens: int = TOKENS) -> dict[str, tuple[int, int]]:
    """Names and shapes of a projector's matrices."""
    n = 2 if kind in POOLING else layers_of(kind)
    out = {}
    for i in range(n):
        out |= {f"layer.{i}.weight": (hidden, size if i == 0 else hidden), f"layer.{i}.bias": (1, hidden)}
    if POOLING.get(kind) in ("single", "heads"):
        out |= {"queries": (tokens, hidden), "temperature": (1, 1)}
        if POOLING[kind] == "heads" and hidden % heads:
            raise ValueError(f"{hidden} does not divide into {heads} heads")
    return out


def _mlp(x: np.ndarray, w: dict[str, np.ndarray], n: int) -> np.ndarray:
    for i in range(n):
        x = (gelu(x) if i else x) @ w[f"layer.{i}.weight"].T + w[f"layer.{i}.bias"]
    return x


def _attended(x: np.ndarray, first: np.ndarray, count: np.ndarray, queries: np.ndarray, heads: int, temperature: float) -> np.ndarray:
    """Softmax-weighted sums of each sequence, one a query and head: (sequences, queries, size)."""
    n, size = x.shape
    split = x.reshape(n, heads, size // heads)
    q = queries.reshape(len(queries), heads, size // heads)
    score = np.einsum("nhd,qhd->nqh", split, q) / (np.sqrt(size // heads) * temperature)
    w = np.exp(score - np.repeat(np.maximum.reduceat(score, first, axis=0), count, axis=0))
    w /= np.repeat(np.add.reduceat(w, first, axis=0), count, axis=0)
    out = np.empty((len(first), len(queries), size))
    for k in range(len(queries)):  # a weighted copy of x at a time
        out[:, k] = np.add.reduceat((split * w[:, k, :, None]).reshape(n, size), first, axis=0)
    return out


def _means(x: np.ndarray, first: np.ndarray, count: np.ndarray, tokens: int) -> np.ndarray:
    """Means of stretches that cover a sequence: from floor(i n / tokens) to ceil((i + 1) n / tokens)."""
    k = np.arange(tokens)
    a = first[:, None] + k * count[:, None] // tokens
    b = first[:, None] - (-(k + 1) * count[:, None] // tokens)
    sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    return (sums[b] - sums[a]) / (b - a)[..., None]


def project(x: np.ndarray, count: np.ndarray, kind: str, w: dict[str, np.ndarray], heads: int = 8, tokens: int = TOKENS) -> np.ndarray:
    """Sequences of count vectors each, end to end in x: as many rows a sequence as it has vectors, or tokens rows if the kind pools."""
    if kind not in POOLING:
        return _mlp(x, w, layers_of(kind))
    first = np.cumsum(count) - count
    x = _mlp(x - np.repeat(np.add.reduceat(x, first, axis=0) / count[:, None], count, axis=0), w, 2)
    how = POOLING[kind]
    if how == "means":
        out = _means(x, first, count, tokens)
    else:
        out = _attended(x, first, count, w["queries"], heads if how == "heads" else 1, float(w["temperature"][0, 0]))
    return out.reshape(len(count) * tokens, -1)


def projected(vectors: DataFrame, kind: str, weights: dict[str, np.ndarray], by: str = "id", heads: int = 8, tokens: int = TOKENS) -> DataFrame:
    """(by, token, e) of (by, pos, e): each sequence, in order of pos, through a projector.

    Rows are sorted by sequence; a task works on as many sequences at once as hold AT_ONCE numbers,
    and on a longer one by itself. A position without a vector (null) is a pad and is left out.
    """
    size = weights["layer.0.weight"].shape[1]
    want = shapes(kind, size, len(weights["layer.0.weight"]), heads, len(weights.get("queries", np.zeros((tokens, 0)))))
    for name, shape in want.items():
        if name not in weights or weights[name].shape != shape:
            raise ValueError(f"{name} should be {shape}, and is {weights[name].shape if name in weights else 'missing'}")
    shared = vectors.sparkSession.sparkContext.broadcast(weights)  # a model's weights fit every task

    def out(keys: list, parts: list[np.ndarray]) -> pd.DataFrame:
        count = np.array([len(p) for p in parts])
        y = project(np.concatenate(parts), count, kind, shared.value, heads, tokens)
        rows = np.full(len(count), len(y) // len(count)) if kind in POOLING else count
        return pd.DataFrame({by: np.repeat(np.array(keys), rows), "token": np.concatenate([np.arange(r) for r in rows]), "e": list(y)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts, held, key, now = [], [], 0, None, []
        for pdf in batches:
            ids, e = pdf[by].to_numpy(), list(pdf.e)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:]):
                if key is not None and ids[a] != key:
                    keys.append(key)
                    parts.append(np.stack(now))
                    held += parts[-1].size
                    now = []
                    if held > AT_ONCE:
                        yield out(keys, parts)
                        keys, parts, held = [], [], 0
                key = ids[a]
                now += e[a:b]
        if now:
            keys.append(key)
            parts.append(np.stack(now))
        if keys:
            yield out(keys, parts)

    rows = vectors.where(F.col("e").isNotNull()).select(by, "pos", "e")
    schema = T.StructType([rows.schema[by], T.StructField("token", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType()))])
    return rows.repartition(by).sortWithinPartitions(by, "pos").mapInPandas(run, schema)
