"""Numeric operators around models: pooling, fusion, optimal transport, text encoding by a given encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import group_sums
from ..session import stash
from .graph import _matrix, neighbor_mean


def fused(parts: list[tuple[DataFrame, float]], size: int) -> DataFrame:
    """(id, e): the weighted sum of several tables of vectors; an id that one lacks counts as zeros there."""
    every = None
    for df, w in parts:
        one = df.select("id", "e", F.lit(float(w)).alias("w"))
        every = one if every is None else every.unionByName(one)
    return group_sums(every, ["id"], size, F.sum, F.col("w"))


def motif_layer(vectors: DataFrame, motifs: list[tuple[DataFrame, float]], size: int) -> DataFrame:
    """Mean over each motif's neighbours, fused by the motifs' weights."""
    return fused([(neighbor_mean(vectors, m, size), w) for m, w in motifs], size)


def read_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """Matrices by name from (name, row, e): one row of a matrix each. A model's weights fit the driver and every task."""
    rows: dict[str, dict[int, list[float]]] = {}
    for r in table.select("name", "row", "e").collect():
        rows.setdefault(r["name"], {})[r["row"]] = r["e"]
    return {name: np.array([own[k] for k in sorted(own)]) for name, own in rows.items()}


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (0.5 + 0.5 * np.frompyfunc(erf, 1, 1)(x / np.sqrt(2)).astype(float))


def mapped(vectors: DataFrame, layer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, e) with layer applied to batches of vectors, as matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "e": list(layer(np.stack(pdf.e.to_numpy())))})

    return vectors.select("id", "e").mapInPandas(run, "id long, e array<double>")


def sage_layer(vectors: DataFrame, edges: DataFrame, near: np.ndarray, bias: np.ndarray, own: np.ndarray, after: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """(id, e): near times the mean of a node's neighbours, plus bias, plus own times the node's vector, and after of that. Without neighbours the mean is zero.

    Of near's two sides, the narrower one is what is averaged, so that is what the join carries.
    """
    before = near.shape[0] < near.shape[1]
    width = min(near.shape)
    sent = mapped(vectors, lambda x: x @ near.T) if before else vectors
    mean = neighbor_mean(sent, edges, width).withColumnRenamed("e", "mean")
    both = vectors.select("id", "e").join(mean, "id", "left")
    whole = both.select("id", F.concat("e", F.coalesce("mean", F.array_repeat(F.lit(0.0), width))).alias("e"))
    size = own.shape[1]

    def layer(x: np.ndarray) -> np.ndarray:
        m = x[:, size:]
        return after((m if before else m @ near.T) + bias + x[:, :size] @ own.T)

    return mapped(whole, layer)


def motif_network(vectors: DataFrame, motifs: list[DataFrame], weights: dict[str, np.ndarray], eps: float = 1e-5) -> DataFrame:
    """(id, e): what a trained network of motifs gives: a shared projection, two layers over each motif's edges, and their weighted sum.

    weights (read_weights) has shared.weight (k, size), shared.bias (1, k), fusion (1, motifs) and, for
    motif i, first.i.near, first.i.bias, first.i.own, the same of second.i, and norm.i.scale, .shift,
    .mean and .variance, each of one row. Every node of vectors gets a vector.
    """
    w = weights
    shared = stash(mapped(vectors, lambda x: gelu(x @ w["shared.weight"].T + w["shared.bias"])), "shared")
    out = []
    for i, edges in enumerate(motifs):

        def normed(x: np.ndarray, i: int = i) -> np.ndarray:
            at = (np.maximum(x, 0.0) - w[f"norm.{i}.mean"]) / np.sqrt(w[f"norm.{i}.variance"] + eps)
            return at * w[f"norm.{i}.scale"] + w[f"norm.{i}.shift"]

        part = [[w[f"{layer}.{i}.{c}"] for c in ("near", "bias", "own")] for layer in ("first", "second")]
        hidden = stash(sage_layer(shared, edges, *part[0], normed), "hidden")
        out.append((sage_layer(hidden, edges, *part[1]), float(w["fusion"][0, i])))
    return fused(out, len(w["second.0.own"]))


def mean_vector(vectors: DataFrame, size: int, *by: str) -> DataFrame:
    return group_sums(vectors, list(by), size, F.avg)


def with_new_rows(vectors: DataFrame, size: int, n: int) -> DataFrame:
    """(id, e) and n more rows after the largest id, each the mean of all rows: what a table of vectors begins new tokens with."""
    last = vectors.agg(F.max("id")).first()[0]
    if last is None:  # nothing to take a mean of
        return vectors.select("id", "e")
    new = mean_vector(vectors.select("id", "e"), size).select(F.explode(F.sequence(F.lit(last + 1), F.lit(last + n))).alias("id"), "e")
    return vectors.select("id", "e").unionByName(new)


def adaptive_pool(values: Column, n: int, to: int = 5) -> Column:
    """An array of n numbers as to means of stretches that cover it: from floor(i n / to) to ceil((i + 1) n / to)."""
    out = []
    for i in range(to):
        a, b = i * n // to, -(-(i + 1) * n // to)
        out.append(F.aggregate(F.slice(values, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) / (b - a))
    return F.array(*out)


def attention_pool(x: np.ndarray, queries: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """x (steps, size) as one weighted mean a query, after taking off the steps' mean."""
    x = x - x.mean(axis=0)
    s = queries @ x.T / (np.sqrt(x.shape[1]) * temperature)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    return (w / w.sum(axis=1, keepdims=True)) @ x


def pooled(vectors: DataFrame, queries: np.ndarray, by: str = "id", temperature: float = 1.0) -> DataFrame:
    """(by, query, e): each group's vectors, in order of pos, as one weighted mean a query; a group is worked on as a whole."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("pos").e.to_numpy())
        return pd.DataFrame({by: pdf[by].iloc[0], "query": np.arange(len(queries)), "e": list(attention_pool(x, queries, temperature))})

    return vectors.select(by, "pos", "e").groupBy(by).applyInPandas(one, f"{by} long, query long, e array<double>")


#: Softness of the prices that transport begins with, as shares of the mean cost, and rounds of each.
SOFTNESS, ROUNDS = (0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005), 30
#: Rows whose costs are made at once for that, so that they stay in the processor's cache.
COST_ROWS = 256
#: Costs that are kept; of more, a row's are made when they are asked for.
COSTS_KEPT = 1 << 22


def _soft_prices(n: int, m: int, costs: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Prices at which each column is about equally sought by rows that choose softly. Any prices will do to begin with; these leave little to mend."""
    mean = float(np.mean([costs(np.array([i])).mean() for i in range(0, n, max(1, n // 64))]))
    if m == 1 or mean <= 0 or not np.isfinite(mean):
        return np.zeros(m)
    single = lambda lo: costs(np.arange(lo, min(n, lo + COST_ROWS))).astype(np.float32)
    kept = {lo: single(lo) for lo in range(0, n, COST_ROWS)} if n * m <= COSTS_KEPT else {}
    price = np.zeros(m, np.float32)
    for soft in SOFTNESS:
        for _ in range(ROUNDS):
            sought = np.zeros(m, np.float32)
            for lo in range(0, n, COST_ROWS):
                x = kept[lo] + price if kept else single(lo) + price
                x -= x.min(axis=1, keepdims=True)
                x *= np.float32(-1 / (soft * mean))
                np.exp(x, out=x)
                sought += (1 / x.sum(axis=1)) @ x
            price += np.float32(soft * mean) * np.log(np.maximum(sought * np.float32(m / n), np.float32(1e-30)))
    return (price - price.min()).astype(float)


def flows(n: int, m: int, costs: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest flow from n rows of one weight to m columns of one weight, in whole units of both over their common divisor: rows, columns and units of its arcs, and the columns' prices.

    costs gives the costs of some rows. Rows come one after another, and a row's units go to the
    nearest column with room, over full columns that send on units of other rows. So a search
    goes over columns only; memory is the square of their number, and that should be the smaller side.
    Prices end so that each row's units lie in columns of its least cost plus price, which proves the flow best.
    """
    unit = gcd(n, m)
    supply, room, full = m // unit, np.full(m, n // unit), np.zeros(m, bool)
    price = _soft_prices(n, m, costs)
    held: list[dict[int, int]] = [{} for _ in range(m)]  # units by row
    move, stale = np.empty((m, m)), np.ones(m, bool)  # the least cost of moving one of a column's units to each column

    def rows_of(j: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.fromiter(held[j], np.int64, len(held[j]))
        return rows, costs(rows)

    for i in range(n):
        own, left = costs(np.array([i]))[0], supply
        while left:
            cost, seek, before, met, far = own.copy(), own + price, np.full(m, -1), [], []
            while full[j := int(seek.argmin())]:
                met.append(j)
                far.append(seek[j])
                so_far, seek[j], cost[j] = cost[j], np.inf, -np.inf
                if stale[j]:
                    c = rows_of(j)[1]
                    move[j], stale[j] = (c - c[:, j : j + 1]).min(axis=0), False
                way = move[j] + so_far
                at = np.flatnonzero(way < cost)
                cost[at] = way[at]
                seek[at] = way[at] + price[at]
                before[at] = j
            price[met] += np.maximum(0.0, seek[j] - np.array(far))
            path, to, most = [], j, min(left, int(room[j]))
            while (k := int(before[to])) >= 0:
                rows, c = rows_of(k)
                r = int(rows[(c[:, to] - c[:, k]).argmin()])
                path.append((r, k, to))
                to, most = k, min(most, held[k][r])
            for r, k, there in path:
                held[there][r] = held[there].get(r, 0) + most
                held[k][r] -= most
                if not held[k][r]:
                    del held[k][r]
                stale[k] = stale[there] = True
            held[to][i] = held[to].get(i, 0) + most
            stale[to] = True
            left -= most
            room[j] -= most
            full[j] = not room[j]
    arcs = np.array([(r, j, u) for j, rows in enumerate(held) for r, u in rows.items()], np.int64)
    return arcs[:, 0], arcs[:, 1], arcs[:, 2], price


def transport(cost: np.ndarray) -> np.ndarray:
    """The cheapest flow that gives every row the same weight and every column the same, in whole units: of rows by columns over their common divisor."""
    if cost.shape[0] < cost.shape[1]:
        return transport(cost.T).T
    rows, columns, units, _ = flows(*cost.shape, lambda some: cost[some])
    flow = np.zeros(cost.shape, np.int64)
    flow[rows, columns] = units
    return flow


def transport_cost(a: np.ndarray, b: np.ndarray) -> float:
    """The exact least cost of moving uniform weight from points a to points b, at squared distances."""
    if len(a) < len(b):
        a, b = b, a
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    costs = lambda rows: np.maximum(aa[rows, None] + bb - 2 * a[rows] @ b.T, 0.0)
    if len(a) * len(b) <= COSTS_KEPT:
        kept = costs(np.arange(len(a)))
        costs = lambda rows: kept[rows]
    rows, columns, units, _ = flows(len(a), len(b), costs)
    far = a[rows] - b[columns]
    return float(((far * far).sum(axis=1) * units).sum() / units.sum())


#: Points of the smaller side that an exact distance is made for: memory is eight bytes times their square.
MOST_POINTS = 12_288


def transport_to_groups(new: DataFrame, groups: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """(name, distance) from the points new (e) to each group's points (name, e); a group is one task, which has all points of both sides.

    Work grows with the points' cube, memory with the square of the smaller side: if that has more than
    most points, it is an error, and closest_by_votes() the way for it.
    """
    spark, schema = new.sparkSession, "name string, distance double"
    n, named = new.count(), groups.select(F.col("name").cast("string").alias("name"), "e")
    sizes = {r["name"]: r["count"] for r in named.groupBy("name").count().collect()}  # a row a group
    if any(min(n, size) > most for size in sizes.values()):
        raise ValueError(f"more than {most} points on both sides: draw samples, as closest_by_votes() does")
    if not n or not sizes:
        return spark.createDataFrame([], schema)
    names = list(sizes)
    at = spark.createDataFrame(list(enumerate(names)), "at int, known string")
    theirs = named.join(F.broadcast(at), F.col("name").eqNullSafe(F.col("known"))).select("at", F.lit(False).alias("own"), "e")
    ours = new.select(F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("at"), F.lit(True).alias("own"), "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            own, e = rows.column("own").to_numpy(), _matrix(rows.column("e").combine_chunks())
            far = round(transport_cost(e[own], e[~own]), 6)
            yield pa.RecordBatch.from_arrays([pa.array([names[rows.column("at")[0].as_py()]], pa.string()), pa.array([far])], names=["name", "distance"])

    return ours.unionByName(theirs).repartitionById(len(names), "at").mapInArrow(run, schema)


def closest_by_votes(new: DataFrame, groups: DataFrame, size: int, draws: int, seed: int = 42) -> DataFrame:
    """(name, votes): how often each group is the closest one over draws of size points from either side, drawn by hash.

    new is (id, e), groups is (name, id, e). Each draw and group is one small task.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")

    def drawn(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("draw", *by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "id")), "id")
        return df.select("*", every).withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)

    own = drawn(new.select("id", "e")).groupBy("draw").agg(F.collect_list(F.struct("id", "e")).alias("own"))  # size vectors a draw
    others = drawn(groups.select(F.col("name").cast("string").alias("name"), "id", "e"), "name").groupBy("draw", "name").agg(F.collect_list("e").alias("theirs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = [round(transport_cost(np.stack([p["e"] for p in a]), np.stack(list(b))), 6) for a, b in zip(pdf.own, pdf.theirs)]
            yield pd.DataFrame({"draw": pdf.draw, "name": pdf.name_, "distance": far})

    found = others.join(own, "draw").select("draw", F.col("name").alias("name_"), "own", "theirs").mapInPandas(run, "draw int, name string, distance double")
    return found.groupBy("draw").agg(F.min_by("name", F.struct("distance", "name")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("votes"))


def closest(distances: DataFrame) -> DataFrame:
    return distances.agg(F.min_by("name", F.struct("distance", "name")).alias("closest"))


def hashing_encoder(size: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: signed counts of hashed words, at length one."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)

    return encode


def encoded(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(id, e) of (id, text) by any encoder of lists of texts; blank texts are one space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                e = encoder([t if t and t.strip() else " " for t in part.text])
                yield pd.DataFrame({"id": part.id.to_numpy(), "e": list(e)})

    return texts.select("id", "text").mapInPandas(run, "id long, e array<double>")


def last_token(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, steps, size) as the state at each row's last token, whichever side is padded."""
    if mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), mask.sum(axis=1) - 1]
