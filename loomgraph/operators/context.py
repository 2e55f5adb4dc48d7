"""Context subgraphs: relevance, coherence, the greedy walk, and the fixed-length sequence.

Two plans give the same walks. While vectors and edges together stay below a checked size they
are broadcast, and each center's walks run in one Arrow batch; beyond it, walks go on in supersteps
over (center, walk), written after every step, and vectors stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..functions.vectors import cosine, rounded
from ..session import bucketed, discard, stash
from .graph import PAIR_BYTES, SEED, _matrix, capped_neighbors, neighbors_of

PAD, STARTS, STEPS, LENGTH, BETA, THRESHOLD, SAMPLE, CAP = -500, 9, 10, 111, 0.55, 0.02, 10, 256
#: Digits of sums and blends of rounded cosines: with as few digits as those, halves would be rounded by chance.
FINE = 10
#: Numbers in the broadcast graph: vectors' elements and edges. 32 million doubles are 256 MB.
BROADCAST_NUMBERS = 32_000_000
#: Walks of a part of the supersteps' state, as many as a task holds, and fewest of one that is made smaller for the sake of more tasks.
PART_WALKS, LEAST_WALKS = 8192, 512
#: Pairs of vectors that a cell's task multiplies at once.
PAIRS_AT_ONCE = 1 << 15
#: Columns of the supersteps' state.
STATE = {"part": "int", "center": "long", "walk": "int", "node": "long", "seen": "array<long>", "front": "array<long>", "scores": "array<double>"}


def relevance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(center, id) pairs with rel: the cosine of both vectors, not below 0."""
    a, b = vectors.select(F.col("id").alias("center"), F.col("e").alias("ea")), vectors.select("id", F.col("e").alias("eb"))
    return pairs.join(a, "center").join(b, "id").select("center", "id", F.greatest(F.lit(0.0), rounded(cosine(F.col("ea"), F.col("eb")))).alias("rel"))


def sampled_with_return(edges: DataFrame, draws: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(id, neighbor, draw): draws from each node's sorted neighbours by hash, the same one possibly again."""
    near = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("n")).select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    at = F.conv(F.substring(seeded(seed, F.col("id"), F.col("draw")), 1, 8), 16, 10).cast("long") % F.size("n")
    return near.select("id", F.get("n", at.cast("int")).alias("neighbor"), "draw")


def coherence(vectors: DataFrame, edges: DataFrame, returns: bool = False, seed: int = SEED) -> DataFrame:
    """(id, coh): over at most ten sampled neighbours, the sum of cosines not below 0, times their share of ten. It depends on the node alone, so once a node is enough."""
    some = sampled_with_return(edges, SAMPLE, seed) if returns else capped_neighbors(edges, SAMPLE, seed)
    a, b = vectors.select("id", F.col("e").alias("ea")), vectors.select(F.col("id").alias("neighbor"), F.col("e").alias("eb"))
    each = some.join(a, "id").join(b, "neighbor").select("id", F.greatest(F.lit(0.0), rounded(cosine(F.col("ea"), F.col("eb")))).alias("c"))
    return each.groupBy("id").agg(rounded(F.sum("c") * F.count(F.lit(1)) / SAMPLE, FINE).alias("coh"))


def start_neighbors(centers: DataFrame, edges: DataFrame, k: int = STARTS, seed: int = SEED) -> DataFrame:
    """(center, walk, id): at most k neighbours of each center, in hash order."""
    c = centers.select(F.col("id").alias("center"))
    return capped_neighbors(edges, k, seed).join(c, F.col("id") == F.col("center"), "left_semi").select(F.col("id").alias("center"), (F.col("rank") - 1).alias("walk"), F.col("neighbor").alias("id"))


def blend(rel: Column, coh: Column, beta: float) -> Column:
    return rounded(F.lit(beta) * coh + F.lit(round(1 - beta, 12)) * rel, FINE)


def softmax(x: Column, over, eps: float = 1e-10) -> Column:
    top = F.max(x).over(over)
    return rounded(F.exp(x - top) / (F.sum(F.exp(x - top)).over(over) + F.lit(eps)))


def walks(starts: DataFrame, edges: DataFrame, vectors: DataFrame, coh: DataFrame, *, beta: float = BETA, threshold: float = THRESHOLD, steps: int = STEPS, cap: int | None = None, eps: float = 1e-10, seed: int = SEED, most: int = BROADCAST_NUMBERS) -> DataFrame:
    """(center, walk, step, node) of every start's walk, by whichever plan the graph's size allows."""
    n, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    if n * (size or 0) + edges.count() > most:
        return walks_by_joins(starts, edges, vectors, coh, beta=beta, threshold=threshold, steps=steps, cap=cap, eps=eps, seed=seed)
    return walks_by_broadcast(starts, edges, vectors, coh, beta=beta, threshold=threshold, steps=steps, cap=cap, eps=eps, seed=seed)


class VectorGrid:
    """Vectors laid out once so that any pair of them meets without a shuffle of vectors.

    Ids are hashed into `side` blocks; cell (i, j) of a grid holds the centers of block i and the
    candidates of block j. Both are in one table bucketed by cell: each vector is written 2 * side
    times before the walk, and never moves again. A step sends (center, candidate) to its cell,
    numbers only, and a number comes back; a cell's pairs are scored together, as rows of two matrices.
    """

    def __init__(self, vectors: DataFrame, coh: DataFrame, side: int):
        self.spark, self.side = vectors.sparkSession, side
        every = F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("other")
        held = vectors.select("id", "e").join(coh, "id", "left").select("id", "e", F.coalesce("coh", F.lit(0.0)).alias("coh"), every)
        own = held.withColumn("own", F.lit(True)).withColumn("cell", self.cell(self.block("id"), F.col("other")))
        others = held.withColumn("own", F.lit(False)).withColumn("cell", self.cell(F.col("other"), self.block("id")))
        self.table, self.cells = bucketed(own.unionByName(others).drop("other"), "cell", side * side, "grid")

    def block(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.side)).cast("int")

    def cell(self, i: Column, j: Column) -> Column:
        return i * self.side + j

    def scored(self, asked: DataFrame, beta: float) -> DataFrame:
        """asked(center, walk, id) with x, the blend of relevance and coherence; pairs without both vectors are left out."""
        gamma = round(1 - beta, 12)

        def score(pairs: pa.Table, cell: pa.Table) -> pa.Table:
            out = pairs.select(["center", "walk", "id"])
            if not pairs.num_rows or not cell.num_rows:
                return out.slice(0, 0).append_column("x", pa.array([], pa.float64()))
            own = cell.column("own").to_numpy()
            ids, coh, e = cell.column("id").to_numpy(), cell.column("coh").to_numpy(), _matrix(cell.column("e").combine_chunks())
            e = e / np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-300)

            def places(which: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if not len(which):
                    return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
                which = which[np.argsort(ids[which], kind="stable")]
                at = which[np.minimum(np.searchsorted(ids[which], asked), len(which) - 1)]
                return at, ids[at] == asked

            a, known_a = places(np.flatnonzero(own), pairs.column("center").to_numpy())
            b, known_b = places(np.flatnonzero(~own), pairs.column("id").to_numpy())
            rel = np.empty(len(a))
            for lo in range(0, len(a), PAIRS_AT_ONCE):
                part = slice(lo, lo + PAIRS_AT_ONCE)
                rel[part] = np.einsum("ij,ij->i", e[a[part]], e[b[part]])
            x = np.round(beta * coh[b] + gamma * np.maximum(0.0, np.round(rel, 6)), FINE)
            return out.append_column("x", pa.array(x)).filter(pa.array(known_a & known_b))

        there = asked.select("center", "walk", "id", self.cell(self.block("center"), self.block("id")).alias("cell"))
        return there.groupBy("cell").cogroup(self.cells.groupBy("cell")).applyInArrow(score, "center long, walk int, id long, x double")

    def __enter__(self) -> VectorGrid:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _next(scored: pa.Table, state: pa.Table, threshold: float, cap: int | None, eps: float, seed: int) -> pa.Table:
    """One step of all walks of a part: the state after it. scored has the neighbours of each walk's node."""
    n = state.num_rows
    center, walk = state.column("center").to_numpy(), state.column("walk").to_numpy()
    going = state.column("node").is_valid().to_numpy()

    # A walk is known by its row in the state from here on.
    centers, numbers = np.unique(center), np.unique(walk)
    key = lambda c, w: np.searchsorted(centers, c) * len(numbers) + np.searchsorted(numbers, w)
    known = key(center, walk)
    by = np.argsort(known)
    new_row = by[np.searchsorted(known[by], key(scored.column("center").to_numpy(), scored.column("walk").to_numpy()))] if scored.num_rows else np.zeros(0, np.int64)

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = state.column(name).combine_chunks()
        return np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)

    (seen_row, seen_id), (front_row, front_id), (_, front_x) = flat("seen"), flat("front"), flat("scores")
    row, id_ = np.concatenate([seen_row, front_row, new_row]), np.concatenate([seen_id, front_id, scored.column("id").to_numpy()])
    x = np.concatenate([np.full(len(seen_id), np.nan), front_x, scored.column("x").to_numpy()])
    order = np.lexsort((id_, row))  # stable: of equal ids, one that was seen comes first
    row, id_, x = row[order], id_[order], x[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (id_[1:] != id_[:-1])
    keep = first & ~np.isnan(x) & going[row]
    row, id_, x = row[keep], id_[keep], x[keep]

    node, picked = np.zeros(n, np.int64), np.zeros(n, bool)
    if len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(begin, len(row)))
        spread = lambda per_walk: np.repeat(per_walk, size)
        open_x = x
        if cap and size.max() > cap:
            many = np.unique(id_[spread(size > cap)])
            rank = np.empty(len(many), np.int64)
            rank[sorted(range(len(many)), key=lambda k: (hashlib.md5(f"{seed}|{many[k]}".encode()).hexdigest(), many[k]))] = np.arange(len(many))
            rank = np.where(spread(size > cap), rank[np.minimum(np.searchsorted(many, id_), len(many) - 1)], 0)
            ranked = np.lexsort((rank, row))  # walks keep their stretches
            place = np.empty(len(row), np.int64)
            place[ranked] = np.arange(len(row)) - spread(begin)
            open_x = np.where(place < cap, x, -np.inf)
        y = np.exp(open_x - spread(np.maximum.reduceat(open_x, begin)))
        eta = np.round(y / (spread(np.add.reduceat(y, begin)) + eps), 6)
        best = np.maximum.reduceat(eta, begin)
        hit = np.flatnonzero((eta == spread(best)) & (eta > threshold))
        own, at = np.unique(row[hit], return_index=True)  # the least id of equals
        node[own], picked[own] = id_[hit[at]], True
    left = picked[row] & (id_ != node[row])
    row, id_, x = row[left], id_[left], x[left]

    more = np.flatnonzero(picked)
    path_row, path_id = np.concatenate([seen_row, more]), np.concatenate([seen_id, node[more]])
    path = np.argsort(path_row, kind="stable")
    lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))
    columns = {"node": pa.array(node, mask=~picked), "seen": lists(path_row[path], path_id[path]), "front": lists(row, id_), "scores": lists(row, x)}
    return pa.table({name: columns.get(name, state.column(name)) for name in STATE})


def walks_by_joins(starts: DataFrame, edges: DataFrame, vectors: DataFrame, coh: DataFrame, *, beta: float, threshold: float, steps: int, cap: int | None, eps: float, seed: int, side: int | None = None) -> DataFrame:
    """The walks in supersteps. A walk is one row: its node (null: it has ended), what it has visited, in order, and its front of scored candidates.

    A step asks for the scores of the neighbours of each walk's node. They are made where the vectors
    lie (VectorGrid, side blocks a side) and go to their walks, which lie bucketed in parts of some
    PART_WALKS; fronts never move.
    """
    spark = starts.sparkSession
    if side is None:
        n, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
        side = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5), -(-n * (size or 0) * 8 // PAIR_BYTES))
    n = starts.count()
    parts = max(1, -(-n // PART_WALKS), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_WALKS))
    part = F.pmod(F.xxhash64("center"), F.lit(parts)).cast("int").alias("part")
    first = starts.select(part, "center", F.col("walk").cast("int").alias("walk"), F.col("id").alias("node"), F.array("id").alias("seen"), F.array().cast("array<long>").alias("front"), F.array().cast("array<double>").alias("scores"))

    def step(scored: pa.Table, state: pa.Table) -> pa.Table:
        return _next(scored, state, threshold, cap, eps, seed)

    with VectorGrid(vectors, coh, side) as grid:
        table, state = bucketed(first, "part", parts, "walks")
        for _ in range(1, steps):
            here = state.where("node is not null").select("center", "walk", "node")
            asked = here.join(edges, F.col("node") == F.col("src")).select("center", "walk", F.col("dst").alias("id"))
            scored = grid.scored(asked, beta).select(part, "center", "walk", "id", "x")
            after = scored.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(step, ", ".join(f"{name} {kind}" for name, kind in STATE.items()))
            last, (table, state) = table, bucketed(after, "part", parts, "walks", dealt=True)
            discard(spark, last)
            if state.where("node is not null").isEmpty():
                break
        out = stash(state.select("center", "walk", F.posexplode("seen").alias("step", "node")), "walk")
        discard(spark, table)
    return out


def walks_by_broadcast(starts: DataFrame, edges: DataFrame, vectors: DataFrame, coh: DataFrame, *, beta: float, threshold: float, steps: int, cap: int | None, eps: float, seed: int) -> DataFrame:
    v = vectors.join(coh, "id", "left").select("id", "e", F.coalesce("coh", F.lit(0.0)).alias("coh")).orderBy("id").toArrow()
    ids, own_coh = (v.column(c).to_numpy() for c in ("id", "coh"))
    e = v.column("e").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(float) if len(ids) else np.zeros((0, 1))
    e /= np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-300)
    links = edges.select("src", "dst").distinct().toArrow()
    s, d = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("src", "dst"))
    order = np.lexsort((d, s))
    pointer = np.searchsorted(s[order], np.arange(len(ids) + 1))
    rank = None
    if cap:
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"{seed}|{ids[k]}".encode()).hexdigest(), ids[k]))] = np.arange(len(ids))
    shared = starts.sparkSession.sparkContext.broadcast((ids, e, own_coh, d[order], pointer, rank))
    gamma = round(1 - beta, 12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, e, coh, flat, pointer, rank = shared.value
        place = {i: k for k, i in enumerate(ids.tolist())}
        for batch in batches:
            out = []
            for center, walk, start in zip(batch.center.tolist(), batch.walk.tolist(), batch.id.tolist()):
                mid, here, seen, front = e[place[center]], place[start], set(), set()
                out.append((center, walk, 0, start))
                for step in range(1, steps):
                    seen.add(here)
                    front.update(flat[pointer[here] : pointer[here + 1]].tolist())
                    front -= seen
                    some = np.array(sorted(front), np.int64)
                    if cap and len(some) > cap:
                        some = np.sort(some[np.argsort(rank[some])[:cap]])
                    if len(some) == 0:
                        break
                    rel = np.maximum(0.0, np.round(e[some] @ mid, 6))  # of the candidates only
                    x = np.round(beta * coh[some] + gamma * rel, FINE)
                    y = np.exp(x - x.max())
                    eta = np.round(y / (y.sum() + eps), 6)
                    best = int(eta.argmax())
                    if not eta[best] > threshold:
                        break
                    here = int(some[best])
                    out.append((center, walk, step, int(ids[here])))
            yield pd.DataFrame(out, columns=["center", "walk", "step", "node"]).astype({"walk": "int32", "step": "int32"})

    n = starts.sparkSession.sparkContext.defaultParallelism
    return starts.repartition(n, "center").select("center", "walk", "id").mapInPandas(run, "center long, walk int, step int, node long")


def sequences(centers: DataFrame, starts: DataFrame, walk: DataFrame) -> DataFrame:
    """(center, graph): the center, its starts, a pad, the walks from slot 11 on, ten slots each, and pads up to 111."""
    slots = (
        centers.select(F.col("id").alias("center"), F.lit(0).alias("pos"), "id")
        .unionByName(starts.select("center", (F.col("walk") + 1).alias("pos"), "id"))
        .unionByName(walk.select("center", (F.lit(STARTS + 2) + F.col("walk") * STEPS + F.col("step")).alias("pos"), F.col("node").alias("id")))
    )
    filled = slots.groupBy("center").agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("m"))
    return filled.select("center", F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(PAD).cast("long"))).alias("graph"))


def neighborhood(centers: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbors_of(centers, edges).select(F.col("id").alias("center"), F.col("neighbor").alias("id"))
