"""Graphs as tables: edges(src, dst), nodes(id, ...). Undirected graphs hold both directions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..functions.vectors import group_sums
from ..session import bucketed, stash
from .order import with_index, with_running_sum

SEED = 42


# -- building -------------------------------------------------------------------------------


#: Bytes of the vectors of one block, of which two meet in a task.
PAIR_BYTES = 32 << 20
#: Rows of either block whose products are made at once, so that they stay in the processor's cache.
ROWS_AT_ONCE, COLUMNS_AT_ONCE = 256, 1024
#: Fewest rows of a block that is made smaller than need be, for the sake of more tasks.
LEAST_BLOCK = 1024


def _matrix(e: pa.Array) -> np.ndarray:
    """The rows of a list column, which have one length."""
    size = pc.list_value_length(e).to_numpy(zero_copy_only=False)
    if not (size == size[0]).all():
        raise ValueError("vectors of several lengths, or null")
    return e.flatten().to_numpy(zero_copy_only=False).reshape(len(e), int(size[0]))


def _in_order(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one side of a task, in rising ids."""
    ids = np.concatenate([i for i, _ in held])
    by = np.argsort(ids, kind="stable")
    return ids[by], np.concatenate([e for _, e in held])[by]


def block_pairs(left: DataFrame, right: DataFrame, work: Callable[..., Iterator[tuple[np.ndarray, ...]]], schema: str, block: int | None = None, once: bool = False) -> DataFrame:
    """The columns that work(ids, vectors, ids, vectors) yields for every pair of blocks of two tables (id, e), e array<double>.

    Ids are hashed into blocks; each pair of blocks is one task, in rising ids on either side:
    memory is bounded by the block, not by the tables. A vector moves once for each block of the other
    table, so blocks are as large as PAIR_BYTES allow, or fewer rows where all tasks would not have
    work otherwise. Two blocks of one table (right is left) meet in one task, where work is called both
    ways; once, it is called one way and yields the rows of both.
    """
    spark, same = left.sparkSession, right is left
    names = [c.split()[0] for c in schema.split(", ")]

    def side(df: DataFrame) -> int:
        n, size = df.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
        most = block or max(1, PAIR_BYTES // (8 * (size or 1)))
        tasks = 0 if block else int((spark.sparkContext.defaultParallelism * (8 if same else 4)) ** 0.5) + 1
        return max(1, -(-n // most), min(tasks, n // LEAST_BLOCK))

    n = side(left)
    m = n if same else side(right)
    at = lambda own: F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias("at")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other")
    if same:
        lo, hi = F.least("at", "other"), F.greatest("at", "other")
        cell = F.shiftright(hi * (hi + 1), 1) + lo
        cells, rows = n * (n + 1) // 2, left.select("id", "e", at(n), every(n)).select(cell.alias("cell"), (F.col("at") <= F.col("other")).alias("own"), "id", "e")
    else:
        first = left.select("id", "e", at(n), every(m)).select((F.col("at") * m + F.col("other")).alias("cell"), F.lit(True).alias("own"), "id", "e")
        second = right.select("id", "e", at(m), every(n)).select((F.col("other") * m + F.col("at")).alias("cell"), F.lit(False).alias("own"), "id", "e")
        cells, rows = n * m, first.unionByName(second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = {True: [], False: []}, set()
        for batch in batches:
            if batch.num_rows:
                cell.update(pc.unique(batch.column("cell")).to_pylist())
                own, ids, e = batch.column("own").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), _matrix(batch.column("e"))
                for flag, mask in ((True, own), (False, ~own)):
                    if mask.any():
                        held[flag].append((ids[mask], e[mask]))
        if len(cell) > 1:
            raise RuntimeError("a task holds several pairs of blocks")
        a = _in_order(held.pop(True)) if held[True] else None
        b = _in_order(held.pop(False)) if held[False] else None
        if same:
            # Of a block with itself there is one side.
            own_only = cell and (x := cell.pop()) == (y := int(((8 * x + 1) ** 0.5 - 1) / 2)) * (y + 1) // 2 + y
            ways = [(a, a)] if own_only else [(a, b)] if once else [(a, b), (b, a)]
        else:
            ways = [(a, b)]
        for x, y in ways:
            if x is not None and y is not None:
                for columns in work(*x, *y):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.repartitionById(cells, "cell").mapInArrow(run, schema)


def nearest(vectors: DataFrame, k: int = 8, block: int | None = None) -> DataFrame:
    """(src, dst, sim): the k most similar other vectors of each, by rounded product, ties by id.

    Each pair of blocks is one task of matrix products, which keeps the k best a row; the blocks'
    bests are merged by a second top-k.
    """
    return _first(block_pairs(vectors, vectors, _best(k), "src long, dst long, sim double", block), k)


#: Longest vectors that are compared in single precision, and the share of a matrix that may need a second look before it is made in double.
SINGLE_NORM, SECOND_LOOKS = 1e15, 1 / 16


class Top:
    """The k largest products of each of some rows with other vectors, rounded to six digits, and the others' ids, ties by id; blocks of others are given one after another.

    Products are made in single precision and compared with the least that a row holds, less what
    such a product can be off; only those that pass are made in double and rounded.
    """

    def __init__(self, ids: np.ndarray, e: np.ndarray, k: int):
        self.own, self.e, self.k = ids, e, k
        self.sim, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norm = np.sqrt((e * e).sum(axis=1))
        self.fits = bool((self.norm < SINGLE_NORM).all())
        self.single = e.astype(np.float32) if self.fits else e
        self._products, self._passed = np.empty(0, np.float32), np.empty(0, bool)

    def _floor(self, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray, off: np.ndarray) -> np.ndarray:
        """What a product of each row must be to count, if it may be off by so much; rows without k take their own k-th of sim."""
        least = self.sim[rows, -1]
        # What rounds to the least held counts if its id can be lower.
        floor = least + np.where(ids[0] < self.id[rows, -1], -0.5e-6, 0.5e-6) - np.abs(least) * 1e-12 - off
        few = np.flatnonzero(np.isneginf(least))
        if len(few) and sim.shape[1] > self.k:
            finite = np.where(np.isfinite(sim[few]), sim[few], -np.inf)
            kth = np.partition(finite, -self.k - 1, axis=1)[:, -self.k - 1].astype(float)  # one more: a row may meet itself
            floor[few] = kth - 1e-6 - np.abs(kth) * 1e-12 - 2 * off[few]
        return floor

    def add(self, rows: np.ndarray, ids: np.ndarray, e: np.ndarray, single: np.ndarray | None) -> None:
        """The products of rows, distinct places among the own ones, with others in rising ids; single is e in single precision, None if it does not fit."""
        if not len(rows) or not len(ids):
            return
        every = len(rows) == len(self.own)
        size, shape = len(rows) * len(ids), (len(rows), len(ids))
        at = None
        if self.fits and single is not None:
            if len(self._products) < size:
                self._products, self._passed = np.empty(size, np.float32), np.empty(-(-size // 8) * 8, bool)
            sim = np.matmul(self.single if every else self.single[rows], single.T, out=self._products[:size].reshape(shape))
            off = self.norm[rows] * (np.sqrt((e * e).sum(axis=1).max()) * (e.shape[1] + 8) * 2.0**-24) + 1e-9
            self._passed[size : -(-size // 8) * 8] = False
            np.greater_equal(sim, self._floor(rows, ids, sim, off).astype(np.float32)[:, None], out=self._passed[:size].reshape(shape))
            eights = np.flatnonzero(self._passed[: -(-size // 8) * 8].view(np.uint64))
            at = (eights[:, None] * 8 + np.arange(8)).ravel()
            at = at[self._passed[at]]
            if len(at) <= size * SECOND_LOOKS:
                new = np.einsum("ij,ij->i", self.e[rows[at // len(ids)]], e[at % len(ids)])
            else:
                at = None
        if at is None:
            sim = (self.e if every else self.e[rows]) @ e.T
            at = np.flatnonzero(sim >= self._floor(rows, ids, sim, np.full(len(rows), 1e-9))[:, None])
            new = sim.ravel()[at]
        self._keep(rows, at // len(ids), ids[at % len(ids)], np.round(new, 6) + 0.0)

    def _keep(self, rows: np.ndarray, line: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
        least, last = self.sim[rows, -1], self.id[rows, -1]
        better = np.isfinite(new) & (to != self.own[rows][line]) & ((new > least[line]) | ((new == least[line]) & (to < last[line])))
        line, to, new = line[better], to[better], new[better]
        if not len(line):
            return
        touched = np.unique(line)
        into = rows[touched]
        line, new, to = np.r_[np.repeat(touched, self.k), line], np.r_[self.sim[into].ravel(), new], np.r_[self.id[into].ravel(), to]
        order = np.lexsort((to, -new, line))
        best = order[np.searchsorted(line[order], touched)[:, None] + np.arange(self.k)]
        self.sim[into], self.id[into] = new[best], to[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, sim)."""
        there = np.isfinite(self.sim)
        return np.repeat(self.own, there.sum(axis=1)), self.id[there], self.sim[there]


def _single(e: np.ndarray) -> np.ndarray | None:
    return e.astype(np.float32) if float((e * e).sum(axis=1).max(initial=0)) < SINGLE_NORM**2 else None


def _best(k: int) -> Callable[..., Iterator[tuple[np.ndarray, ...]]]:
    """The k most similar of one block for each of another."""

    def best(ids, a, others, b):
        single = _single(b)
        for lo in range(0, len(ids), ROWS_AT_ONCE):
            top = Top(ids[lo : lo + ROWS_AT_ONCE], a[lo : lo + ROWS_AT_ONCE], k)
            every = np.arange(len(top.own))
            for at in range(0, len(others), COLUMNS_AT_ONCE):
                some = slice(at, at + COLUMNS_AT_ONCE)
                top.add(every, others[some], b[some], None if single is None else single[some])
            yield top.found()

    return best


def _best_of_lists(k: int, centers: np.ndarray, probes: int) -> Callable[..., Iterator[tuple[np.ndarray, ...]]]:
    """The k most similar of one block for each of another, among the rows of the probes lists whose centers are nearest."""

    def best(ids, a, others, b):
        held = np.concatenate([(b[at : at + COLUMNS_AT_ONCE] @ centers.T).argmax(axis=1) for at in range(0, len(b), COLUMNS_AT_ONCE)])
        by = np.argsort(held, kind="stable")  # list by list, in rising ids
        ends = np.searchsorted(held[by], np.arange(len(centers) + 1))
        others, b = others[by], b[by]
        single = _single(b)
        for lo in range(0, len(ids), 8 * ROWS_AT_ONCE):
            top = Top(ids[lo : lo + 8 * ROWS_AT_ONCE], a[lo : lo + 8 * ROWS_AT_ONCE], k)
            asked = np.zeros((len(top.own), len(centers)), bool)
            np.put_along_axis(asked, np.argsort(-(top.e @ centers.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            for one in range(len(centers)):
                asking = np.flatnonzero(asked[:, one])
                for at in range(ends[one], ends[one + 1], COLUMNS_AT_ONCE):
                    some = slice(at, min(at + COLUMNS_AT_ONCE, ends[one + 1]))
                    top.add(asking, others[some], b[some], None if single is None else single[some])
            yield top.found()

    return best


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def fitted_lists(x: np.ndarray, rows: int, k: int, recall: float, turns: int = 8, asked: int = 1024) -> tuple[np.ndarray, int]:
    """Centers of lists by k-means on the sample x, and how many lists a search must read.

    rows is how many the index will hold: their root is how many lists there are, at most one to
    sixteen of the sample. Up to asked rows of the sample look for their k nearest among all of it; the
    fewest lists that hold that share of what they should find are read. The nearest of a sample are
    farther off than those of the whole table, so the share is rather too low than too high.
    """
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    centers = unit[: max(1, min(int(rows**0.5), len(x) // 16))].copy()
    for _ in range(turns):
        own = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, unit)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    own = (unit @ centers.T).argmax(axis=1)
    q = x[:asked]
    sim = q @ x.T
    sim[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(q @ centers.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel())
    return centers, int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def nearest_by_index(vectors: DataFrame, k: int = 8, recall: float = 0.95, sample: int = 8192, block: int | None = None, seed: int = SEED) -> DataFrame:
    """(src, dst, sim): as nearest, by an index that may miss some; what it finds is exact.

    The index is fitted on at most sample rows, drawn by hash, and holds every row: each in the list of its
    nearest center. Each row is compared with the rows of as many lists as fitted_lists says. Rows meet in
    pairs of blocks, whatever their lists, so that one with a third of all rows is shared by all tasks and
    a vector moves once a block, not once a list that is read.
    Where vectors have no clusters, most lists must be read: then nearest() does the same work at less cost.
    """
    some = vectors.orderBy(seeded(seed, F.col("id")), "id").limit(sample).select("e").toPandas()
    if len(some) < 2:
        return nearest(vectors, k, block)
    centers, probes = fitted_lists(np.stack(some.e.to_numpy()), vectors.count(), k, recall)
    return _first(block_pairs(vectors, vectors, _best_of_lists(k, centers, probes), "src long, dst long, sim double", block), k)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame, distinct: bool = True) -> DataFrame:
    both = edges.select("src", "dst").unionByName(reverse(edges))
    return both.distinct() if distinct else both


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbors): sorted, each once, both directions."""
    return symmetrize(edges).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def adjacency_directed(edges: DataFrame) -> DataFrame:
    """(id, neighbors): as stored, duplicates kept."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node, zeros too."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("out_degree", "in_degree")))


def row_pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, ptr): where each node's edges begin when sorted by source."""
    d = degree(nodes, edges).select("id", F.col("out_degree").alias("degree"))
    return with_running_sum(d, "degree", "id", name="ptr")


# -- lookups --------------------------------------------------------------------------------


def neighbors_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    return ids.select("id").join(edges, F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbor"))


def neighbors_in_pairs(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neighbours when each undirected edge is stored once: two equi joins, not one on either end."""
    return neighbors_of(ids, pairs).unionByName(neighbors_of(ids, reverse(pairs))).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    a, b = (ids.select(F.col("id").alias(c)).distinct() for c in ("src", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ids replaced by their rank among ids, from 0."""
    rank = with_index(ids.select("id").distinct(), "id", name="rank")
    a, b = rank.select(F.col("id").alias("src"), F.col("rank").alias("s")), rank.select(F.col("id").alias("dst"), F.col("rank").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def within_blocks(edges: DataFrame, size: int) -> DataFrame:
    """(block, src, dst): edges that do not leave their block of ids."""
    return edges.select(F.floor(F.col("src") / size).alias("block"), "src", "dst").where(F.col("block") == F.floor(F.col("dst") / size))


def without_links(edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges less the links (a, b), whichever way round."""
    held = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return edges.join(held, (F.least("src", "dst") == F.col("lo")) & (F.greatest("src", "dst") == F.col("hi")), "left_anti")


def endpoints(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("id")).distinct()


# -- motifs ---------------------------------------------------------------------------------


def walks2(edges: DataFrame) -> DataFrame:
    """Distinct ends of walks of two edges."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct()


def _closed_edges(e: DataFrame) -> DataFrame:
    """Edges that a walk of two closes: those of a triangle whose two other edges run the right way, and those that a loop closes."""
    t = _closed(stash(oriented(e), "oriented"))
    ways = [F.struct(F.col(x).alias("src"), F.col(m).alias("mid"), F.col(y).alias("dst")) for x, m, y in itertools.permutations("uvw")]
    way = t.select(F.explode(F.array(*ways)).alias("t")).select("t.*")
    for x, y in (("src", "dst"), ("src", "mid"), ("mid", "dst")):
        way = way.join(e.select(F.col("src").alias(x), F.col("dst").alias(y)), [x, y], "left_semi")
    loops = e.where("src = dst").select(F.col("src").alias("at"))
    open_ = e.where("src <> dst")
    beside = open_.join(loops, F.col("src") == F.col("at"), "left_semi").unionByName(open_.join(loops, F.col("dst") == F.col("at"), "left_semi"))
    # A loop closes itself.
    return way.select("src", "dst").unionByName(beside).unionByName(e.where("src = dst")).distinct()


def motif(edges: DataFrame, name: str) -> DataFrame:
    """Walk dialect: edge keeps duplicates; triangle and 4-cycle are edges that a walk of two or three closes; 4-clique are ends of both a walk of two and of three, adjacent or not."""
    if name == "edge":
        return edges.select("src", "dst")
    e = edges.select("src", "dst").distinct()
    into = e.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    if name == "triangle":
        return _closed_edges(e)
    two = walks2(e)
    if name == "4-cycle":
        before = e.select(F.col("src").alias("mid"), F.col("dst").alias("d"))
        wide = e.join(before, F.col("dst") == F.col("d")).drop("d")
        reach = two.select(F.col("src").alias("s"), F.col("dst").alias("m"))
        return wide.join(reach, (F.col("src") == F.col("s")) & (F.col("mid") == F.col("m")), "left_semi").select("src", "dst").distinct()
    if name == "4-clique":
        three = two.join(into, two["dst"] == into["mid"]).select("src", F.col("end").alias("dst")).distinct()
        return two.join(three, ["src", "dst"], "left_semi")
    raise ValueError(name)


def oriented(edges: DataFrame) -> DataFrame:
    """(lo, hi, hi_degree): each undirected edge once, from its end of lower degree to the other, ties by id; loops out.

    No node has more than the root of twice the edges above it, whatever its degree: a hub's
    leaves point to it, and it points to none of them.
    """
    both = symmetrize(edges).where("src <> dst")
    d = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    a, b = d.toDF("src", "d1"), d.toDF("dst", "d2")
    ranked = both.join(a, "src").join(b, "dst")
    return ranked.where("d1 < d2 or (d1 = d2 and src < dst)").select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.col("d2").alias("hi_degree"))


def _closed(e: DataFrame) -> DataFrame:
    """(u, v, w): the triangles of oriented edges, u the lowest, w the highest."""
    uv, vw, uw = (e.select(F.col("lo").alias(x), F.col("hi").alias(y)) for x, y in ("uv", "vw", "uw"))
    # Both edges out of u: as many wedges as its edges upward, squared.
    above = uv.join(uw, "u").where("v <> w")
    return above.join(vw, ["v", "w"], "left_semi").select("u", "v", "w")


def _named(df: DataFrame, *by: str) -> DataFrame:
    """Members in rising order, as a, b, c and so on."""
    order = F.array_sort(F.array(*by))
    return df.select(*(F.get(order, F.lit(i)).alias("abcd"[i]) for i in range(len(by))))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, each once."""
    return _named(_closed(stash(oriented(edges), "oriented")), "u", "v", "w")


def cliques4(edges: DataFrame) -> DataFrame:
    """(a, b, c, d), a < b < c < d, each once."""
    e = stash(oriented(edges), "oriented")
    ux, vx, wx = (e.select(F.col("lo").alias(x), F.col("hi").alias("x")) for x in "uvw")
    return _named(_closed(e).join(wx, "w").join(ux, ["u", "x"], "left_semi").join(vx, ["v", "x"], "left_semi"), "u", "v", "w", "x")


def cycles4(edges: DataFrame) -> DataFrame:
    """(a, b, c, d): the simple cycles a-b-c-d, each once, a its least id and b < d; chords do not matter.

    A cycle is found at its highest node v in the order of degree and id: two walks v-m-w over lower
    nodes only. A hub's leaves have no lower neighbour, so that it makes no walks of them.
    """
    e = stash(oriented(edges), "oriented")
    down = e.select(F.col("hi").alias("v"), F.col("lo").alias("m"), F.col("hi_degree").alias("v_degree"))
    d = e.select("hi", "hi_degree").distinct().toDF("w", "w_degree")
    every = e.select("lo", "hi").unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    onward = every.select(F.col("lo").alias("m"), F.col("hi").alias("w"))
    # Of w's degree only those above some node are known; without it, w has a degree below v's or is no end of two walks.
    walks = down.join(onward, "m").join(d, "w", "left").where("w <> v and (w_degree is null or w_degree < v_degree or (w_degree = v_degree and w < v))")
    walks = stash(walks.select("v", "w", "m"), "walks")
    x, y = walks.withColumnRenamed("m", "m1"), walks.withColumnRenamed("m", "m2")
    met = x.join(y, ["v", "w"]).where("m1 < m2")
    least = F.least("v", "w", "m1")
    ends = F.col("m1") == least  # of the two in the middle, m1 is the lower
    near = lambda p, q: (F.least(p, q), F.greatest(p, q))
    b1, d1 = near("v", "w")
    across = F.when(ends, F.col("m2")).otherwise(F.greatest("v", "w"))
    return met.select(least.alias("a"), F.when(ends, b1).otherwise(F.col("m1")).alias("b"), across.alias("c"), F.when(ends, d1).otherwise(F.col("m2")).alias("d"))


def member_pairs(instances: DataFrame) -> DataFrame:
    """All ordered pairs of different members of each instance; pairs of several instances repeat."""
    names = instances.columns
    pairs = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x in names for y in names if x != y]
    return instances.select(F.explode(F.array(*pairs)).alias("p")).select("p.src", "p.dst")


def merged(nodes: DataFrame, motifs: list[DataFrame]) -> DataFrame:
    """(id, neighbors) over all motifs' edges, both ways, for every node."""
    every = motifs[0].select("src", "dst")
    for m in motifs[1:]:
        every = every.unionByName(m.select("src", "dst"))
    return nodes.select("id").join(adjacency(every), "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


# -- sampling -------------------------------------------------------------------------------


def sample_nodes(nodes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    return nodes.select("id").orderBy(seeded(seed, F.col("id")), "id").limit(k)


def capped_neighbors(edges: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """(id, neighbor, rank): at most k of each node's neighbours, in hash order."""
    w = Window.partitionBy("src").orderBy(seeded(seed, F.col("dst")), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "rank")


def breadth_first(nodes: DataFrame, edges: DataFrame, n_seeds: int, cap: int, levels: int, seed: int = SEED) -> DataFrame:
    """(id, level): seeds, then level by level what is new, until cap nodes; the last level in hash order."""
    reached = sample_nodes(nodes, min(n_seeds, cap), seed).withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        reached = stash(reached, "reached")
        left = cap - reached.count()
        if left <= 0:
            break
        front = reached.where(F.col("level") == level - 1).select("id")
        new = neighbors_of(front, edges).select(F.col("neighbor").alias("id")).distinct().join(reached, "id", "left_anti")
        new = new.orderBy(seeded(seed, F.col("id")), "id").limit(left).withColumn("level", F.lit(level))
        reached = reached.unionByName(new)
    return reached


def random_walks(starts: DataFrame, edges: DataFrame, steps: int, seed: int = SEED) -> DataFrame:
    """(walk, step, id): from each start, the neighbour least by a hash of walk, step and id; walks may end."""
    here = starts.select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id")
    out = here
    for step in range(1, steps + 1):
        nxt = here.join(edges, F.col("id") == F.col("src")).groupBy("walk").agg(F.min(F.struct(seeded(seed, F.col("walk"), F.lit(step), F.col("dst")).alias("h"), F.col("dst").alias("d"))).alias("m"))
        here = stash(nxt.select("walk", F.lit(step).alias("step"), F.col("m.d").alias("id")), "walk")
        out = out.unionByName(here)
    return out


def hop_tree(nodes: DataFrame, edges: DataFrame, hops: int, width: int, seed: int = SEED, avoid: int | None = None, pad: int = -500) -> DataFrame:
    """(id, pos, node): the fixed-shape tree of neighbours, breadth first; what lacks is pad. avoid is left out of the first hop."""
    here = nodes.select("id", F.lit(0).cast("long").alias("slot"), F.col("id").alias("node"))
    out, first = here.select("id", F.col("slot").alias("pos"), "node"), 1
    for hop in range(1, hops + 1):
        usable = edges if avoid is None or hop > 1 else edges.where(F.col("dst") != avoid)
        some = capped_neighbors(usable, width, seed).select(F.col("id").alias("at"), "neighbor", F.col("rank").alias("r"))
        slots = here.select("id", "slot", "node", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("r"))
        here = slots.join(some.withColumnRenamed("at", "node"), ["node", "r"], "left").select("id", (F.col("slot") * width + F.col("r") - 1).alias("slot"), F.coalesce("neighbor", F.lit(pad).cast("long")).alias("node"))
        here = stash(here, "hop")
        out = out.unionByName(here.select("id", (F.col("slot") + first).alias("pos"), "node"))
        first += width**hop
    return out


def edge_dropout(edges: DataFrame, p: float, seed: int = SEED) -> DataFrame:
    """Edges whose hash falls above p: each goes with probability p, whatever the partitioning."""
    return edges.where(F.conv(F.substring(seeded(seed, F.col("src"), F.col("dst")), 1, 8), 16, 10).cast("double") >= p * 2**32)


def dropped_features(size: int, p: float, seed: int = SEED) -> list[bool]:
    """Which columns go, for all rows alike."""
    import hashlib

    return [int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16) < p * 2**32 for i in range(size)]


def feature_dropout(v: Column, size: int, p: float, seed: int = SEED) -> Column:
    gone = F.array(*(F.lit(x) for x in dropped_features(size, p, seed)))
    return F.transform(v, lambda x, i: F.when(F.get(gone, i), F.lit(0.0)).otherwise(x))


# -- propagation ----------------------------------------------------------------------------


#: Bytes of the vectors of one block, and edges of one cell, about.
BLOCK_BYTES, CELL_EDGES = 64 << 20, 4 << 20
#: Edges whose vectors are looked up at once in a cell.
EDGES_AT_ONCE = 1 << 15


def _cell_sums(size: int):
    """Of a cell's edges (src, dst, w) and the vectors of their sources: w times the vector, summed by dst."""

    def work(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = vectors.column("id").to_numpy()
        e = vectors.column("e").combine_chunks().flatten().to_numpy().reshape(-1, size)
        by = np.argsort(ids, kind="stable")
        src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
        at = np.searchsorted(ids[by], src)
        there = np.flatnonzero(ids[by][np.minimum(at, len(ids) - 1)] == src) if len(ids) else np.zeros(0, np.int64)
        there = there[np.lexsort((src[there], dst[there]))]
        to, slot = np.unique(dst[there], return_inverse=True)
        out = np.zeros((len(to), size))
        for a in range(0, len(there), EDGES_AT_ONCE):
            some = there[a : a + EDGES_AT_ONCE]
            own = slot[a : a + EDGES_AT_ONCE]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[first]] += np.add.reduceat(e[by[at[some]]] * w[some, None], first, axis=0)
        offsets = pa.array(np.arange(0, out.size + 1, size, dtype=np.int32))
        return pa.table({"id": pa.array(to.astype(np.int64)), "e": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

    return work


class EdgeBlocks:
    """Weighted edges (src, dst, w) cut into a grid of cells, by a block of their source and one of their target.

    A product with vectors sends each vector to the cells of its block that have edges of it, side
    of them at most, and each cell sends one sum a target: 2 * side vectors a node, whatever the
    degrees are. For several products, edges are dealt out once and stay (kept); for one they go
    to their cells on the way. side grows with the vectors' bytes and with the root of the edges, so
    that a cell fits a task; a hub's edges are spread over a row or column of cells.
    """

    def __init__(self, edges: DataFrame, n: int, size: int, side: int | None = None, kept: bool = True):
        self.spark, self.size, self.table = edges.sparkSession, size, None
        if side is None:
            width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            side = max(int(width**0.5), -(-n * size * 8 // BLOCK_BYTES), int((edges.count() / CELL_EDGES) ** 0.5) + 1, 1)
        self.side = side
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
        cell = (block("src") * side + block("dst")).alias("cell")
        self.cells = edges.select(cell, "src", "dst", "w")
        ports = edges.select(F.col("src").alias("id"), cell).groupBy("id").agg(F.collect_set("cell").alias("cells"))
        if kept:
            once = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
            self.table, self.cells = bucketed(once.select(cell, "src", "dst", "w"), "cell", side * side, "cells")
            ports = stash(ports, "ports")
        self.ports = ports

    def sent(self, vectors: DataFrame) -> DataFrame:
        """(cell, id, e): the vectors that move."""
        return vectors.select("id", "e").join(self.ports, "id").select(F.explode("cells").alias("cell"), "id", "e")

    def sums(self, vectors: DataFrame, name: str = "e") -> DataFrame:
        """(id, name): for each target, its sources' vectors times w, summed; targets without any are left out."""
        both = self.cells.groupBy("cell").cogroup(self.sent(vectors).groupBy("cell"))
        part = both.applyInArrow(_cell_sums(self.size), "id long, e array<double>")
        return group_sums(part, ["id"], self.size, F.sum, name=name)

    def __enter__(self) -> EdgeBlocks:
        return self

    def __exit__(self, *_) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def neighbor_mean(vectors: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(id, e): the mean of the vectors of each node's neighbours; nodes without any are left out. An edge that is repeated counts as often."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    counted = vectors.select("id", F.concat("e", F.array(F.lit(1.0))).alias("e"))  # the last element sums up to how many there are
    sums = EdgeBlocks(back, vectors.count(), size + 1, kept=False).sums(counted)
    return sums.select("id", F.transform(F.slice("e", 1, size), lambda x: x / F.get("e", F.lit(size))).alias("e"))


def propagate(vectors: DataFrame, edges: DataFrame, size: int, hops: int = 4, to: DataFrame | None = None) -> DataFrame:
    """(id, hop, e): x, then D^-1/2 A D^-1/2 x, again and again; to restricts the last hop's ids. Degrees count incoming edges; none gives zeros."""
    into = edges.groupBy(F.col("dst").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    scale = into.select("n", (1 / F.sqrt("d")).alias("s"))
    a, b = scale.toDF("src", "s1"), scale.toDF("dst", "s2")
    weighted = edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("s1") * F.col("s2")).alias("w"))
    n = vectors.count()
    here = vectors.select("id", "e")
    out = here.withColumn("hop", F.lit(0))
    zero = F.array_repeat(F.lit(0.0), size)

    def hopped(blocks: EdgeBlocks, ids: DataFrame) -> DataFrame:
        return stash(ids.join(blocks.sums(here, "n"), "id", "left").select("id", F.coalesce("n", zero).alias("e")), "hop")

    every = hops - (to is not None)
    if every > 0:
        with EdgeBlocks(weighted, n, size) as blocks:
            for hop in range(1, every + 1):
                here = hopped(blocks, vectors.select("id"))
                out = out.unionByName(here.withColumn("hop", F.lit(hop)))
    if to is not None and hops > 0:
        use = weighted.join(to.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
        last = hopped(EdgeBlocks(use, n, size, kept=False), vectors.select("id").join(to.select("id"), "id", "left_semi"))
        out = out.unionByName(last.withColumn("hop", F.lit(hops)))
    return out


def tree_edges(hops: int, width: int) -> list[tuple[int, int]]:
    """(parent, child) of the complete tree, breadth first."""
    return [((child - 1) // width, child) for child in range(1, sum(width**k for k in range(hops + 1)))]


def tree_laplacian(hops: int, width: int) -> np.ndarray:
    """Identity less the child-to-parent matrix; its size follows from the two numbers alone."""
    n = sum(width**k for k in range(hops + 1))
    m = np.eye(n)
    for parent, child in tree_edges(hops, width):
        m[child, parent] -= 1
    return m


def own_laplacian(trees: DataFrame, hops: int, width: int, pad: int = -500) -> DataFrame:
    """(id, row, col, val) of (id, pos, node): the Laplacian of each node's own tree, whose pads are left out."""
    filled = trees.where(F.col("node") != pad).select("id", F.col("pos").alias("row"))
    m = tree_laplacian(hops, width)
    every = [F.struct(F.lit(int(i)).cast("long").alias("row"), F.lit(int(j)).cast("long").alias("col"), F.lit(float(m[i, j])).alias("val")) for i, j in zip(*np.nonzero(m))]
    cells = trees.sparkSession.range(1).select(F.explode(F.array(*every)).alias("c")).select("c.*")  # as large as the tree's shape says
    # A child that is there has its parent there.
    return filled.join(F.broadcast(cells), "row").select("id", "row", "col", "val")


def encoded_positions(trees: DataFrame, encoding: np.ndarray, pad: int = -500) -> DataFrame:
    """(id, pos, node, e) of (id, pos, node): each place of each tree with its row of encoding; pads are left out."""
    rows = [F.struct(F.lit(i).cast("long").alias("pos"), F.array(*(F.lit(float(x)) for x in row)).alias("e")) for i, row in enumerate(encoding)]
    table = trees.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    return trees.where(F.col("node") != pad).join(F.broadcast(table), "pos").select("id", "pos", "node", "e")


def tree_encoding(hops: int, width: int) -> np.ndarray:
    """Eigenvectors of tree_laplacian, one a column. Its only eigenvalue is 1, so columns may be multiples of one another."""
    return np.real(np.linalg.eig(tree_laplacian(hops, width))[1])


def positions(vectors: DataFrame, *keep: str) -> DataFrame:
    """One row an element: keep, pos, val."""
    return vectors.select(*keep, F.posexplode("e").alias("pos", "val"))


#: Bytes of vectors that are broadcast at most.
GATHER_BYTES = 64 << 20


def gathered(requests: DataFrame, vectors: DataFrame, most: int = GATHER_BYTES, on: tuple[str, ...] = ("id",)) -> DataFrame:
    """requests(key, pos, id) with each id's vector e; vectors are broadcast up to most bytes, counted beforehand, beyond that both sides shuffle.

    on names what tells a vector, where an id alone does not: ("dataset", "id").
    """
    n, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    few = n * 8 * ((size or 0) + len(on)) <= most
    return requests.join(F.broadcast(vectors) if few else vectors, list(on), "left")
