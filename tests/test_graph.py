"""Hand-made graphs, and properties that hold on any graph."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.operators import context as C
from loomgraph.operators import graph as G
from loomgraph.operators.neural import mean_vector
from loomgraph.operators.order import with_index, with_running_sum
from loomgraph.sources import tables


def both(pairs):
    pairs = list(pairs)
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


GRAPHS = {
    "path": both([(0, 1), (1, 2), (2, 3)]),
    "triangle": both([(0, 1), (1, 2), (0, 2)]),
    "k4": both(itertools.combinations(range(4), 2)),
    "c4": both([(0, 1), (1, 2), (2, 3), (3, 0)]),
    "star": both([(0, i) for i in range(1, 13)]),
    "parts": both([(0, 1), (5, 6), (6, 7), (5, 7)]),
}


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


@pytest.mark.parametrize("name,tri,k4,c4", [("path", 0, 0, 0), ("triangle", 1, 0, 0), ("k4", 4, 1, 3), ("c4", 0, 0, 1), ("star", 0, 0, 0), ("parts", 1, 0, 0)])
def test_exact_motifs(spark, name, tri, k4, c4):
    e = table(spark, GRAPHS[name])
    assert (G.triangles(e).count(), G.cliques4(e).count(), G.cycles4(e).count()) == (tri, k4, c4)
    assert G.member_pairs(G.triangles(e)).count() == 6 * tri


@pytest.mark.parametrize("name", GRAPHS)
def test_walk_motifs(spark, name):
    e = GRAPHS[name]
    two = {(a, d) for a, b in e for c, d in e if b == c}
    three = {(a, d) for a, b in two for c, d in e if b == c}
    df = table(spark, e)
    assert pairs(G.motif(df, "triangle")) == sorted(set(e) & two)
    assert pairs(G.motif(df, "4-cycle")) == sorted(set(e) & three) == sorted(e)
    assert pairs(G.motif(df, "4-clique")) == sorted(two & three)
    assert pairs(G.motif(df, "edge")) == e


def test_directed_walk_motifs_and_loops(spark):
    e = [(0, 1), (1, 2), (0, 2), (3, 3), (2, 4), (0, 1)]
    df = table(spark, e)
    assert pairs(G.motif(df, "triangle")) == [(0, 2), (3, 3)]
    assert pairs(G.motif(df, "edge")) == sorted(e)
    assert G.triangles(df).count() == 1


def test_degrees_pointers_and_merging(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    e = table(spark, [(0, 1), (0, 1), (2, 0), (5, 5)])
    assert sorted(map(tuple, G.degree(nodes, e).collect())) == [(0, 2, 1), (1, 0, 2), (2, 1, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1)]
    assert sorted(map(tuple, G.row_pointers(nodes, e).collect())) == [(0, 2, 0), (1, 0, 2), (2, 1, 2), (3, 0, 3), (4, 0, 3), (5, 1, 3)]
    merged = {r.id: r.neighbors for r in G.merged(nodes, [e, table(spark, [(3, 4)])]).collect()}
    assert merged == {0: [1, 2], 1: [0], 2: [0], 3: [4], 4: [3], 5: [5]}
    assert G.adjacency(table(spark, [])).collect() == []


def test_held_out_links_go_both_ways(spark):
    links = spark.createDataFrame([(2, 1), (0, 9)], "a long, b long")
    assert pairs(G.without_links(table(spark, GRAPHS["path"]), links)) == [(0, 1), (1, 0), (2, 3), (3, 2)]
    assert sorted(r.id for r in G.endpoints(links).collect()) == [0, 1, 2, 9]


def test_row_numbers_over_partitions(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert sorted((r["v"], r["index"]) for r in with_index(df, "v").collect()) == [(i, i) for i in range(1000)]
    got = {r.v: r.running for r in with_running_sum(df, "v", "v").collect()}
    assert got == {i: i * (i - 1) // 2 for i in range(1000)}
    assert with_index(df.limit(0), "v").collect() == []


def test_nearest_is_the_same_in_any_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, [0.0] * 5)]
    v = spark.createDataFrame(rows, "id long, e array<double>")
    want = set()
    for i, a in rows:
        sims = sorted((-round(sum(x * y for x, y in zip(a, b)), 6) + 0.0, j) for j, b in rows if j != i)
        want |= {(i, j) for _, j in sims[:4]}
    for block in (4096, 13):
        assert {(r.src, r.dst) for r in G.nearest(v, 4, block).collect()} == want


@pytest.mark.parametrize("kind", ["clusters", "copies", "given"])
def test_index_finds_nine_in_ten(spark, data, kind):
    rng = np.random.default_rng(4)
    if kind == "given":
        v = tables.vectors(spark, data)
    else:
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16))
        if kind == "copies":  # a third of all rows in one list
            x[:300] = x[0]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")
    found = G.nearest_by_index(v, 8, sample=400, block=100).collect()
    worst = {}
    for r in G.nearest(v, 8).collect():
        worst.setdefault(r.src, []).append(r.sim)
    n = v.count()
    assert len({(r.src, r.dst) for r in found}) == len(found) and all(r.src != r.dst for r in found)
    assert sum(r.sim >= min(worst[r.src]) for r in found) >= 0.9 * 8 * n and {r.src for r in found} == set(worst)
    assert G.nearest_by_index(v.limit(1), 8).collect() == [] == G.nearest_by_index(v.limit(0), 8).collect()


def test_hop_tree_pads_and_avoids(spark):
    nodes = spark.createDataFrame([(0,), (3,), (99,)], "id long")
    got = {}
    for r in G.hop_tree(nodes, table(spark, GRAPHS["path"]), 2, 2, avoid=1).collect():
        got.setdefault(r.id, {})[r.pos] = r.node
    assert got[0] == {0: 0, **{i: -500 for i in range(1, 7)}}
    assert got[99] == {0: 99, **{i: -500 for i in range(1, 7)}}
    assert [got[3][i] for i in (0, 1, 2, 5, 6)] == [3, 2, -500, -500, -500] and {got[3][3], got[3][4]} == {1, 3}


def test_sampling_is_capped_and_connected(spark):
    e = table(spark, GRAPHS["star"])
    nodes = spark.createDataFrame([(i,) for i in range(13)], "id long")
    assert G.capped_neighbors(e, 9).where("id = 0").count() == 9
    got = G.breadth_first(nodes, e, 1, 8, 4).collect()
    assert len(got) == 8 and len({r.id for r in got}) == 8
    steps = {(r.walk, r.step): r.id for r in G.random_walks(nodes.limit(3), e, 4).collect()}
    assert all((steps[w, s - 1], i) in GRAPHS["star"] for (w, s), i in steps.items() if s)


def test_propagation_of_an_isolated_node_is_zero(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, e array<double>")
    got = {(r.hop, r.id): r.e for r in G.propagate(v, table(spark, GRAPHS["path"]), 2, 2).collect()}
    assert got[1, 4] == [0.0, 0.0] and got[1, 0] == pytest.approx([2**-0.5, 2**-0.5])


def test_walks_agree_do_not_return_and_fill_111_slots(spark):
    rng = random.Random(3)
    edges = both({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)})
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(41)], "id long, e array<double>")
    e, centers = table(spark, edges), v.select("id").where("id % 4 = 0")
    starts, coh = C.start_neighbors(centers, e), C.coherence(v, e)
    options = {"beta": 0.55, "threshold": 0.03, "steps": 10, "cap": None, "eps": 1e-10, "seed": 42}
    plans = [sorted(map(tuple, f(starts, e, v, coh, **options).collect())) for f in (C.walks_by_joins, C.walks_by_broadcast)]
    assert plans[0] == plans[1]
    capped = [sorted(map(tuple, f(starts, e, v, coh, **options | {"cap": 5, "threshold": 0.0}).collect())) for f in (C.walks_by_joins, C.walks_by_broadcast)]
    assert capped[0] == capped[1]
    by = {}
    for center, walk, _, node in plans[0]:
        by.setdefault((center, walk), []).append(node)
    assert all(len(set(w)) == len(w) <= 10 for w in by.values())
    for r in C.sequences(centers, starts, C.walks(starts, e, v, coh)).collect():
        assert len(r.graph) == 111 and r.graph[0] == r.center and r.graph[10] == -500 and set(r.graph[-10:]) == {-500}
    assert {r.center: r.graph for r in C.sequences(centers.where("id = 40"), starts.limit(0), C.walks(starts.limit(0), e, v, coh)).collect()} == {40: [40] + [-500] * 110}


def test_long_vectors_are_summed_in_stretches(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(40, 4096))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(e)], "id long, e array<double>")
    ring = [(i, (i + k) % 40) for i in range(40) for k in (1, 2, 39, 38)]
    near = {r.id: np.array(r.e) for r in G.neighbor_mean(v, table(spark, ring), 4096).collect()}
    for i in range(40):
        assert np.allclose(near[i], e[[d for s, d in ring if s == i]].mean(axis=0))
    hop = {r.id: np.array(r.e) for r in G.propagate(v, table(spark, ring), 4096, 1).where("hop = 1").collect()}
    assert all(np.allclose(hop[i], e[[d for s, d in ring if s == i]].sum(axis=0) / 4) for i in range(40))
    odd = spark.createDataFrame([(1, [float(x) for x in range(100)]), (2, [1.0] * 100)], "id long, e array<double>")
    (mean,) = mean_vector(odd, 100).collect()
    assert mean.e == [(x + 1) / 2 for x in range(100)]


def test_tree_encoding_solves_the_tree():
    m, v = G.tree_laplacian(2, 3), G.tree_encoding(2, 3)
    assert np.allclose(m @ v, v, atol=1e-6) and np.allclose(np.linalg.norm(v, axis=0), 1)
    assert G.tree_encoding(0, 4).tolist() == [[1.0]]


def exchanges(df):
    """What each exchange of the executed plan carries, by the plan's own listing."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    shown = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan, [m[1] for m in re.finditer(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", shown)]


def test_vectors_stay_where_they_lie(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(30)], "id long, e array<double>")
    coh = v.select("id", C.F.lit(0.25).alias("coh"))
    asked = spark.createDataFrame([(a, w, b) for a in range(30) for w in range(2) for b in (a, (a * 7 + w) % 30)], "center long, walk int, id long")
    with C.VectorGrid(v, coh, 3) as grid:
        df = grid.scored(asked, 0.5)
        plan, carried = exchanges(df)
        assert len(carried) == 1 and "ea#" not in carried[0] and "eb#" not in carried[0], plan
        got = {(r.center, r.id): r.x for r in df.collect()}
    e = {r.id: np.array(r.e) for r in v.collect()}
    for (a, b), x in got.items():
        assert x == pytest.approx(0.125 + 0.5 * max(0.0, e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b])), abs=2e-6)
    assert len(got) == len({(r.center, r.id) for r in asked.collect()})


def test_pairs_are_scored_without_sorting_vectors(spark):
    """A cell's pairs meet its vectors as a group; pairs without both vectors are left out, a missing coherence is none."""
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, e array<double>")
    asked = spark.createDataFrame([(0, 3, 2), (0, 3, 2), (1, 0, 9), (8, 0, 1), (5, 1, 5)], "center long, walk int, id long")
    with C.VectorGrid(v, v.where("id = 5").select("id", C.F.lit(0.5).alias("coh")), 2) as grid:
        df = grid.scored(asked, 0.5)
        assert sorted(map(tuple, df.collect())) == [(0, 3, 2, 0.223607), (0, 3, 2, 0.223607), (5, 1, 5, 0.75)]
        plan, _ = exchanges(df)
    assert "Join" not in plan, plan


def test_a_walks_front_stays_with_it(spark, monkeypatch):
    """A step asks for the neighbours of the nodes just reached and for no other candidate; walks lie in several parts."""
    monkeypatch.setattr(C, "PART_WALKS", 5)
    sent, grouped = [], C.VectorGrid.scored
    monkeypatch.setattr(C.VectorGrid, "scored", lambda self, asked, beta: sent.append(asked.count()) or grouped(self, asked, beta))
    rng = random.Random(8)
    e = table(spark, both({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)}))
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "id long, e array<double>")
    starts, coh = C.start_neighbors(v.select("id"), e), C.coherence(v, e)
    options = {"beta": 0.55, "threshold": 0.1, "steps": 6, "cap": None, "eps": 1e-10, "seed": 42}
    got, want = (sorted(map(tuple, f(starts, e, v, coh, **options).collect())) for f in (C.walks_by_joins, C.walks_by_broadcast))
    assert got == want and len({r[2] for r in got}) > 2
    near = {r.src: r["count"] for r in e.groupBy("src").count().collect()}
    assert sent == [sum(near[n] for _, _, s, n in got if s == step) for step in range(len(sent))]


def test_motifs_of_random_graphs_equal_a_plain_search(spark):
    rng = random.Random(9)
    pairs_ = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(38)} | {(7, i) for i in range(14) if i != 7}
    near = {i: {b for a, b in pairs_ if a == i} | {a for a, b in pairs_ if b == i} for i in range(14)}
    cycles = {(a, b, c, d) for a, b, c, d in itertools.permutations(range(14), 4) if a < c and a < b < d and b in near[a] and c in near[b] and d in near[c] and a in near[d]}
    tri = {t for t in itertools.combinations(range(14), 3) if all(y in near[x] for x, y in itertools.combinations(t, 2))}
    k4 = {t for t in itertools.combinations(range(14), 4) if all(y in near[x] for x, y in itertools.combinations(t, 2))}
    e = table(spark, sorted(pairs_) + [(3, 3)])
    assert sorted(map(tuple, G.cycles4(e).collect())) == sorted(cycles)
    assert sorted(map(tuple, G.triangles(e).collect())) == sorted(tri)
    assert sorted(map(tuple, G.cliques4(e).collect())) == sorted(k4)
    directed = sorted({(a, b) for a, b in itertools.product(range(9), repeat=2) if rng.random() < 0.25})
    two = {(a, d) for a, b in directed for c, d in directed if b == c}
    assert pairs(G.motif(table(spark, directed), "triangle")) == sorted(set(directed) & two)


def test_a_hub_makes_no_wedges(spark):
    """A hub in the middle of the ids, with a hundred thousand leaves and one triangle."""
    hub = 50_000
    e = spark.range(100_001).where(f"id <> {hub}").select(C.F.when(C.F.col("id") % 2 == 0, C.F.lit(hub)).otherwise(C.F.col("id")).alias("src"), C.F.when(C.F.col("id") % 2 == 0, C.F.col("id")).otherwise(C.F.lit(hub)).alias("dst"))
    e = e.unionByName(table(spark, [(1, 2)]))
    up = G.oriented(e)
    assert up.groupBy("lo").count().agg(C.F.max("count")).first()[0] == 2
    assert G.triangles(e).collect() == [(1, 2, hub)] and G.cliques4(e).count() == G.cycles4(e).count() == 0
    assert pairs(G.motif(e.unionByName(G.reverse(e)), "triangle")) == both([(1, 2), (1, hub), (2, hub)])


def test_vectors_are_sent_once_a_block(spark):
    """Twenty times the edges send hardly more vectors: at most side a node. A hub's edges are shared among cells."""
    rng = np.random.default_rng(6)
    n, x = 60, np.random.default_rng(7).normal(size=(60, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")
    for degree in (2, 40):
        list_ = [(i, int(j), float(w)) for i in range(n) for j, w in zip(rng.integers(0, n, degree), rng.normal(size=degree))] + [(0, i, 1.0) for i in range(n)] + [(n + 5, 1, 1.0)]
        with G.EdgeBlocks(spark.createDataFrame(list_, "src long, dst long, w double"), n, 3, side=3) as blocks:
            assert blocks.sent(v).count() <= 3 * n
            cells = {r.cell: r["count"] for r in blocks.cells.where("src = 0").groupBy("cell").count().collect()}
            assert len(cells) == 3 and max(cells.values()) < 0.6 * n
            plan, carried = exchanges(blocks.sums(v))
            assert not any("src" in c for c in carried), plan
            got = {r.id: np.array(r.e) for r in blocks.sums(v).collect()}
        want = {}
        for s, d, w in list_:
            if s < n:
                want[d] = want.get(d, 0) + w * x[s]
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_row_numbers_keep_a_callers_columns(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "b", 2)], "v long, __at string, __part long")
    assert [tuple(r) for r in with_index(df, "v").orderBy("v").collect()] == [(1, "b", 2, 0), (3, "a", 1, 1)]
    assert [tuple(r) for r in with_running_sum(df, "v", "v").orderBy("v").collect()] == [(1, "b", 2, 0), (3, "a", 1, 1)]


def test_a_vector_moves_once_a_block(spark):
    v = spark.range(500).selectExpr("id", "array(double(id), 1D) as e")
    met = G.block_pairs(v, v, lambda ids, a, others, b: iter([(np.array([len(ids)]), np.array([0 if ids is others else len(others)]))]), "a long, b long", block=100, once=True).collect()
    assert len(met) == 15 and sum(r.a + r.b for r in met) == 5 * 500
    both = G.block_pairs(v, v.select("*"), lambda ids, a, others, b: iter([(np.array([len(ids) * len(others)]),)]), "n long", block=100).collect()
    assert len(both) == 25 and sum(r.n for r in both) == 500 * 500


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e12, 1e160])
def test_the_nearest_of_many_copies_and_of_any_size(scale):
    """Copies, ties, opposite and empty vectors, in one block after another, against a whole sort."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)).round(2) * min(scale, 1e150) ** 0.5
    x[100:500], x[500:510], x[510:520] = x[0], 0.0, -x[0]
    ids = np.arange(900) * 3
    sim = np.round(x @ x.T, 6) + 0.0
    np.fill_diagonal(sim, -np.inf)
    want = np.argsort(-sim, axis=1, kind="stable")[:, :7]
    for columns in (5, 64, 1024):
        top = G.Top(ids, x, 7)
        for at in (*range(columns, 900, columns), 0):  # the first ids come last
            top.add(np.arange(900), ids[at : at + columns], x[at : at + columns], G._single(x[at : at + columns]))
        if scale <= 1:
            assert (top.id == ids[want]).all()
        assert np.allclose(top.sim, np.take_along_axis(sim, want, axis=1), rtol=1e-12)
