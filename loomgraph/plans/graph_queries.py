"""Queries on the nearest-neighbour graph of the vectors, each with the SQL that states it again."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine, dot, rounded
from ..operators import context as C
from ..operators import graph as G
from ..operators import neural as N
from ..operators import projectors as J
from ..operators import scoring as S
from ..session import scratch_root, stash, when_cleared
from ..sources import embeddings as D
from ..sources import tables as T
from . import sql as Q
from .registry import query

DIM = 64
_graphs: dict[tuple[str, str], DataFrame] = {}


@when_cleared
def forget(spark: SparkSession) -> None:
    """Graphs whose tables are gone are built again."""
    for key in [k for k in _graphs if k[0] == spark.sparkContext.applicationId]:
        del _graphs[key]


def _state(spark: SparkSession, d: str) -> str:
    """The folder, and when its vectors were written last: a graph of older ones is not used again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/embeddings.parquet")
    file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    return f"{d}@{file.getModificationTime()}:{file.getLen()}"


def knn(spark: SparkSession, d: str) -> DataFrame:
    """The graph's directed top eight, built once a session and state of the folder, and kept as a table."""
    key = (spark.sparkContext.applicationId, _state(spark, d))
    if key not in _graphs:
        _graphs[key] = stash(G.nearest(T.vectors(spark, d), 8), "knn8")
    return _graphs[key]


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.symmetrize(knn(spark, d))


def fixed_edges(spark: SparkSession, d: str) -> DataFrame:
    """edges as a table: for operators that read them often."""
    key = (spark.sparkContext.applicationId, _state(spark, d) + "#edges")
    if key not in _graphs:
        _graphs[key] = stash(edges(spark, d), "edges")
    return _graphs[key]


def ids(spark: SparkSession, d: str) -> DataFrame:
    return T.vectors(spark, d).select("id")


def centers(spark: SparkSession, d: str) -> DataFrame:
    """Every node: sequences are made for all splits."""
    return ids(spark, d)


def elements(df: DataFrame, *keep: str) -> DataFrame:
    return G.positions(df, *keep).withColumn("val", rounded(F.col("val")))


def joined_ids(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# -- sources --------------------------------------------------------------------------------

query("scan_nodes", Q.with_(Q.NODES) + "SELECT id, text, y, split FROM nodes")(T.nodes)


@query("scan_vectors", Q.with_(Q.V) + f"SELECT id, len(e) AS n, {Q.r6('sqrt(list_inner_product(e, e))')} AS norm, {Q.r6('e[1]')} AS first FROM v")
def scan_vectors(spark, d):
    v = T.vectors(spark, d)
    return v.select("id", F.size("e").alias("n"), rounded(F.sqrt(dot(F.col("e"), F.col("e")))).alias("norm"), rounded(F.col("e")[0]).alias("first"))


@query("split_filter", Q.with_(Q.NODES) + "SELECT id, y FROM nodes WHERE split = 'train'")
def split_filter(spark, d):
    return T.nodes(spark, d).where("split = 'train'").select("id", "y")


@query("knn8", Q.with_(Q.V, Q.TOP8) + "SELECT src, dst, sim FROM top8")
def knn8(spark, d):
    return knn(spark, d)


@query("knn8_index")
def knn8_index(spark, d):
    """The same graph by the index; tests measure its recall."""
    return G.nearest_by_index(T.vectors(spark, d), 8)


@query("concat_vectors", Q.with_(*Q.GRAPH, Q.LONG, "m1 AS MATERIALIZED (SELECT src AS id, pos, avg(val) AS val FROM ed JOIN vl ON vl.id = dst GROUP BY 1, 2)") + f"SELECT id, pos, {Q.r6('val')} AS val FROM (SELECT * FROM vl UNION ALL SELECT id, pos + 64, val FROM m1)")
def concat_vectors(spark, d):
    v = T.vectors(spark, d)
    hop1 = G.neighbor_mean(v, fixed_edges(spark, d), DIM).select("id", F.col("e").alias("e1"))
    both = v.join(hop1, "id").select("id", F.concat("e", "e1").alias("e"))
    return elements(both, "id")


# -- structure ------------------------------------------------------------------------------


@query("adjacency", Q.with_(*Q.GRAPH) + "SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors, count(*) AS n FROM ed GROUP BY 1")
def adjacency(spark, d):
    return G.adjacency(knn(spark, d)).select("id", joined_ids("neighbors").alias("neighbors"), F.size("neighbors").alias("n"))


@query("adjacency_directed", Q.with_(Q.V, Q.TOP8) + "SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM top8 GROUP BY 1")
def adjacency_directed(spark, d):
    return G.adjacency_directed(knn(spark, d)).select("id", joined_ids("neighbors").alias("neighbors"))


@query("degree", Q.with_(Q.V, Q.TOP8) + "SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN (SELECT src AS id, count(*) AS n FROM top8 GROUP BY 1) o ON o.id = v.id LEFT JOIN (SELECT dst AS id, count(*) AS n FROM top8 GROUP BY 1) i ON i.id = v.id")
def degree(spark, d):
    return G.degree(ids(spark, d), knn(spark, d))


@query("symmetrize", Q.with_(Q.V, Q.TOP8) + "SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM top8 UNION ALL SELECT dst, src FROM top8) GROUP BY 1, 2")
def symmetrize(spark, d):
    return G.symmetrize(knn(spark, d), distinct=False).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("csr_ptr", Q.with_(*Q.GRAPH, "dg AS (SELECT v.id, count(dst) AS degree FROM v LEFT JOIN ed ON src = v.id GROUP BY 1)") + "SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS ptr FROM dg")
def csr_ptr(spark, d):
    return G.row_pointers(ids(spark, d), fixed_edges(spark, d))


@query("neighbors", Q.with_(*Q.GRAPH) + "SELECT src AS id, dst AS neighbor FROM ed")
def neighbors(spark, d):
    return G.neighbors_of(centers(spark, d), fixed_edges(spark, d))


@query("neighbors_or", Q.with_(*Q.GRAPH) + "SELECT DISTINCT v.id, CASE WHEN src = v.id THEN dst ELSE src END AS neighbor FROM v JOIN (SELECT * FROM ed WHERE src < dst) u ON u.src = v.id OR u.dst = v.id")
def neighbors_or(spark, d):
    return G.neighbors_in_pairs(centers(spark, d), fixed_edges(spark, d).where("src < dst"))


@query("induced_subgraph", Q.with_(*Q.GRAPH) + "SELECT src, dst FROM ed WHERE src % 5 < 3 AND dst % 5 < 3")
def induced_subgraph(spark, d):
    return G.induced(fixed_edges(spark, d), ids(spark, d).where("id % 5 < 3"))


@query("relabel", Q.with_(*Q.GRAPH, "r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v WHERE id % 5 < 3)") + "SELECT a.k AS src, b.k AS dst FROM ed JOIN r a ON a.id = src JOIN r b ON b.id = dst")
def relabel(spark, d):
    return G.relabel(fixed_edges(spark, d), ids(spark, d).where("id % 5 < 3"))


@query("partitioned_edges", Q.with_(*Q.GRAPH, "b AS MATERIALIZED (SELECT (src // 100) AS block, src, dst FROM ed WHERE src // 100 = dst // 100)") + "SELECT block, src, dst, EXISTS (SELECT 1 FROM b x JOIN b y ON x.dst = y.src WHERE x.src = b.src AND y.dst = b.dst) AS in_triangle FROM b")
def partitioned_edges(spark, d):
    blocks = stash(G.within_blocks(fixed_edges(spark, d), 100), "blocks")
    tri = G.motif(blocks.select("src", "dst"), "triangle").withColumn("in_triangle", F.lit(True))
    return blocks.join(tri, ["src", "dst"], "left").select("block", "src", "dst", F.coalesce("in_triangle", F.lit(False)).alias("in_triangle"))


WALK2 = "w2 AS MATERIALIZED (SELECT DISTINCT a.src, b.dst FROM ed a JOIN ed b ON a.dst = b.src)"
WALK3 = "w3 AS MATERIALIZED (SELECT DISTINCT a.src, b.dst FROM w2 a JOIN ed b ON a.dst = b.src)"


@query("motif_triangle", Q.with_(*Q.GRAPH, WALK2) + "SELECT src, dst FROM ed JOIN w2 USING (src, dst)")
def motif_triangle(spark, d):
    return G.motif(fixed_edges(spark, d), "triangle")


@query("motif_4cycle", Q.with_(*Q.GRAPH, WALK2, WALK3) + "SELECT src, dst FROM ed JOIN w3 USING (src, dst)")
def motif_4cycle(spark, d):
    return G.motif(fixed_edges(spark, d), "4-cycle")


@query("motif_4clique", Q.with_(*Q.GRAPH, WALK2, WALK3) + "SELECT src, dst FROM w2 JOIN w3 USING (src, dst)")
def motif_4clique(spark, d):
    return G.motif(fixed_edges(spark, d), "4-clique")


UP = "up AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed WHERE src < dst)"
TRI = "tri AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM up x JOIN up y ON x.b = y.a JOIN up z ON z.a = x.a AND z.b = y.b)"


def _pairs(names: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT {x} AS src, {y} AS dst FROM {table}" for x in names for y in names if x != y)


@query("triangles_exact", Q.with_(*Q.GRAPH, UP, TRI) + f"SELECT src, dst, count(*) AS n FROM ({_pairs('abc', 'tri')}) GROUP BY 1, 2")
def triangles_exact(spark, d):
    return G.member_pairs(G.triangles(fixed_edges(spark, d))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("cliques4_exact", Q.with_(*Q.GRAPH, UP, TRI) + "SELECT t.a, t.b, t.c, x.b AS d FROM tri t JOIN up x ON x.a = t.c JOIN up y ON y.a = t.a AND y.b = x.b JOIN up z ON z.a = t.b AND z.b = x.b")
def cliques4_exact(spark, d):
    return G.cliques4(fixed_edges(spark, d))


@query("cycles4_exact", Q.with_(*Q.GRAPH) + "SELECT w.src AS a, w.dst AS b, x.dst AS c, y.dst AS d FROM ed w JOIN ed x ON x.src = w.dst JOIN ed y ON y.src = x.dst JOIN ed z ON z.src = y.dst AND z.dst = w.src WHERE w.src < w.dst AND w.src < x.dst AND w.src < y.dst AND w.dst < y.dst AND x.dst <> w.dst AND x.dst <> y.dst")
def cycles4_exact(spark, d):
    return G.cycles4(fixed_edges(spark, d))


@query("motif_merge", Q.with_(*Q.GRAPH, WALK2, "m AS (SELECT src, dst FROM ed UNION SELECT src, dst FROM w2), b AS (SELECT src, dst FROM m UNION SELECT dst, src FROM m)") + "SELECT v.id, count(dst) AS n, coalesce(sum(dst), 0)::BIGINT AS total FROM v LEFT JOIN b ON src = v.id GROUP BY 1")
def motif_merge(spark, d):
    e = fixed_edges(spark, d)
    m = G.merged(ids(spark, d), [e, G.walks2(e)])
    return m.select("id", F.size("neighbors").alias("n"), F.aggregate("neighbors", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# -- held-out links, sampling, trees --------------------------------------------------------

HELD = "held AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed WHERE src < dst AND (src + dst) % 10 = 0), le AS MATERIALIZED (SELECT src, dst FROM ed WHERE NOT EXISTS (SELECT 1 FROM held WHERE a = least(src, dst) AND b = greatest(src, dst)))"


def held_links(spark, d):
    return fixed_edges(spark, d).where("src < dst and (src + dst) % 10 = 0").select(F.col("dst").alias("a"), F.col("src").alias("b"))


@query("link_holdout", Q.with_(*Q.GRAPH, HELD, "en AS MATERIALIZED (SELECT a AS id FROM held UNION SELECT b FROM held)") + "SELECT src, dst, src IN (SELECT id FROM en) AS is_end FROM le")
def link_holdout(spark, d):
    links = held_links(spark, d)
    marks = G.endpoints(links).select(F.col("id").alias("src"), F.lit(True).alias("is_end"))
    return G.without_links(fixed_edges(spark, d), links).join(marks, "src", "left").select("src", "dst", F.coalesce("is_end", F.lit(False)).alias("is_end"))


@query("sample_nodes", Q.with_(Q.V) + "SELECT id FROM v ORDER BY md5('42|' || id), id LIMIT 100")
def sample_nodes(spark, d):
    return G.sample_nodes(ids(spark, d), 100)


def _bfs(levels: int, seeds: int, cap: int) -> str:
    out = [f"l0 AS MATERIALIZED (SELECT id, 0 AS level FROM v ORDER BY md5('42|' || id), id LIMIT {seeds})", "r0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k in range(1, levels + 1):
        out += [f"l{k} AS MATERIALIZED (SELECT id, {k} AS level FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS q FROM (SELECT DISTINCT dst AS id FROM l{k - 1} JOIN ed ON src = id) WHERE id NOT IN (SELECT id FROM r{k - 1})) WHERE q <= {cap} - (SELECT count(*) FROM r{k - 1}))", f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM l{k})"]
    return ",\n".join(out)


@query("bfs_sample", Q.with_(*Q.GRAPH, _bfs(4, 5, 150)) + "SELECT id, level FROM r4")
def bfs_sample(spark, d):
    return G.breadth_first(ids(spark, d), fixed_edges(spark, d), 5, 150, 4)


def _random_walk(steps: int) -> str:
    out = ["s0 AS MATERIALIZED (SELECT id AS walk, 0 AS step, id FROM v ORDER BY md5('42|' || id), id LIMIT 20)"]
    out += [f"s{k} AS MATERIALIZED (SELECT walk, {k} AS step, dst AS id FROM (SELECT walk, dst, row_number() OVER (PARTITION BY walk ORDER BY md5('42|' || walk || '|{k}|' || dst), dst) AS q FROM s{k - 1} JOIN ed ON src = id) WHERE q = 1)" for k in range(1, steps + 1)]
    return ",\n".join(out)


@query("random_walk", Q.with_(*Q.GRAPH, _random_walk(5)) + " UNION ALL ".join(f"SELECT walk, step, id FROM s{k}" for k in range(6)))
def random_walk(spark, d):
    return G.random_walks(G.sample_nodes(ids(spark, d), 20), fixed_edges(spark, d), 5)


@query("khop_sequence", Q.with_(*Q.GRAPH, Q.NBR, "h1 AS MATERIALIZED (SELECT v.id, r AS slot, coalesce(dst, -500) AS node FROM v CROSS JOIN range(3) t(r) LEFT JOIN nbr ON src = v.id AND rk = r + 1)", "h2 AS (SELECT h1.id, slot * 3 + r AS slot, coalesce(dst, -500) AS node FROM h1 CROSS JOIN range(3) t(r) LEFT JOIN nbr ON src = node AND rk = r + 1)") + "SELECT id, 0 AS pos, id AS node FROM v UNION ALL SELECT id, 1 + slot, node FROM h1 UNION ALL SELECT id, 4 + slot, node FROM h2")
def khop_sequence(spark, d):
    return G.hop_tree(centers(spark, d), fixed_edges(spark, d), 2, 3)


@query("edge_dropout", Q.with_(*Q.GRAPH) + "SELECT src, dst FROM ed WHERE ('0x' || substr(md5('42|' || src || '|' || dst), 1, 8))::BIGINT >= 0.4::DOUBLE * 4294967296")
def edge_dropout(spark, d):
    return G.edge_dropout(fixed_edges(spark, d), 0.4)


DROPPED = "vd AS MATERIALIZED (SELECT id, pos, CASE WHEN ('0x' || substr(md5('42|' || pos), 1, 8))::BIGINT < 0.3::DOUBLE * 4294967296 THEN 0.0::DOUBLE ELSE val END AS val FROM vl)"


@query("feature_dropout", Q.with_(Q.V, Q.LONG, DROPPED) + f"SELECT id, pos, {Q.r6('val')} AS val FROM vd")
def feature_dropout(spark, d):
    return elements(T.vectors(spark, d).select("id", G.feature_dropout(F.col("e"), DIM, 0.3).alias("e")), "id")


SLOTS = """h1 AS MATERIALIZED (SELECT v.id, rk - 1 AS slot, dst AS node FROM v JOIN nbr ON src = v.id AND rk <= 3),
h2 AS (SELECT h1.id, slot * 3 + rk - 1 AS slot, dst AS node FROM h1 JOIN nbr ON src = node AND rk <= 3),
tr AS MATERIALIZED (SELECT id, 0 AS pos, id AS node FROM v UNION ALL SELECT id, slot + 1, node FROM h1 UNION ALL SELECT id, slot + 4, node FROM h2)"""


def trees(spark, d) -> DataFrame:
    return G.hop_tree(centers(spark, d), fixed_edges(spark, d), 2, 3)


@query("tree_laplacian", Q.with_(*Q.GRAPH, Q.NBR, SLOTS) + "SELECT id, pos AS row, pos AS col, 1.0::DOUBLE AS val FROM tr UNION ALL SELECT id, pos, (pos - 1) // 3, -1.0::DOUBLE FROM tr WHERE pos > 0")
def tree_laplacian(spark, d):
    """Of each node's tree."""
    return G.own_laplacian(trees(spark, d), 2, 3)


@query("tree_eigenvectors")
def tree_eigenvectors(spark, d):
    """Of each place of each node's tree; which multiples of the eigenvectors come out is up to the library, so there is no SQL."""
    out = G.encoded_positions(trees(spark, d), G.tree_encoding(2, 3).round(6) + 0.0)
    return out.select("id", "pos", "node", F.posexplode("e").alias("col", "val"))


# -- propagation and layers -----------------------------------------------------------------


@query("propagate", Q.with_(*Q.GRAPH, Q.LONG, Q.propagation(4)) + f"SELECT id, 4 AS hop, pos, {Q.r6('val')} AS val FROM q4 UNION ALL SELECT id, 1, pos, {Q.r6('val')} FROM q1")
def propagate(spark, d):
    out = G.propagate(T.vectors(spark, d), fixed_edges(spark, d), DIM, 4)
    return elements(out.where("hop in (1, 4)"), "id", "hop")


@query("propagate_holdout", Q.with_(*Q.GRAPH, HELD, Q.LONG, Q.propagation(2, "le")) + f"SELECT id, pos, {Q.r6('val')} AS val FROM q2 WHERE id IN (SELECT a FROM held UNION SELECT b FROM held)")
def propagate_holdout(spark, d):
    links = held_links(spark, d)
    left = stash(G.without_links(fixed_edges(spark, d), links), "left")
    out = G.propagate(T.vectors(spark, d), left, DIM, 2).where("hop = 2")
    return elements(out.join(G.endpoints(links), "id", "left_semi"), "id")


@query("propagate_chunk", Q.with_(*Q.GRAPH, Q.LONG, Q.propagation(1)) + f"SELECT id, pos, {Q.r6('val')} AS val FROM q1")
def propagate_chunk(spark, d):
    """Every chunk of targets by itself."""
    chunks = [ids(spark, d).where(F.col("id") % 4 == k) for k in range(4)]
    out = [G.propagate(T.vectors(spark, d), fixed_edges(spark, d), DIM, 1, to=c).where("hop = 1") for c in chunks]
    return elements(reduce(DataFrame.unionByName, out), "id")


MEAN = "m1 AS MATERIALIZED (SELECT src AS id, pos, avg(val) AS val FROM ed JOIN vl ON vl.id = dst GROUP BY 1, 2)"


@query("sage_mean", Q.with_(*Q.GRAPH, Q.LONG, MEAN) + f"SELECT id, pos, {Q.r6('val')} AS val FROM m1")
def sage_mean(spark, d):
    return elements(G.neighbor_mean(T.vectors(spark, d), fixed_edges(spark, d), DIM), "id")


@query("motif_fusion", Q.with_(*Q.GRAPH, Q.LONG, MEAN, WALK2, "m2 AS MATERIALIZED (SELECT src AS id, pos, avg(val) AS val FROM ed JOIN w2 USING (src, dst) JOIN vl ON vl.id = dst GROUP BY 1, 2)") + f"SELECT id, pos, {Q.r6('sum(val)')} AS val FROM (SELECT id, pos, val * 0.7::DOUBLE AS val FROM m1 UNION ALL SELECT id, pos, val * 0.3::DOUBLE FROM m2) GROUP BY 1, 2")
def motif_fusion(spark, d):
    e = fixed_edges(spark, d)
    return elements(N.motif_layer(T.vectors(spark, d), [(e, 0.7), (G.motif(e, "triangle"), 0.3)], DIM), "id")


def example_weights(size: int, shared: int, hidden: int, out: int, motifs: int) -> list[tuple[str, int, list[float]]]:
    """A network's weights by rule, as rows of a table."""
    shapes = {"shared.weight": (shared, size), "shared.bias": (1, shared), "fusion": (1, motifs)}
    for i in range(motifs):
        shapes |= {f"first.{i}.near": (hidden, shared), f"first.{i}.bias": (1, hidden), f"first.{i}.own": (hidden, shared)}
        shapes |= {f"second.{i}.near": (out, hidden), f"second.{i}.bias": (1, out), f"second.{i}.own": (out, hidden)}
        shapes |= {f"norm.{i}.{c}": (1, hidden) for c in ("scale", "shift", "mean", "variance")}
    rng = np.random.default_rng(G.SEED)
    values = {name: rng.normal(scale=shape[1] ** -0.5, size=shape) for name, shape in shapes.items()}
    values |= {name: 1 + v**2 for name, v in values.items() if name.endswith("variance")}
    return [(name, k, row.tolist()) for name, v in values.items() for k, row in enumerate(v)]


@query("motif_network")
def motif_network(spark, d):
    e = fixed_edges(spark, d)
    motifs = [e, *(stash(G.motif(e, m), "motif") for m in ("triangle", "4-cycle", "4-clique"))]
    table = spark.createDataFrame(example_weights(DIM, 32, 32, 16, len(motifs)), "name string, row long, e array<double>")
    return elements(N.motif_network(T.vectors(spark, d), motifs, N.read_weights(table)), "id")


@query("vector_mean", Q.with_(Q.V, Q.LONG) + f"SELECT y, pos, {Q.r6('avg(val)')} AS val FROM vl JOIN v USING (id) GROUP BY 1, 2")
def vector_mean(spark, d):
    v = T.vectors(spark, d).join(T.nodes(spark, d).select("id", "y"), "id")
    return elements(N.mean_vector(v, DIM, "y"), "y")


@query("new_rows", Q.with_(Q.V, Q.LONG) + f"SELECT id, pos, {Q.r6('val')} AS val FROM vl UNION ALL SELECT (SELECT max(id) FROM v) + k, pos, {Q.r6('avg(val)')} FROM vl, range(1, 4) t(k) GROUP BY k, pos")
def new_rows(spark, d):
    return elements(N.with_new_rows(T.vectors(spark, d), DIM, 3), "id")


@query("adaptive_pool", Q.with_(Q.V) + "SELECT id, i AS pos, " + Q.r6("list_sum(e[(i * 64) // 5 + 1 : ceil((i + 1) * 12.8)::BIGINT]) / (ceil((i + 1) * 12.8)::BIGINT - (i * 64) // 5)") + " AS val FROM v, range(5) t(i)")
def adaptive_pool(spark, d):
    v = T.vectors(spark, d)
    return elements(v.select("id", N.adaptive_pool(F.col("e"), DIM, 5).alias("e")), "id")


Z = f"z1 AS (SELECT id, e FROM v), z2 AS (SELECT vd.id, list(val ORDER BY pos) AS e FROM vd JOIN z1 USING (id) GROUP BY 1), rf AS (SELECT a.id, sum(exp(s / 0.4::DOUBLE)) AS refl, sum(CASE WHEN a.id = a.b THEN exp(s / 0.4::DOUBLE) ELSE 0 END) AS self FROM (SELECT x.id, y.id AS b, {Q.r6('list_cosine_similarity(x.e, y.e)')} AS s FROM z1 x, z1 y) a GROUP BY 1), bt AS (SELECT a.id, sum(exp(s / 0.4::DOUBLE)) AS between_, sum(CASE WHEN a.id = a.b THEN exp(s / 0.4::DOUBLE) ELSE 0 END) AS match FROM (SELECT x.id, y.id AS b, {Q.r6('list_cosine_similarity(x.e, y.e)')} AS s FROM z1 x, z2 y) a GROUP BY 1)"


@query("semi_loss", Q.with_(Q.V, Q.LONG, DROPPED, Z) + f"SELECT id, {Q.r6('-ln(match / (refl + between_ - self))')} AS loss FROM rf JOIN bt USING (id)")
def semi_loss(spark, d):
    z1 = T.vectors(spark, d)
    return S.contrastive_loss(z1, z1.select("id", G.feature_dropout(F.col("e"), DIM, 0.3).alias("e")))


@query("pairwise_cosine", Q.with_(Q.V) + f"SELECT x.id AS a, y.id AS b, {Q.r6('list_cosine_similarity(x.e, y.e)')} AS sim FROM v x, v y")
def pairwise_cosine(spark, d):
    v = T.vectors(spark, d)
    return S.pair_cosines(v, v)


# -- context --------------------------------------------------------------------------------


@query("rel_score", Q.with_(*Q.GRAPH, Q.COS) + "SELECT src AS center, dst AS id, c AS rel FROM ed JOIN cs ON a = src AND b = dst")
def rel_score(spark, d):
    return C.relevance(C.neighborhood(centers(spark, d), fixed_edges(spark, d)), T.vectors(spark, d))


@query("struct_score", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.COH) + "SELECT id, coh FROM coh")
def struct_score(spark, d):
    return C.coherence(T.vectors(spark, d), fixed_edges(spark, d))


@query("struct_score_repl", Q.with_(*Q.GRAPH, Q.COS, Q.DRAWS, Q.COHR) + "SELECT id, coh FROM coh")
def struct_score_repl(spark, d):
    return C.coherence(T.vectors(spark, d), fixed_edges(spark, d), returns=True)


@query("start_neighbors", Q.with_(*Q.GRAPH, Q.NBR) + "SELECT src AS center, rk - 1 AS walk, dst AS id FROM nbr WHERE rk <= 9")
def start_neighbors(spark, d):
    return C.start_neighbors(centers(spark, d), fixed_edges(spark, d))


@query("softmax_window", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.COH, f"x AS (SELECT src AS center, dst AS id, {Q.r10('0.55::DOUBLE * coh + 0.45::DOUBLE * c')} AS x FROM ed JOIN cs ON a = src AND b = dst JOIN coh ON coh.id = dst)", "y AS (SELECT *, exp(x - max(x) OVER (PARTITION BY center)) AS y FROM x)") + f"SELECT center, id, {Q.r6('y / (sum(y) OVER (PARTITION BY center) + 1e-10::DOUBLE)')} AS eta FROM y")
def softmax_window(spark, d):
    e, v = fixed_edges(spark, d), T.vectors(spark, d)
    x = C.relevance(C.neighborhood(centers(spark, d), e), v).join(C.coherence(v, e), "id").withColumn("x", C.blend(F.col("rel"), F.col("coh"), C.BETA))
    return x.select("center", "id", C.softmax(F.col("x"), Window.partitionBy("center")).alias("eta"))


def _walked(spark, d, how=C.walks, **options):
    e, v = fixed_edges(spark, d), T.vectors(spark, d)
    starts = C.start_neighbors(centers(spark, d), e)
    coh = stash(C.coherence(v, e, returns=options.pop("returns", False)), "coherence")
    return starts, how(starts, e, v, coh, **options)


@query("ocs_walk", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.COH, Q.walk(0.02)) + "SELECT center, walk, step, node FROM wk")
def ocs_walk(spark, d):
    return _walked(spark, d)[1]


@query("ocs_walk_joins", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.COH, Q.walk(0.02)) + "SELECT center, walk, step, node FROM wk")
def ocs_walk_joins(spark, d):
    return _walked(spark, d, C.walks_by_joins, beta=C.BETA, threshold=0.02, steps=C.STEPS, cap=None, eps=1e-10, seed=G.SEED)[1]


@query("ocs_walk_large", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.DRAWS, Q.COHR, Q.walk(0.0, cap=64, eps="0.0::DOUBLE")) + "SELECT center, walk, step, node FROM wk")
def ocs_walk_large(spark, d):
    return _walked(spark, d, returns=True, threshold=0.0, cap=64, eps=0.0)[1]


@query("ocs_sequence", Q.with_(*Q.GRAPH, Q.COS, Q.NBR, Q.COH, Q.walk(0.02)) + ", " + Q.SEQUENCE)
def ocs_sequence(spark, d):
    starts, walk = _walked(spark, d)
    seq = C.sequences(centers(spark, d), starts, walk)
    return seq.select("center", joined_ids("graph").alias("graph"), F.size(F.filter("graph", lambda x: x != C.PAD)).cast("long").alias("filled"))


@query("seq_gather", Q.with_(*Q.GRAPH, Q.NBR) + f"SELECT src AS center, rk AS pos, dst AS id, {Q.r6('e[1]')} AS first FROM nbr JOIN v ON v.id = dst WHERE rk <= 9")
def seq_gather(spark, d):
    some = C.start_neighbors(centers(spark, d), fixed_edges(spark, d)).select("center", (F.col("walk") + 1).alias("pos"), "id")
    return G.gathered(some, T.vectors(spark, d)).select("center", "pos", "id", rounded(F.col("e")[0]).alias("first"))


@query("dataset_gather", Q.with_(*Q.GRAPH) + f"SELECT 'near' AS dataset, src, dst, {Q.r6('e[2]')} AS val FROM ed JOIN v ON v.id = dst UNION ALL SELECT 'far', src, dst, {Q.r6('-e[2]')} FROM ed JOIN v ON v.id = dst")
def dataset_gather(spark, d):
    """The same ids in two data sets, each with its own vectors."""
    v = T.vectors(spark, d)
    every = v.select(F.lit("near").alias("dataset"), "id", "e").unionByName(v.select(F.lit("far").alias("dataset"), "id", F.transform("e", lambda x: -x).alias("e")))
    asked = fixed_edges(spark, d).select(F.explode(F.array(F.lit("near"), F.lit("far"))).alias("dataset"), "src", F.col("dst").alias("id"))
    return G.gathered(asked, every, on=("dataset", "id")).select("dataset", "src", F.col("id").alias("dst"), rounded(F.col("e")[1]).alias("val"))


@query("broadcast_gather", Q.with_(*Q.GRAPH) + f"SELECT src, dst, {Q.r6('x.e[1] + y.e[2]')} AS val FROM ed JOIN v x ON x.id = src JOIN v y ON y.id = dst")
def broadcast_gather(spark, d):
    v = T.vectors(spark, d)
    one = G.gathered(fixed_edges(spark, d).withColumnRenamed("src", "id"), v).select(F.col("id").alias("src"), F.col("dst").alias("id"), F.col("e")[0].alias("p"))
    return G.gathered(one, v).select("src", F.col("id").alias("dst"), rounded(F.col("p") + F.col("e")[1]).alias("val"))


@query("shuffled_gather", Q.with_(*Q.GRAPH) + f"SELECT src, dst, {Q.r6('e[3]')} AS val FROM ed JOIN v ON v.id = dst")
def shuffled_gather(spark, d):
    return G.gathered(fixed_edges(spark, d).withColumnRenamed("dst", "id"), T.vectors(spark, d), most=0).select("src", F.col("id").alias("dst"), rounded(F.col("e")[2]).alias("val"))


# -- optimal transport and encoders (no SQL) ------------------------------------------------


def _points(spark, d):
    """The test split's vectors, and the others by class."""
    v = T.vectors(spark, d).join(T.nodes(spark, d).select("id", "y", "split"), "id")
    return v.where("split = 'test'").select("id", "e"), v.where("split <> 'test'").select(F.col("y").cast("string").alias("name"), "id", "e")


@query("emd")
def emd(spark, d):
    return N.transport_to_groups(*_points(spark, d))


@query("closest_dataset")
def closest_dataset(spark, d):
    return N.closest(N.transport_to_groups(*_points(spark, d)))


@query("closest_voted")
def closest_voted(spark, d):
    """Twelve points a draw and side are what the operator draws; it draws from all."""
    return N.closest_by_votes(*_points(spark, d), size=12, draws=9)


POOLED = "it AS MATERIALIZED (SELECT src AS center, rk, pos, val - avg(val) OVER (PARTITION BY src, pos) AS val FROM nbr JOIN vl ON vl.id = dst WHERE rk <= 9), w AS (SELECT center, rk, pos AS query, exp(val / 8) / sum(exp(val / 8)) OVER (PARTITION BY center, pos) AS w FROM it WHERE pos < 2)"


@query("attention_pool", Q.with_(*Q.GRAPH, Q.LONG, Q.NBR, POOLED) + f"SELECT center, query, it.pos, {Q.r6('sum(w * val)')} AS val FROM it JOIN w USING (center, rk) GROUP BY 1, 2, 3")
def attention_pool(spark, d):
    """Each node's neighbours, by rank, as two weighted means."""
    near = G.gathered(C.start_neighbors(centers(spark, d), fixed_edges(spark, d)).select("center", F.col("walk").alias("pos"), "id"), T.vectors(spark, d))
    out = N.pooled(near, np.eye(DIM)[:2], "center")
    return elements(out, "center", "query")


def near_vectors(spark, d) -> DataFrame:
    """Each node's first neighbours in hash order, as a sequence of vectors."""
    starts = C.start_neighbors(centers(spark, d), fixed_edges(spark, d)).select("center", F.col("walk").alias("pos"), "id")
    return G.gathered(starts, T.vectors(spark, d))


def projector_weights(kind: str, size: int, hidden: int) -> dict[str, np.ndarray]:
    """A projector's weights by rule."""
    rng = np.random.default_rng(G.SEED)
    out = {name: rng.normal(scale=shape[1] ** -0.5, size=shape) for name, shape in J.shapes(kind, size, hidden).items()}
    return out | ({"temperature": np.array([[1.5]])} if "temperature" in out else {})


def _projected(kind: str):
    def run(spark, d):
        out = J.projected(near_vectors(spark, d), kind, projector_weights(kind, DIM, 32), "center")
        return out.select("center", "token", F.posexplode("e").alias("pos", "val")).withColumn("val", rounded(F.col("val")))

    return run


for _kind in (*J.POOLING, "2-layer-mlp"):
    query(f"project_{_kind.replace('-', '_')}")(_projected(_kind))

TREE = "h1 AS MATERIALIZED (SELECT v.id, dst AS node FROM v JOIN nbr ON src = v.id AND rk <= 3), h2 AS (SELECT h1.id, dst AS node FROM h1 JOIN nbr ON src = node AND rk <= 3), st AS (SELECT id, id AS node FROM v UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"


@query("node_embeddings", Q.with_(*Q.GRAPH, Q.LONG, Q.NBR, TREE) + f"SELECT st.id, pos, {Q.r6('avg(val)')} AS val FROM st JOIN vl ON vl.id = node GROUP BY 1, 2")
def node_embeddings(spark, d):
    """Vectors of each node's tree, without pads, as one mean a node, by way of a dump that is made in two runs."""
    states = trees(spark, d).join(T.vectors(spark, d).withColumnRenamed("id", "node"), "node", "left").select("id", "pos", "e", (F.col("node") != C.PAD).alias("seen"))
    states = stash(states, "states")
    path = f"{scratch_root(spark)}/loomgraph/dump-{uuid.uuid4().hex}"
    D.dump(states, path, DIM, shards=8, only=range(3))
    D.dump(states, path, DIM, shards=8, at_once=4)
    return elements(D.read_dump(spark, path), "id")


SPLIT = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
HASHED = f"""wd AS MATERIALIZED (SELECT id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda x: x <> '')) AS w FROM nodes),
hs AS MATERIALIZED (SELECT w, {Q.crc32('w')} AS h FROM (SELECT DISTINCT w FROM wd), ct),
sm AS (SELECT id, h % 16 AS pos, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM wd JOIN hs USING (w) GROUP BY 1, 2),
ln AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-9::DOUBLE) AS n FROM sm GROUP BY 1)"""


@query("encode_texts", Q.with_(Q.CRC, Q.NODES, HASHED) + f"SELECT v.id, p.pos, {Q.r6('coalesce(x / n, 0.0::DOUBLE)')} AS val FROM nodes v CROSS JOIN range(16) p(pos) LEFT JOIN sm ON sm.id = v.id AND sm.pos = p.pos LEFT JOIN ln ON ln.id = v.id")
def encode_texts(spark, d):
    return elements(N.encoded(T.nodes(spark, d).select("id", "text"), N.hashing_encoder(16)), "id")
