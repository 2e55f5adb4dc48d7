"""Pieces of the SQL that states each query a second time, for DuckDB."""

from __future__ import annotations


def r6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def r10(x: str) -> str:
    """For sums and blends of rounded numbers, which r6 would round at exact halves."""
    return f"round({x}, 10)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


V = "v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS y FROM embeddings)"
TOP8 = f"""sims AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, {r6('list_inner_product(a.e, b.e)')} AS sim FROM v a JOIN v b ON a.id <> b.id),
top8 AS MATERIALIZED (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM sims) WHERE rn <= 8)"""
ED = "ed AS MATERIALIZED (SELECT src, dst FROM top8 UNION SELECT dst, src FROM top8)"
GRAPH = (V, TOP8, ED)
COS = f"cs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, greatest(0.0::DOUBLE, {r6('list_cosine_similarity(a.e, b.e)')}) AS c FROM v a, v b)"
NBR = "nbr AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5('42|' || dst), dst) AS rk FROM ed)"
COH = f"coh AS MATERIALIZED (SELECT n.src AS id, {r10('sum(c) * count(*) / 10.0::DOUBLE')} AS coh FROM nbr n JOIN cs ON cs.a = n.src AND cs.b = n.dst WHERE rk <= 10 GROUP BY 1)"
DRAWS = """ns AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS n FROM ed GROUP BY 1),
draws AS MATERIALIZED (SELECT src AS id, n[(('0x' || substr(md5('42|' || src || '|' || k), 1, 8))::BIGINT % len(n) + 1)::BIGINT] AS neighbor, k AS draw FROM ns, range(10) t(k))"""
COHR = f"coh AS MATERIALIZED (SELECT d.id, {r10('sum(c) * count(*) / 10.0::DOUBLE')} AS coh FROM draws d JOIN cs ON cs.a = d.id AND cs.b = d.neighbor GROUP BY 1)"
LONG = "vl AS MATERIALIZED (SELECT id, unnest(range(64)) AS pos, unnest(e) AS val FROM v)"
NODES = "nodes AS MATERIALIZED (SELECT vec_id AS id, text, label AS y, CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"


def walk(threshold: float, cap: int | None = None, eps: str = "1e-10::DOUBLE", steps: int = 10) -> str:
    """CTEs ending in wk(center, walk, step, node); needs ed, nbr, cs, coh."""
    out = ["p0 AS MATERIALIZED (SELECT src AS center, rk - 1 AS walk, 0 AS step, dst AS node FROM nbr WHERE rk <= 9)", "a0 AS MATERIALIZED (SELECT * FROM p0)"]
    for k in range(1, steps):
        limit = f"SELECT center, walk, id FROM (SELECT *, row_number() OVER (PARTITION BY center, walk ORDER BY md5('42|' || id), id) AS q FROM g{k}) WHERE q <= {cap}" if cap else f"SELECT * FROM g{k}"
        out += [
            f"g{k} AS MATERIALIZED (SELECT DISTINCT a.center, a.walk, e.dst AS id FROM a{k - 1} a JOIN p{k - 1} l ON l.center = a.center AND l.walk = a.walk JOIN ed e ON e.src = a.node WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} s WHERE s.center = a.center AND s.walk = a.walk AND s.node = e.dst))",
            f"f{k} AS MATERIALIZED ({limit})",
            f"x{k} AS MATERIALIZED (SELECT f.center, f.walk, f.id, {r10('0.55::DOUBLE * coalesce(coh, 0.0::DOUBLE) + 0.45::DOUBLE * c')} AS x FROM f{k} f JOIN cs ON cs.a = f.center AND cs.b = f.id LEFT JOIN coh ON coh.id = f.id)",
            f"y{k} AS MATERIALIZED (SELECT center, walk, id, exp(x - max(x) OVER w) AS y FROM x{k} WINDOW w AS (PARTITION BY center, walk))",
            f"h{k} AS MATERIALIZED (SELECT center, walk, id, {r6(f'y / (sum(y) OVER w + {eps})')} AS eta FROM y{k} WINDOW w AS (PARTITION BY center, walk))",
            f"p{k} AS MATERIALIZED (SELECT center, walk, {k} AS step, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY center, walk ORDER BY eta DESC, id) AS q FROM h{k} WHERE eta > {threshold}) WHERE q = 1)",
            f"a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM p{k})",
        ]
    return ",\n".join([*out, f"wk AS MATERIALIZED (SELECT * FROM a{steps - 1})"])


SEQUENCE = """slots AS (SELECT id AS center, 0 AS pos, id AS node FROM v
 UNION ALL SELECT center, walk + 1, node FROM p0 UNION ALL SELECT center, 11 + walk * 10 + step, node FROM wk)
SELECT c.id AS center, string_agg(coalesce(s.node, -500)::VARCHAR, ',' ORDER BY r.pos) AS graph, count(s.node) AS filled
FROM v c CROSS JOIN range(111) r(pos) LEFT JOIN slots s ON s.center = c.id AND s.pos = r.pos GROUP BY 1"""


def propagation(hops: int, edges: str = "ed") -> str:
    """CTEs q0..q<hops> (id, pos, val); needs vl and edges."""
    out = [f"dg AS MATERIALIZED (SELECT dst AS n, 1 / sqrt(count(*)) AS s FROM {edges} GROUP BY 1)", f"wt AS MATERIALIZED (SELECT src, dst, a.s * b.s AS w FROM {edges} JOIN dg a ON a.n = src JOIN dg b ON b.n = dst)", "q0 AS MATERIALIZED (SELECT * FROM vl)"]
    for k in range(1, hops + 1):
        out.append(f"q{k} AS MATERIALIZED (SELECT b.id, b.pos, coalesce(s.val, 0.0::DOUBLE) AS val FROM vl b LEFT JOIN (SELECT w.dst AS id, x.pos, sum(x.val * w.w) AS val FROM wt w JOIN q{k - 1} x ON x.id = w.src GROUP BY 1, 2) s ON s.id = b.id AND s.pos = b.pos)")
    return ",\n".join(out)


PARTS = """p AS (SELECT p_partkey AS k, p_name AS n, p_type AS t FROM part),
q AS MATERIALIZED (SELECT p.k, p.n, p.t, coalesce(x.n, f.n) AS n2, coalesce(x.t, f.t) AS t2 FROM p LEFT JOIN p x ON x.k = p.k + 1 LEFT JOIN p f ON f.k = 1)"""


def answers(gt: str, own: str, other: str, whole: str) -> str:
    """CTEs ending in an(question_id, gt, text) and lb(label)."""
    text = f"CASE WHEN k % 7 = 0 THEN 'It is ' || {own} || ' or ' || {other} WHEN k % 3 = 0 THEN upper({other}) WHEN k % 5 = 0 THEN {whole} WHEN k % 2 = 0 THEN 'It is a ' || upper({own}) || '.' ELSE replace({own}, ' ', '_') END"
    return f"{PARTS},\nan AS MATERIALIZED (SELECT k AS question_id, {gt} AS gt, {text} AS text FROM q), lb AS MATERIALIZED (SELECT DISTINCT gt AS label FROM an)"


LINKS = f"""pos AS MATERIALIZED (SELECT src AS a, dst AS b FROM ed WHERE src < dst), nn AS (SELECT max(id) + 1 AS n FROM v),
neg AS MATERIALIZED (SELECT DISTINCT least(a, c) AS a, greatest(a, c) AS b FROM (SELECT a, (a * 31 + b * 17 + 7) % n AS c FROM pos, nn) WHERE a <> c AND NOT EXISTS (SELECT 1 FROM ed WHERE src = a AND dst = c)),
sc AS MATERIALIZED (SELECT l.a, l.b, gt, {r6('list_cosine_similarity(x.e, y.e)')} AS score FROM (SELECT *, 'yes' AS gt FROM pos UNION ALL SELECT *, 'no' AS gt FROM neg) l JOIN v x ON x.id = l.a JOIN v y ON y.id = l.b)"""
TURNS = "tn AS MATERIALIZED (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def crc_table() -> list[int]:
    """What each byte does to an empty CRC register, by the rule of the reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: One row with the list crc: cross join it where crc32() is used.
CRC = f"ct AS MATERIALIZED (SELECT {crc_table()}::BIGINT[] AS crc)"


def crc32(text: str) -> str:
    """The CRC-32 of a text's bytes; crc is in scope."""
    size, digits = f"octet_length(encode({text}))", f"hex(encode({text}))"
    octets = f"list_transform(range({size}), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"
