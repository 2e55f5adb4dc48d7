import hashlib
import random

import numpy as np

from loomgraph.llm import codebooks as C
from loomgraph.llm.common import Steps


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (id, vector, label): everything anew in every round, in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, ""
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = lambda v: [tuple((v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]) for p in range(parts)]
    kept = sorted(((i, cut(v), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: [min((far(v[p], b), k) for k, b in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        at = [best(v) for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for (_, v, _), b in zip(kept, at) if b[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    out, by = [], {}
    for i, v, lab in kept:
        b = best(v)
        out.append((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    return sorted((str(i), c, e, by[lab]) for i, c, e, lab in out), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def some(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in (rng.normal(size=dim) * spread).astype(np.float32)], int(rng.integers(3)) if i % 7 else None) for i in range(n)]


def got(df):
    rows = df.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), (rows[0].codebooks_sha256 if rows else "")


def test_equals_plain_lloyd(spark):
    rows = some(330, 12, 1)
    rows[5], rows[6], rows[7], rows[8] = (5, None, 1), (6, [*rows[6][1][:3], None, *rows[6][1][4:]], 1), (7, [float("nan")] * 12, 1), (8, [float("inf"), *rows[8][1][1:]], 2)
    random.Random(1).shuffle(rows)
    assert got(C.compressed(frame(spark, rows))) == plain(rows)
    assert got(C.compressed(frame(spark, rows).repartition(5))) == plain(rows)


def test_few_entries_ties_and_repeats(spark):
    """Equal vectors tie everywhere: the lower entry has them, others stay unused."""
    rows = [(i, [float(i % 3), 0.5, -1.0, 2.0], 0) for i in range(40)] + [(3, [0.0] * 4, 1), (3, [0.0] * 4, 1), (None, [9.0] * 4, None)]
    assert got(C.compressed(frame(spark, rows), entries=8)) == plain(rows, entries=8)


def test_only_changes_are_shuffled(spark, tmp_path):
    """Contributions of a round are those of changed rows; the sums they add up to are those of all rows."""
    df = frame(spark, some(400, 8, 3)).select("vec_id", "label", C.scaled(C.F.col("embedding")).alias("v")).withColumnRenamed("vec_id", "id")
    with Steps(spark) as steps:
        rows, books, changes = C.fit(df, steps, entries=16, rounds=5)
        assert changes[0] == 400 and changes[-1] < 200
        x = np.stack([r.v for r in rows.collect()]).reshape(400, 4, 2)
        still = rows.withColumn("old", C.F.col("code"))
        assert C._contributions(still, books).count() == 0
        undone = rows.select("id", "v", C.F.array().cast("array<smallint>").alias("old"), "code")
        sums = dict(map(tuple, C._contributions(undone, books).collect()))
        assert sum(v for k, v in sums.items() if k >= books.entries.size) == 1600
        assert sum(v for k, v in sums.items() if k < books.entries.size) == int(x.sum())


def test_large_components_and_lengths(spark):
    rows = [(1, [1e5, 1.0], 0), (2, [1e30, -1e30, 3.0, 4.0, 5.0], 0), (3, [60000.0, -60000.5, 3.0, 4.0, 5.0], 1), (4, [], None)]
    limited = [(i, [max(-65536.0, min(65536.0, float(np.float32(x)))) for x in v], lab) for i, v, lab in rows]
    assert got(C.compressed(frame(spark, rows), entries=2)) == plain(limited, entries=2)


def test_empty_and_other_columns(spark):
    assert C.compressed(frame(spark, [])).count() == 0
    assert C.compressed(frame(spark, [(1, None, 1)])).count() == 0
    rows = some(20, 8, 4)
    df = frame(spark, rows)
    for name in ("id", "v", "code", "old", "error", "of", "a.b"):
        df = df.withColumn(name, C.F.lit("x"))
    assert got(C.compressed(df)) == plain(rows)
