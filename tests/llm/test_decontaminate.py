import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import decontaminate as D
from tests.llm.helpers import awkward_rows, frame, texts, words

BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[s : s + n]))) and len(w[s : s + n]) == n:
                    hit.update(range(s, s + n))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("size", [D.BROADCAST_BYTES, 0])
def test_equals_plain_rules(spark, data, monkeypatch, size):
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    got = {r[0]: tuple(r)[1:] for r in D.contamination(docs, bench).collect()}
    assert got == want and any(x[4] for x in want.values())
    clean = {r.doc_id for r in D.remove_contaminated(docs, bench).collect()}
    assert clean == {i for i, x in want.items() if not x[4]}


@pytest.mark.parametrize("size", [D.BROADCAST_BYTES, 0])
def test_short_items_overlaps_ties_and_nulls(spark, monkeypatch, size):
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    seq = " ".join(f"w{i}" for i in range(30))
    items = [(1, "alpha beta"), (2, seq), (2, seq), (3, None), (4, "!!"), (10, "alpha beta"), (5, "x " * 12)]
    bench = spark.createDataFrame(items, BENCH)
    given = ["Alpha, BETA alpha beta", seq + " z " + seq, "w3 w4", "x " * 25, None, "", "alpha gamma beta"]
    got = {r[0]: tuple(r)[1:] for r in D.contamination(texts(spark, given), bench).collect()}
    assert got == plain(list(enumerate(given)), [x for x in items if x[1]])
    rows = awkward_rows()
    got = D.contamination(frame(spark, rows), bench).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert D.contamination(frame(spark, []), bench).collect() == []
    none = D.contamination(texts(spark, given), spark.createDataFrame([], BENCH)).collect()
    assert len(none) == len(given) and not any(r.contaminated for r in none)
    kept = D.remove_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)


@pytest.mark.parametrize("every_row", [True, False])
def test_windows_meet_the_hash_set_in_one_compiled_stage(spark, data, every_row):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = D.WindowSet(bench).hits(docs, [F.col("doc_id")], every_row=every_row)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    compiled = {k: re.search(r"\*\((\d+)\) " + k, plan) for k in ("Project \\[doc_id[^\\n]*array_join", "BroadcastHashJoin", "Generate")}
    assert all(compiled.values()) and len({m[1] for m in compiled.values()}) == 1, plan
    assert "Python" not in plan and "Arrow" not in plan


def test_a_benchmark_of_a_million_windows(spark):
    """Its set is too large to be broadcast; every planted window is found and nothing else."""
    rng = random.Random(1)
    items = [(i, " ".join(f"t{rng.randrange(10**6)}" for _ in range(1009))) for i in range(1000)]
    bench = spark.createDataFrame(items, BENCH)
    given, want = [], []
    for i in range(60):
        own = [f"d{rng.randrange(10**6)}" for _ in range(200)]
        if i % 2:
            w = items[i][1].split()
            own[50:50] = w[i : i + 10]
        else:
            own[50:50] = items[i][1].split()[i : i + 9]
        given.append(" ".join(own))
        want.append((10, 1) if i % 2 else (0, 0))
    assert not D.WindowSet(bench).small
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(texts(spark, given), bench).collect()}
    assert [got[i] for i in range(60)] == want


def test_other_columns_may_have_any_names(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], BENCH)
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j"), (2, "x"), (3, None)], "doc_id long, text string")
    docs = docs.select("*", *(F.lit(9).alias(c) for c in ("a", "b", "A_", "key", "w", "h", "n", "pos", "len", "known", "entries", "__a", "scan", "first")))
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(tuple(r)[::2] for r in kept.collect()) == [(2, *[9] * 7), (3, *[9] * 7)]
    assert sorted((r.doc_id, r.contaminated) for r in D.contamination(docs, bench).collect()) == [(1, True), (2, False), (3, False)]


def test_a_long_text_full_of_hits(spark):
    """Rows that leave the compiled stage do not carry the text's words: 60,000 hits in one text would not fit otherwise."""
    seq = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, seq), (2, "zz yy")], BENCH)
    text = " ".join([seq] * 20_000)
    docs = texts(spark, [text, seq])
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in D.contamination(docs, bench).collect()} == {0: (240_000, 240_000, 1), 1: (12, 12, 1)}
    assert D.remove_contaminated(docs, bench).count() == 0
