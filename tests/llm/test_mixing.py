import math
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing as M
from tests.llm.helpers import awkward_rows, frame


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(size, weight, total, most):
    target, open_ = {}, set(size)
    while open_:
        left = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > most * size[s]}
        if not over:
            return target | {s: left * weight[s] for s in open_}
        target |= {s: most * size[s] for s in over}
        open_ -= over
    return target


def plain_factor(target, rows, most, tilt):
    """By halving: expected copies are min(most, c * weight)."""
    w = lambda s: 2 ** (-tilt * int(math.log2(s)))
    words = lambda c: sum(s * min(most, c * w(s)) for s in rows if s)
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
    return lambda s: min(most, lo * w(s)) if s else 0.0


def plain_mix(rows, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST, tilt=M.TILT):
    """rows (id, source, size, u): everything by sorting a whole source."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = plain_targets(size, weight, min(share, most) * sum(size.values()), most)
    out = {}
    for s in names:
        own = [r for r in rows if r[1] == s]
        f = plain_factor(target[s], [r[2] for r in own], most, tilt)
        left, ranked = target[s], []
        for i, _, n, u in own:
            e = round(f(n), 9)
            out[i] = int(e)
            left -= out[i] * n
            if (p := e - int(e)) > 0:
                ranked.append(((u / (1 - u)) / (p / (1 - p)), n, i))
        bins = max(1, min(M.MOST_BINS, math.ceil(len(own) / M.BIN_ROWS)))
        place = lambda q: min(bins - 1, int(q / (1 + q) * bins))  # noqa: E731, B023
        sums = {b: sum(n for q, n, _ in ranked if place(q) == b) for b in range(bins)}
        for b in range(bins):
            inside = sorted(x for x in ranked if place(x[0]) == b)
            if sums[b] <= left:
                for _, n, i in inside:
                    out[i] += 1
                    left -= n
                continue
            picked = set()
            for _, n, i in inside:
                if n <= left:
                    picked.add(i)
                    left -= n
            more = [(n, k, i) for k, (_, n, i) in enumerate(inside) if i not in picked and n < 2 * left]
            for i in [*picked, *([min(more)[2]] if more else [])]:
                out[i] += 1
            break
    return size, target, out


def test_targets_are_shared_again_until_none_is_above(spark):
    size = {"a": 10, "b": 1000, "c": 0, "d": 55, "e": 400, "f": 3}
    weight = dict(zip(size, (3, 1, 2, 3, 1, 2)))
    total = 1.5 * sum(size.values())
    df = spark.createDataFrame([(s, size[s], float(weight[s])) for s in size], "source string, size long, weight double")
    got = {r.source: r.target for r in M.filled_targets(df, total, 2).collect()}
    want = plain_targets(size, weight, total, 2)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(total)


def test_whole_table_equals_plain_sampling(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "source", "text", M.uniform(M.SEED, F.col("doc_id"), F.col("text")).alias("u")).collect()
    size, target, want = plain_mix([(r.doc_id, r.source, n_words(r.text), r.u) for r in rows])
    got = {r.doc_id: r for r in M.mixture(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, n = got[r.doc_id], n_words(r.text)
        assert (g.size, g.source_size, g.taken) == (n, size[r.source], want[r.doc_id] * n), r.doc_id
        assert g.target == pytest.approx(target[r.source]) and g.taken <= 2 * n


def test_many_bins_and_a_hot_source(spark):
    """A source with most rows goes through many bins; its words end within a document of the target."""
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = docs.select("doc_id", "source", "text", M.uniform(M.SEED, F.col("doc_id"), F.col("text")).alias("u")).collect()
    size, target, want = plain_mix([(r.doc_id, r.source, n_words(r.text), r.u) for r in drawn])
    assert math.ceil(4000 / M.BIN_ROWS) > 10
    got = M.mixture(docs).collect()
    assert {r.doc_id: r.copies for r in got} == want
    of, words = dict((i, s) for i, _, s in rows), {}
    for r in got:
        words[of[r.doc_id]] = words.get(of[r.doc_id], 0) + r.taken
    for s in size:
        assert abs(words[s] - target[s]) <= 5, (s, words[s], target[s])
    assert sorted(map(tuple, M.mixture(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_inclusion_follows_the_odds(spark):
    """Over many seeds, a document is taken about as often as expected, whatever its length."""
    rows = [(i, " ".join(["w"] * n), "s") for i, n in enumerate([4, 9, 18, 35, 70, 140] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    total, expected = {}, {}
    for seed in range(6):
        for r in M.drawn_copies(docs, weights=(1,), share=0.5, seed=seed).collect():
            total[r.size] = total.get(r.size, 0) + r.copies / 360
            expected[r.size] = r.expected
    assert expected[4] > 1.5 * expected[140]
    for n, e in expected.items():
        assert abs(total[n] - e) < 0.12, (n, total[n], e)


def test_awkward_tables(spark):
    docs = frame(spark, awkward_rows())
    got = M.mixture(docs).collect()
    assert len(got) == docs.count()
    assert sorted(r.size for r in got) == sorted(n_words(r.text) for r in docs.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.source_size for r in got} == {sum(n_words(r.text) for r in docs.where("source = 's'").collect()), sum(n_words(r.text) for r in docs.where("source is null").collect())}
    assert M.mixture(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mixture(blank).collect()] == [(0, 0.0, 0)] * 2
    mixed = M.mix(docs.withColumn("a.b", F.lit(1)).withColumn("copies", F.lit("mine")))
    assert mixed.columns == [*docs.columns, "a.b", "copies"]
    assert mixed.count() == sum(r.copies for r in got)
