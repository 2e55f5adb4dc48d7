"""Projectors, weights, dumps and rankings against plain versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import projectors as J
from loomgraph.operators import scoring as S
from loomgraph.sources import bundle as B
from loomgraph.sources import embeddings as D


def weights_of(kind, size, hidden, heads=4):
    rng = np.random.default_rng(3)
    out = {n: rng.normal(size=s) for n, s in J.shapes(kind, size, hidden, heads).items()}
    return out | ({"temperature": np.array([[0.7]])} if "temperature" in out else {})


def plain_gelu(x):
    return np.array([[v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in row] for row in x])


def plain_projector(x, kind, w, heads=4):
    """One sequence, step by step."""
    n = 2 if kind in J.POOLING else J.layers_of(kind)
    if kind in J.POOLING:
        x = x - x.mean(axis=0)
    for i in range(n):
        x = (plain_gelu(x) if i else x) @ w[f"layer.{i}.weight"].T + w[f"layer.{i}.bias"]
    how = J.POOLING.get(kind)
    if how is None:
        return x
    if how == "means":
        return np.stack([x[i * len(x) // 5 : -(-(i + 1) * len(x) // 5)].mean(axis=0) for i in range(5)])
    heads = heads if how == "heads" else 1
    d = x.shape[1] // heads
    out = []
    for q in w["queries"]:
        token = []
        for h in range(heads):
            part = x[:, h * d : (h + 1) * d]
            s = part @ q[h * d : (h + 1) * d] / math.sqrt(d) / w["temperature"][0, 0]
            p = np.exp(s - s.max())
            token.append((p / p.sum()) @ part)
        out.append(np.concatenate(token))
    return np.stack(out)


@pytest.mark.parametrize("kind", ["linear", "3-layer-mlp", *J.POOLING])
@pytest.mark.parametrize("at_once", [J.AT_ONCE, 40])
def test_projectors_equal_a_plain_version(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(J, "AT_ONCE", at_once)
    rng, w = np.random.default_rng(1), weights_of(kind, 6, 8)
    given = {i: rng.normal(size=(n, 6)) for i, n in enumerate([1, 2, 5, 7, 11, 1, 30])}
    rows = [(i, p, v.tolist()) for i, x in given.items() for p, v in enumerate(x)] + [(1, 9, None), (99, 0, None)]
    random.Random(2).shuffle(rows)
    got = {}
    for r in J.projected(spark.createDataFrame(rows, "id long, pos int, e array<double>"), kind, w, heads=4).collect():
        got.setdefault(r.id, {})[r.token] = r.e
    assert got.keys() == given.keys()
    for i, x in given.items():
        want = plain_projector(x, kind, w)
        assert np.allclose(np.array([got[i][k] for k in range(len(want))]), want) and len(got[i]) == len(want)


def test_projectors_say_what_does_not_fit(spark):
    v = spark.createDataFrame([(1, 0, [1.0] * 6)], "id long, pos int, e array<double>")
    w = weights_of("vicuna_2layermh", 6, 8)
    with pytest.raises(ValueError, match="layer.1.bias should be"):
        J.projected(v, "vicuna_2layermh", w | {"layer.1.bias": np.zeros((1, 9))}, heads=4)
    with pytest.raises(ValueError, match="queries .*missing"):
        J.projected(v, "vicuna_2layersh", {k: x for k, x in w.items() if k != "queries"})
    with pytest.raises(ValueError, match="heads"):
        J.projected(v, "vicuna_2layermh", w, heads=3)
    with pytest.raises(ValueError, match="no projector"):
        J.projected(v, "cubic", w)


def weight_table(spark, w):
    return spark.createDataFrame([(n, k, row.tolist()) for n, x in w.items() for k, row in enumerate(x)], "name string, row long, e array<double>")


def test_a_bundle_comes_back_or_says_why_not(spark, tmp_path):
    kind = "vicuna_2layermh"
    w, path = weights_of(kind, 6, 8), str(tmp_path / "b")
    fits = {"kind": kind, "hidden": 8, "backbone": "base", "shapes": J.shapes(kind, 6, 8, 4)}
    with pytest.raises(B.BundleError, match="no whole bundle"):
        B.read_bundle(spark, path)
    B.write_bundle(weight_table(spark, w), path, kind, 8, "base", 7)
    back = B.read_bundle(spark, path, **fits)
    assert back.keys() == w.keys() and all((back[n] == w[n]).all() for n in w)
    assert B.read_manifest(spark, path)["step"] == 7 and os.listdir(tmp_path) == ["b"]
    with pytest.raises(B.BundleError, match="something at"):
        B.write_bundle(weight_table(spark, w), path, kind, 8, "base")
    for what, value, says in [("kind", "linear", "kind is 'vicuna_2layermh'"), ("hidden", 9, "hidden is 8"), ("backbone", "other", "backbone is 'base'"), ("shapes", fits["shapes"] | {"x": (1, 1)}, r"missing matrices: \['x'\]"), ("shapes", {k: v for k, v in fits["shapes"].items() if k != "queries"}, r"unexpected matrices: \['queries'\]"), ("shapes", fits["shapes"] | {"queries": (4, 8)}, r"queries is \(5, 8\)")]:
        with pytest.raises(B.BundleError, match=says):
            B.read_bundle(spark, path, **fits | {what: value})
    some = str(tmp_path / "some")
    B.write_bundle(weight_table(spark, w), some, kind, 8, "base", prefixes=("layer.0",))
    assert set(B.read_bundle(spark, some)) == {"layer.0.weight", "layer.0.bias"}


def test_a_table_that_is_not_what_its_manifest_says(spark, tmp_path):
    w, path = weights_of("linear", 3, 2), str(tmp_path / "b")
    B.write_bundle(weight_table(spark, w), path, "linear", 2, "base")
    weight_table(spark, w | {"layer.0.bias": np.zeros((1, 5))}).write.mode("overwrite").parquet(f"{path}/weights")
    with pytest.raises(B.BundleError, match=r"does not hold .*layer.0.bias"):
        B.read_bundle(spark, path)
    for rows, says in [([("a", 1, [1.0])], "lacks rows"), ([("a", 0, [1.0]), ("a", 0, [1.0])], "lacks rows"), ([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], "rows of 1 and of 2"), ([("a", 0, [float("nan")])], "null or none")]:
        with pytest.raises(B.BundleError, match=says):
            B.write_bundle(spark.createDataFrame(rows, "name string, row long, e array<double>"), str(tmp_path / "x"), "linear", 1, "base")


def test_a_dump_that_is_cut_off_goes_on(spark, tmp_path, monkeypatch):
    rng, path = np.random.default_rng(5), str(tmp_path / "dump")
    rows = [(i, p, rng.normal(size=3).tolist(), p < i % 4) for i in range(40) for p in range(4)]
    states = spark.createDataFrame(rows, "id long, pos int, e array<double>, seen boolean")
    real, calls = D.publish, []

    def failing(s, whole, final):
        calls.append(final)
        if len(calls) == 6:
            raise RuntimeError("lost")
        return real(s, whole, final)

    monkeypatch.setattr(D, "publish", failing)
    with pytest.raises(RuntimeError):
        D.dump(states, path, 3, shards=9, at_once=4)
    there = D.committed(spark, path)
    assert there == [0, 1, 2, 3, 4] and D.missing(states, path).count() > 0
    before = {k: sorted(os.listdir(f"{path}/shard={k}")) for k in there}
    monkeypatch.setattr(D, "publish", real)
    assert D.dump(states, path, 3, shards=9, at_once=4) == 4 and D.dump(states, path, 3, shards=9) == 0
    assert before == {k: sorted(os.listdir(f"{path}/shard={k}")) for k in there}
    got = {r.id: r.e for r in D.read_dump(spark, path).collect()}
    assert len(got) == D.read_dump(spark, path).count() == 40 and D.missing(states, path).count() == 0
    for i in range(40):
        own = [e for j, _, e, seen in rows if j == i and seen]
        assert np.allclose(got[i], np.mean(own, axis=0) if own else [0.0] * 3)


def test_ranking_of_any_scores(spark):
    rng = random.Random(7)
    for scale in (1e-9, 1.0, 1e12):
        rows = [("yes" if rng.random() < 0.4 else "no", round(rng.gauss(0, 1), 1) * scale) for _ in range(400)]
        pos, neg = [s for g, s in rows if g == "yes"], [s for g, s in rows if g == "no"]
        (r,) = S.ranking(spark.createDataFrame(rows, "gt string, score double")).collect()
        assert (r.n_pos, r.n_neg) == (len(pos), len(neg))
        assert r.auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg), abs=1e-6)
        assert r.acc == pytest.approx(sum((s > 0.5) == (g == "yes") for g, s in rows) / len(rows), abs=1e-6)
    assert S.ranking(spark.createDataFrame([("yes", 1.0), ("yes", None)], "gt string, score double")).first().auc is None
    assert S.ranking(spark.createDataFrame([], "gt string, score double")).count() == 1


def test_ranges_of_scores_are_even(spark):
    """A thousand times larger scores are dealt out as evenly: no range holds most of the values."""
    from loomgraph.operators.order import _numbered

    df = spark.range(20_000).select((F.col("id") * F.lit(37.5) + 1e6).alias("score"))
    rows, _, part = _numbered(df, ("score",))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [r["count"] for r in rows.groupBy(part).count().collect()]
    assert len(counts) == n and max(counts) < 1.5 * 20_000 / n


def test_graphs_are_built_again_when_their_tables_are_gone(spark, data):
    from loomgraph.plans import QUERIES
    from loomgraph.session import clear_scratch

    before = sorted(map(tuple, QUERIES["adjacency"](spark, data).collect()))
    clear_scratch(spark)
    assert sorted(map(tuple, QUERIES["adjacency"](spark, data).collect())) == before
