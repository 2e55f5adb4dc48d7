import random

import numpy as np
import pytest
from pyspark.sql import types as T

from loomgraph.llm import toxicity as X
from loomgraph.llm.shingles import LETTERS, spans_and_sums
from tests.llm.helpers import awkward_rows, frame

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def corpus(n, seed):
    rng = random.Random(seed)
    out, label = [], []
    for _ in range(n):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 200))]
        bad = rng.random() < 0.3
        for _ in range(len(words) // 15 + 2 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zzzslur", "QQXbad" + rng.choice("abc")])
        out.append(" ".join(words))
        label.append(int(bad))
    return out, np.array(label)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    net = X.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 50, (30, 1 + len(X.LEADING) + len(X.TRAILING)))
    begin, size = np.array([0, 12, 20]), np.array([12, 8, 10])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradient(ids, begin, size, y, w)
    for k in g:
        for at in [tuple(rng.integers(0, min(50, n)) for n in net.p[k].shape) for _ in range(4)]:
            old = net.p[k][at]
            sides = []
            for d in (1e-3, -1e-3):
                net.p[k][at] = old + d
                sides.append(net.gradient(ids, begin, size, y, w)[0])
            net.p[k][at] = old
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=2e-2, abs=2e-5), (k, at)


def test_windows_cover_every_word_and_overlap():
    begin, size, text = X.windows_of(np.array([0, 1, 48, 49, 500]))
    for t, n in enumerate([0, 1, 48, 49, 500]):
        first = sum([0, 1, 48, 49, 500][:t])
        seen = {w for b, s in zip(begin[text == t], size[text == t]) for w in range(b, b + s)}
        assert seen == set(range(first, first + n))
    start, end, *_, owner = spans_and_sums([b"One, two", b"", "é-x".encode()], LETTERS)
    assert owner.tolist() == [0, 0, 2, 2]


def test_learns_and_scores_unseen_texts():
    given, label = corpus(600, 1)
    model = X.train(given, label)
    new, truth = corpus(300, 2)
    s = model.scores(new)
    assert ((s >= 0.5) == truth).mean() > 0.9 and s.min() >= 0 and s.max() <= 1
    assert np.allclose(s[:10], [model.scores([t])[0] for t in new[:10]], atol=1e-4)
    assert X.train(given, np.zeros(600)) is None


def test_long_texts_in_parts_score_like_whole_ones(monkeypatch):
    given, label = corpus(300, 3)
    model = X.train(given, label)
    rng = random.Random(4)
    long = [" ".join(given[:200]), "\u00e9\u4e2d" * 30_000, "x" * 50_000 + " y", *(" ".join(given)[: rng.randrange(20_001, 90_000)] for _ in range(12)), ", ".join(given[:90]) + "." * 30_000, "." * 50_000]
    whole = [model.net.logits(*_windows(t)) if len(t) else np.empty(0) for t in long]
    scores = model.scores(long)
    monkeypatch.setattr(X, "PIECE", 20_000)
    for t, want in zip(long, whole):
        assert len(t.encode()) > X.PIECE
        np.testing.assert_allclose(model._long_logits(t.encode()), want, atol=1e-4)
    np.testing.assert_allclose(model.scores(long), scores, atol=1e-5)


def _windows(t):
    ids, of = X.word_inputs([t.encode()])
    begin, size, _ = X.windows_of(np.bincount(of, minlength=1))
    return ids, begin, size


def test_a_text_over_a_megabyte_scores_like_an_unsplit_one(monkeypatch):
    given, label = corpus(300, 5)
    model = X.train(given, label)
    long = " ".join(given * 9)[: 3 << 20]
    split = model.scores([long, "short"])
    monkeypatch.setattr(X, "PIECE", 1 << 30)
    assert len(long) > 1 << 20
    np.testing.assert_allclose(split, model.scores([long, "short"]), atol=1e-6)


def test_sampled_windows_depend_on_the_text_alone():
    given = [t.encode() for t in corpus(30, 6)[0]] + [b"", b" ".join(b"w%d" % i for i in range(5000))]
    words, size, text = X.sampled_windows(given)
    assert np.bincount(text, minlength=32).max() == X.SAMPLE_WINDOWS
    at = np.r_[0, np.cumsum(size)]
    for i in (3, 30, 31):
        alone = X.sampled_windows([given[i]])
        own = np.flatnonzero(text == i)
        assert alone[1].tolist() == size[own].tolist()
        assert np.array_equal(alone[0], words[at[own[0]] : at[own[-1] + 1]] if len(own) else words[:0])


def test_held_out_rows_of_the_tables(spark):
    import zlib

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    out = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) >= 0.85
    given = {r.doc_id for r in X.remove_toxic(docs, labels).collect()}
    assert given == {i for i, r in got.items() if not r.predicted}


def test_awkward_rows(spark):
    given, label = corpus(200, 4)
    rows = awkward_rows()
    base = 10_000
    docs = frame(spark, rows + [(base + i, t, None, None, 0, None, None) for i, t in enumerate(given)])
    labels = spark.createDataFrame([(base + i, int(v)) for i, v in enumerate(label)] + [(None, 1), (base, None), (base + 1, int(label[1])), (99999999, 1), (base + 2, 7)], LABELS)
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(given)
    assert [r.score for r in got if r.doc_id in (0, 1, 2)] == [0.0] * 3
    assert X.toxicity(frame(spark, []), labels).collect() == []
    none = X.toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(got)
    kept = X.remove_toxic(frame(spark, rows), spark.createDataFrame([], LABELS))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)


def test_other_columns_may_have_any_names(spark):
    given, label = corpus(120, 8)
    docs = spark.createDataFrame([(i, t, 1.5, 2.5) for i, t in enumerate(given)], "doc_id long, text string, score double, __score double").selectExpr("*", "score as SCORE_", "1 as k", "2 as h", "3 as toxic", "4 as `a.b`", "5 as c0")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], LABELS)
    kept = X.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert 0 < len(got) < 120 and {tuple(r)[2:] for r in got} == {(1.5, 2.5, 1.5, 1, 2, 3, 4, 5)}
