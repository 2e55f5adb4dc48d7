import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import resampling as R
from tests.llm.helpers import awkward_rows, frame, words


def runs(t, run=2):
    w = words(t)
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, least=20, percent=25, seed=7, n=10000):
    count = lambda ts: np.bincount([zlib.crc32(f.encode()) % n for t in ts for f in runs(t)], minlength=n)
    s, t = count([d[1] for d in docs]), count(target)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (S + n) / ((int(a) + 1) * (T + n)))) for a, b in zip(s, t)]
    out, enough = [], []
    for i, text in docs:
        f = [gain[zlib.crc32(x.encode()) % n] for x in runs(text)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(text)) >= least:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return sorted(out, key=repr)


def got(df):
    return sorted(map(list, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_crc_algebra():
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 63, 64, 65, 300]))) for _ in range(400)]
    a, b = parts[::2], parts[1::2]
    ca, cb, n = (np.array(x) for x in ([zlib.crc32(x) for x in a], [zlib.crc32(x) for x in b], [len(x) for x in b]))
    whole = R.shifted(ca.astype(np.uint32), n) ^ cb.astype(np.uint32)
    assert whole.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
    assert R.followed_by_space(ca.astype(np.uint32)).tolist() == [zlib.crc32(x + b" ") for x in a]


def test_features_equal_strings():
    rng = random.Random(6)
    texts = ["", "one", "One TWO three", "é" * 70 + " B-b " + "x" * 5000, " ".join("".join(rng.choices("abcÀß9", k=rng.randrange(1, 90))) for _ in range(300)), " - "]
    for run in (1, 2, 3, 4):
        crc, owner, n = R.features([t.encode() for t in texts], run)
        assert n.tolist() == [len(words(t)) for t in texts]
        for i, t in enumerate(texts):
            assert sorted(crc[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in runs(t, run))


def test_whole_table_equals_plain(spark, data):
    docs, target = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert got(R.resampled(docs, target)) == want
    assert got(R.resampled(docs.repartition(6), target)) == want


def test_awkward_tables(spark):
    rows = awkward_rows()
    target = spark.createDataFrame([("one two word1 word2",), (None,)], "text string")
    assert got(R.resampled(frame(spark, rows), target, least_words=1)) == plain([(r[0], r[1]) for r in rows], ["one two word1 word2"], least=1)
    assert R.resampled(frame(spark, []), target).count() == 0
    none = got(R.resampled(frame(spark, rows), target.limit(0)))
    assert none == plain([(r[0], r[1]) for r in rows], [])
    ties = [(i % 40, " ".join(["same"] * 25), None, None, None, None, None) for i in range(80)]
    assert got(R.resampled(frame(spark, ties), target)) == plain([(r[0], r[1]) for r in ties], ["one two word1 word2"])


def test_draw_prefers_the_target(spark):
    rng = random.Random(8)
    text = lambda v: " ".join(rng.choices(v, k=60))
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    rows = [(i, text(near if i % 4 == 0 else far), None, None, None, None, None) for i in range(400)]
    target = spark.createDataFrame([(text(near),) for _ in range(50)], "text string")
    docs = frame(spark, rows).withColumn("drawn", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = R.draw(docs, target)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == 100 and sum(i % 4 == 0 for i in ids) > 80
