"""The pipeline, stage by stage, against brute force on small tables."""

from collections import defaultdict

import corpus_pipeline as C
from loomgraph.llm import packing, toxicity
from tests.llm.helpers import awkward_rows, frame
from tests.llm.test_decontaminate import plain as plain_windows
from tests.llm.test_linededup import plain_dedup
from tests.llm.test_neardup import plain_components

D = "/root/testdata/sf0.01"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 400")
    names = docs.columns
    bench = spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, D).write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(path)
        if name == "packing":
            break
        assert out.columns == names
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        ids = sorted(before)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
            score = model.scores([before[i].text for i in ids])
            assert {i for i, s in zip(ids, score) if s < 0.5} == set(after) and after == {i: before[i] for i in after}
        elif name == "line dedup":
            want = plain_dedup({i: before[i].text for i in ids})
            assert set(after) == {i for i in ids if not want[i][3]}
            assert all(after[i].text.encode().lower().split() == want[i][0] for i in after)
        elif name == "near-dedup":
            sets = {i: shingles(before[i].text) for i in ids}
            comp = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b])])
            assert set(after) == set(comp.values()) and after == {i: before[i] for i in after}
        else:
            hit = plain_windows([(i, before[i].text) for i in ids], bench)
            assert set(after) == {i for i in ids if not hit[i][4]}
        docs = out
    placed = out.collect()
    assert {r.doc_id for r in placed} == set(before)
    bins = defaultdict(list)
    for r in placed:
        if r.bin is not None:
            bins[r.bin].append(r)
    assert all(sum(r.n_words for r in b) <= packing.CAPACITY and len({before[r.doc_id].source for r in b}) == len(b) for b in bins.values())
    assert sum(r.n_words for r in placed) == sum(len(r.text.encode().split()) for r in before.values())


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = frame(spark, awkward_rows())
    for name, stage in C.STAGES:
        stage(spark, docs, D).write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(path)
    empty = frame(spark, [])
    for name, stage in C.STAGES:
        assert stage(spark, empty, D).collect() == []
