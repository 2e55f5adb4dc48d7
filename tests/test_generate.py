import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.graph import symmetrize
from loomgraph.plans.generate import context_prompts, evaluate, write_dataset
from loomgraph.sources.tables import read_prompts


@pytest.fixture
def graph(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, i % 7, "test" if i % 4 == 0 else "train", f"T{i}", None if i % 8 == 0 else f"A{i}") for i in range(30)], "id long, y int, split string, title string, abstract string")
    edges = symmetrize(spark.createDataFrame([(i, rng.randrange(29)) for i in range(29) for _ in range(3)], "src long, dst long").where("src <> dst"))
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "id long, e array<double>")
    return nodes, edges, vectors


@pytest.mark.parametrize("large", [False, True])
def test_records(graph, large):
    got = {r.id: r for r in context_prompts("cora", *graph, large=large).collect()}
    assert set(got) == set(range(0, 30, 4))
    for i, r in got.items():
        assert len(r.graph) == 111 and r.graph[0] == i
        human, gpt = r.conversations
        assert human["from"] == "human" and f"Title: T{i}, Abstract: {'' if i % 8 == 0 else f'A{i}'}." in human["value"]
        assert gpt["value"] == ["Case Based", "Genetic Algorithms", "Neural Networks", "Probabilistic Methods", "Reinforcement Learning", "Rule Learning", "Theory"][i % 7]


def test_files_of_splits(spark, graph, tmp_path):
    assert [p[-15:] for p in write_dataset("cora", *graph, str(tmp_path))] == ["/ocs_test.jsonl"]
    paths = write_dataset("cora", *graph, str(tmp_path), force_train=True)
    assert [read_prompts(spark, p).count() for p in paths] == [22, 8]


def test_scorers(spark):
    a = spark.createDataFrame([(1, "yes", "yes", [2.0, 0.0]), (2, "no", "yes", [0.0, 1.0]), (3, "no", "no", [0.0, 3.0])], "question_id long, text string, gt string, logit array<double>")
    assert evaluate("cora", "lp", a).first().acc == pytest.approx(2 / 3, abs=1e-6)
    assert evaluate("cora", "lprank", a).first().auc == 1.0
    assert evaluate("cora", "nc", a.where(F.col("question_id") != 2)).first().acc == 1.0
    with pytest.raises(ValueError):
        evaluate("cora", "none", a)
