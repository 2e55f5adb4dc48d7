"""Batches, chats, scores, transport, sinks and streams on small inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import mentions, spellings
from loomgraph.operators import batching as B
from loomgraph.operators import chat as H
from loomgraph.operators import neural as N
from loomgraph.operators import prompts as P
from loomgraph.operators import scoring as S
from loomgraph.plans.graph_queries import example_weights
from loomgraph.sources import catalog, tables
from loomgraph.streaming.answers import append_stream, running_accuracy, stream_answers


def test_even_chunks():
    chunks = B.even_chunks(list(range(8)), [9, 7, 6, 5, 4, 3, 2, 1], 4)
    assert [len(c) for c in chunks] == [2] * 4 and sorted(sum(chunks, [])) == list(range(8))
    assert B.even_chunks([5, 6, 7], [3, 2, 1], 2) == [[0, 2], [1]]


def test_modality_batches_keep_every_row(spark):
    df = spark.createDataFrame([(i, (i + 1) * (1 if i % 3 else -1)) for i in range(50)], "id long, length long")
    got = B.modality_batches(df, 8).collect()
    assert sorted(r.id for r in got) == list(range(50))
    for name in {r.batch for r in got} - {"tail"}:
        assert len([r for r in got if r.batch == name]) == 8 and len({r.modality for r in got if r.batch == name}) == 1
    assert B.modality_batches(df.where("length > 0"), 8).count() == 33


def test_label_spellings(spark):
    df = spark.createDataFrame([("Diabetes_Mellitus  Type2", "it is diabetes mellitus TYPE 2"), ("Case_Based", "case  based"), ("Theory", "none"), ("Type 1", "type_1!")], "label string, text string")
    assert [r.x for r in df.select(mentions(F.col("text"), F.col("label")).alias("x")).collect()] == [True, True, False, True]
    assert df.select(spellings(F.col("label")).alias("s")).first().s == ["diabetes mellitus type2", "diabetes mellitus type 2"]


def test_ranking_equals_counting_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("yes" if rng.random() < 0.4 else "no", round(float(rng.random()), 2)) for _ in range(300)]
    pos, neg = [s for g, s in rows if g == "yes"], [s for g, s in rows if g == "no"]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    scores = spark.createDataFrame(rows, "gt string, score double")
    r = S.ranking(scores).first()
    assert (r.n_pos, r.n_neg) == (len(pos), len(neg)) and r.auc == pytest.approx(auc, abs=1e-6)
    hits = {r.k: r.hits for r in S.hits_at(scores).collect()}
    assert set(hits) == {k for k in (10, 50, 100, 200, 500, 1000) if k <= len(neg)}
    assert hits[10] == pytest.approx(np.mean([p > sorted(neg)[-10] for p in pos]), abs=1e-6)


def test_link_accuracy_and_repeats(spark):
    df = spark.createDataFrame([(1, "yes", "yes"), (2, "no", "no"), (3, "yes", "no"), (3, "maybe", "yes"), (4, "", "no")], "question_id long, text string, gt string")
    r = S.link_accuracy(df).first()
    assert (r.n, r.correct) == (5, 3)
    assert [tuple(x) for x in S.repeated_ids(df).collect()] == [(3, 2)]


def test_transport_is_optimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        a, b = rng.standard_normal((n, 3)), rng.standard_normal((n, 3))
        best = min(np.mean([((a[i] - b[p[i]]) ** 2).sum() for i in range(n)]) for p in itertools.permutations(range(n)))
        assert N.transport_cost(a, b) == pytest.approx(best)
    assert N.transport_cost(np.zeros((2, 2)), np.array([[1.0, 0], [0, 0], [1, 0]])) == pytest.approx(2 / 3)


def test_transport_of_unequal_numbers():
    rng = np.random.default_rng(1)
    for n, m in ((2, 3), (3, 2), (2, 4), (6, 4)):
        cost = rng.random((n, m))
        flow = N.transport(cost)
        assert flow.min() >= 0 and len(set(flow.sum(axis=1))) == len(set(flow.sum(axis=0))) == 1
        if n * m <= 8:
            k = int(np.lcm(n, m))
            wide = np.repeat(np.repeat(cost, k // n, axis=0), k // m, axis=1)
            best = min(sum(wide[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
            assert (flow * cost).sum() == pytest.approx(best * flow.sum() / k)
    cost = rng.random((97, 101))
    flow = N.transport(cost)
    assert set(flow.sum(axis=1)) == {101} and set(flow.sum(axis=0)) == {97}
    low = [cost[i, j] for i, j in zip(*np.nonzero(flow))]
    assert np.count_nonzero(flow) <= 97 + 101 and np.mean(low) < 0.1


def test_prices_prove_a_transport_best():
    """What a flow costs is what its prices are worth: no flow of any kind costs less."""
    rng = np.random.default_rng(4)
    for n, m in ((400, 150), (150, 400), (300, 300), (7, 1)):
        a, b = rng.standard_normal((n, 8)), rng.standard_normal((m, 8)) + 0.3
        cost = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        rows, columns, units, price = N.flows(n, m, lambda some, cost=cost: cost[some])
        unit = math.gcd(n, m)
        assert (np.bincount(rows, units, n) == m // unit).all() and (np.bincount(columns, units, m) == n // unit).all() and units.min() > 0
        paid = (cost[rows, columns] * units).sum() / units.sum()
        assert (cost + price).min(axis=1).mean() - price.mean() == pytest.approx(paid, abs=1e-9) == N.transport_cost(a, b)


def test_transport_among_copies_and_points_in_one_place():
    same = np.ones((60, 3))
    assert N.transport_cost(same, same[:25]) == 0
    rng = np.random.default_rng(5)
    few = rng.standard_normal((4, 3))
    assert N.transport_cost(np.repeat(few, 30, axis=0), np.repeat(few, 11, axis=0)) == pytest.approx(0, abs=1e-12)
    assert N.transport_cost(same, np.zeros((7, 3))) == pytest.approx(3)


def test_groups_are_tasks_of_their_own_and_a_side_may_be_large(spark):
    new = spark.range(5000).selectExpr("array(double(id % 10), 0D) as e")
    groups = spark.createDataFrame([("one", [0.0, 0.0]), (None, [0.0, 1.0]), ("two", [0.0, 0.0]), ("two", [9.0, 0.0])], "name string, e array<double>")
    got = N.transport_to_groups(new, groups)
    assert got.rdd.getNumPartitions() == 3
    assert {r.name: r.distance for r in got.collect()} == {"one": 28.5, None: 29.5, "two": 6.0}
    with pytest.raises(ValueError):
        N.transport_to_groups(new, groups, most=1)
    assert N.transport_to_groups(new.limit(0), groups).collect() == []


def test_closest_by_votes(spark):
    rng = np.random.default_rng(2)
    new = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(40)], "id long, e array<double>")
    groups = [(name, k, [float(x) for x in rng.standard_normal(4) + shift]) for name, shift in (("near", 0.1), ("far", 3.0)) for k in range(30 if name == "near" else 7)]
    got = N.closest_by_votes(new, spark.createDataFrame(groups, "name string, id long, e array<double>"), size=9, draws=5).collect()
    assert [tuple(r) for r in got] == [("near", 5)]


def test_blocks_of_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((23, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    got = {(r.a, r.b): r.sim for r in S.pair_cosines(df, df, block=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 23 * 23 and all(got[i, j] == pytest.approx(u[i] @ u[j], abs=1e-6) for i, j in got)
    other = spark.createDataFrame([(i, (v + 0.1).tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    one, many = ({r.id: r.loss for r in S.contrastive_loss(df, other, block=b).collect()} for b in (1000, 4))
    assert one == pytest.approx(many, abs=2e-6) and len(one) == 23


def test_pooling():
    x = np.arange(12.0).reshape(4, 3)
    out = N.attention_pool(x, np.zeros((2, 3)))
    assert np.allclose(out, 0)
    states, mask = np.arange(12.0).reshape(2, 3, 2), np.array([[1, 1, 0], [1, 0, 0]])
    assert N.last_token(states, mask).tolist() == [[2.0, 3.0], [6.0, 7.0]]
    assert N.last_token(states, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == [[4.0, 5.0], [10.0, 11.0]]


def test_chats(spark):
    turns = spark.createDataFrame([(1, 1, "gpt", "B"), (1, 0, "human", "A <graph>"), (1, 2, "human", None), (2, 0, "system", "S")], "conv_id long, turn long, role string, text string")
    m = H.ordered(turns)
    first = m.where("conv_id = 1")
    say = lambda c: first.select(c.alias("x")).first().x
    assert say(H.rendered(F.col("messages"), "mistral")) == "[INST] A <graph> [/INST]B</s>[INST]  [/INST]"
    assert say(H.rendered(F.col("messages"), "vicuna", ask=True)).endswith("USER: A <graph> ASSISTANT:B</s>USER:  ASSISTANT:")
    assert say(H.legacy(F.col("messages"), "two", "S")) == "S###USER: A <graph>###ASSISTANT: B</s>USER:"
    assert say(H.legacy(F.col("messages"), "llama2", "S")) == "[INST] <<SYS>>\nS\n<</SYS>>\n\nA <graph> [/INST] B </s>"
    assert [tuple(x) for x in say(H.tokens_and_labels(F.col("messages")))] == [("A", "-100"), ("-200", "-100"), ("B", "B")]
    assert m.where("conv_id = 2").select(H.legacy(F.col("messages"), "plain", "S").alias("x")).first().x == "S"
    names = spark.createDataFrame([("Qwen3-30B-A3B",), ("My-Llama-3.1",), ("mistral-7b",), ("other",), ("vicuna",)], "n string")
    assert [r.f for r in names.select(H.family(F.col("n")).alias("f")).collect()] == ["qwen3_moe", "llama3", "mistral", "vicuna", "vicuna"]


def test_stops(spark):
    assert H.stop_ids({"</s>": 2, "x": 1, "<|im_end|>": 9}, "</s>") == [2, 9] and H.stop_ids({}) == []
    df = spark.createDataFrame([(["a", "</s>", "b", "<|eot_id|>"],), (["a"],), (["<|im_end|>"],)], "t array<string>")
    assert [r.x for r in df.select(H.until_stop(F.col("t")).alias("x")).collect()] == [["a"], ["a"], []]


def test_prompt_texts(spark):
    assert "".join(P.pieces("citeseer")).startswith("Given a node-centered citation graph: <graph>,each node represents a paper.The 0th node is the central node, with the following information: Title: , Abstract: {text}.The graph")
    with pytest.raises(ValueError):
        P.pieces("bookchild")
    df = spark.createDataFrame([(None, None, None)], "r string, t string, a string")
    with pytest.raises(Exception, match="neither text"):
        df.select(P.assemble_text(F.col("r"), F.col("t"), F.col("a"))).collect()
    say = lambda task, t, a: spark.range(1).select(P.description(task, F.lit("L"), F.lit(t), F.lit(a)).alias("x")).first().x
    assert say("nda", "", "b") == "This is a paper in L domain, its abstract is b."
    assert say("nda", "t", "") == "This is a paper in L domain, its title is t."
    assert say("nd", "", "b") == "This is a paper in L domain"


def test_catalog():
    assert catalog.parse_spec("a-b.3") == [("a", 1), ("b", 3)]
    assert [catalog.known_name(n) for n, _ in catalog.parse_spec("my_cora_v2.2-ogbn_arxiv_cora-double")] == ["cora", "arxiv", "double"]
    with pytest.raises(ValueError, match="no data set"):
        catalog.known_name("core")
    assert catalog.Catalog("/x").dataset("arxiv", "nodes") == "/x/datasets/ogbn-arxiv/nodes.parquet"


def test_streamed_answers_are_appended_once(spark, tmp_path):
    rows = [(i % 7, "yes", "yes" if i % 2 else "no") for i in range(10)]
    df = spark.createDataFrame(rows, "question_id long, text string, gt string")
    df.write.json(str(tmp_path / "in"))
    for _ in range(2):
        append_stream(stream_answers(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    append_stream(stream_answers(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "other")).awaitTermination()
    assert sorted(r.question_id for r in tables.read_answers(spark, str(tmp_path / "out")).collect()) == list(range(7))
    q = running_accuracy(stream_answers(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("acc").first()) == (10, 5)


def test_encoder_takes_blank_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "id long, text string")
    got = {r.id: r.e for r in N.encoded(df, N.hashing_encoder(4)).collect()}
    assert len(got) == 3 and got[2] == [0.0] * 4 and abs(sum(x * x for x in got[1]) - 1) < 1e-9


def test_motif_network_equals_matrices(spark):
    n, rng = 9, np.random.default_rng(3)
    x = rng.normal(size=(n, 6))
    motifs = [[(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p] for p in (0.4, 0.15)]
    rows = example_weights(6, 5, 7, 3, 2)
    w = N.read_weights(spark.createDataFrame(rows, "name string, row long, e array<double>"))
    frames = [spark.createDataFrame(m, "src long, dst long") for m in motifs]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")
    got = {r.id: r.e for r in N.motif_network(v, frames, w).collect()}
    h = x @ w["shared.weight"].T + w["shared.bias"]
    h = np.array([[t * 0.5 * (1 + math.erf(t / math.sqrt(2))) for t in r] for r in h])
    want = np.zeros((n, 3))
    for i, m in enumerate(motifs):
        a = np.zeros((n, n))
        for s, d in m:
            a[s, d] = 1
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1)
        z = np.maximum(a @ h @ w[f"first.{i}.near"].T + w[f"first.{i}.bias"] + h @ w[f"first.{i}.own"].T, 0)
        z = (z - w[f"norm.{i}.mean"]) / np.sqrt(w[f"norm.{i}.variance"] + 1e-5) * w[f"norm.{i}.scale"] + w[f"norm.{i}.shift"]
        want += w["fusion"][0, i] * (a @ z @ w[f"second.{i}.near"].T + w[f"second.{i}.bias"] + z @ w[f"second.{i}.own"].T)
    assert sorted(got) == list(range(n)) and np.allclose([got[i] for i in range(n)], want)


def test_splicing_takes_a_graph_for_each_sentinel(spark):
    pairs = spark.sql("select array(named_struct('token', 'a', 'label', '-100'), named_struct('token', '-200', 'label', '-100'), named_struct('token', '-200', 'label', '-100'), named_struct('token', '-200', 'label', '-100'), named_struct('token', 'b', 'label', 'b')) t, array(array(1L, -500L), array(2L)) g, array(named_struct('token', 'c', 'label', 'c')) u, cast(null as array<array<long>>) n")
    r = pairs.select(H.with_graphs(F.col("t"), F.col("g")).alias("x"), H.with_graphs(F.col("u"), F.col("g")).alias("y"), H.with_graphs(F.col("t"), F.col("n")).alias("z"), H.with_graphs(F.col("t"), F.col("g"), pads_seen=True).alias("w")).first()
    assert [tuple(p) for p in r.x] == [("a", "-100", True), ("n1", "-100", True), ("n-500", "-100", False), ("n2", "-100", True), ("b", "b", True)]
    assert [tuple(p) for p in r.y] == [("c", "c", True)] and [p.token for p in r.z] == ["a", "b"] and all(p.seen for p in r.w)


def test_answer_ids_follow_from_the_answer(spark):
    a = spark.createDataFrame([(1, "p", "x", None), (1, "p", "y", None), (2, None, None, "own")], "question_id long, prompt string, text string, answer_id string")
    ids = {(r.question_id, r.text): r.answer_id for r in tables.with_answer_ids(a).collect()}
    assert ids == {(r.question_id, r.text): r.answer_id for r in tables.with_answer_ids(a.repartition(3)).collect()}
    assert len(set(ids.values())) == 3 and ids[2, None] == "own" and len(ids[1, "x"]) == 22


def test_the_first_answer_of_a_question_stays(spark, tmp_path):
    """Of a batch the least answer_id, of several batches the earliest; a replayed batch writes the same again."""
    import os

    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda q, a: (q, f"text {a}", a)

    def arrive(rows):
        spark.createDataFrame(rows, "question_id long, text string, answer_id string").coalesce(1).write.mode("append").json(source)
        append_stream(stream_answers(spark, source), out, check).awaitTermination()
        return {r.question_id: r.answer_id for r in tables.read_answers(spark, out).collect()}

    assert arrive([row(1, "b"), row(1, "a"), row(2, "z"), (None, "none", "0")]) == {1: "a", 2: "z"}
    assert arrive([row(1, "0"), row(2, "0"), row(3, "c")]) == {1: "a", 2: "z", 3: "c"}
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{n}"):
            os.remove(f"{check}/commits/{n}")  # as if the run had ended before it could say that the batch is done
    assert arrive([row(4, "d"), row(3, "0")]) == {1: "a", 2: "z", 3: "c", 4: "d"}
    assert tables.read_answers(spark, out).count() == 4


def test_a_batch_reads_its_own_answers_only(spark, tmp_path):
    """What the stream has written before is not read again: a later batch goes through as many rows as it has."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(3):
        spark.range(k * 50, k * 50 + 50).select(F.col("id").alias("question_id"), F.lit("yes").alias("text")).coalesce(1).write.mode("append").json(source)
        q = append_stream(stream_answers(spark, source), out, check)
        q.awaitTermination()
        done = [p for p in q.recentProgress if p.numInputRows]
        assert [p.numInputRows for p in done] == [50] and len(done[0].sources) == 1
    assert tables.read_answers(spark, out).count() == 150
