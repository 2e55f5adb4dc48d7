"""Mentions of very many strings against a plain search."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import matching as M
from loomgraph.operators import scoring as S


def strings(spark, rows):
    return spark.createDataFrame(rows, "plain string, tight string, class long")


def plain(texts, rows):
    return [sorted({c for p, t, c in rows if (p is not None and p in text) or (t is not None and t in (tight or ""))}) if text is not None else [] for text, tight in texts]


def test_mentions_equal_plain_search_in_any_shards(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abÀ ", k=rng.randrange(1, 6)))
    rows = [(w, w.replace(" ", "") if i % 3 else None, i // 2) for i, w in enumerate(word() for _ in range(200))] + [("", None, 900), (None, None, 901)]
    texts = [(t, t.replace(" ", "")) for t in ("".join(rng.choices("abÀ c", k=rng.randrange(0, 40))) for _ in range(60))] + [(None, None), ("", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, text string, tight string").withColumn("__plain", F.lit("mine")).withColumn("a.b", F.lit(1))
    for most in (M.SHARD_BYTES, 700, 1):
        got = M.with_classes(df, strings(spark, rows), F.col("text"), F.col("tight"), most=most)
        assert got.columns == [*df.columns, "classes"]
        assert [r.classes for r in got.orderBy("id").collect()] == plain(texts, rows), most
        if most == 1:
            break
        rows, texts = rows[:40] + rows[-2:], texts[-20:]
        df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, text string, tight string")


def test_a_hundred_thousand_labels(spark):
    labels = spark.range(100_000).select(F.concat(F.lit("class "), F.col("id").cast("string"), F.lit("_end")).alias("label"))
    said = [(i, f"it is CLASS {i * 911} end or class {i}_end", f"class {i * 911}_end") for i in range(40)]
    answers = spark.createDataFrame(said, "question_id long, text string, gt string")
    known = [f"class {i}_end" for i in range(100_000)]
    want = sum(t.lower() != g and g in t.lower() and sum(k in t.lower() for k in known) <= 2 for _, t, g in said)
    (got,) = S.tolerant_classes(answers, labels).collect()
    assert got.n == 40 and got.overall_acc == round(want / 40, 6)
    gts = {r.question_id: r for r in S.generic_classes(answers.unionByName(labels.select((F.monotonically_increasing_id() + 1000).alias("question_id"), F.lit("none").alias("text"), F.col("label").alias("gt")))).where("question_id < 40").collect()}
    folded = [k.replace("_", " ") for k in known]
    for i, t, g in said:
        low = t.lower().replace("_", " ")
        assert gts[i].hits == sum(k in low or k.replace(" ", "") in low.replace(" ", "") for k in folded) and gts[i].hit


def test_no_labels_and_repeated_ones(spark):
    answers = spark.createDataFrame([(1, "a cat", "cat"), (2, None, "dog"), (3, "cat and dog", None)], "question_id long, text string, gt string")
    labels = spark.createDataFrame([("cat",), ("cat",), (None,)], "label string")
    assert S.tolerant_classes(answers, labels, most=1).first().overall_acc == 0.0
    assert S.tolerant_classes(answers, labels, most=2).first().overall_acc == 1.0
    assert S.tolerant_classes(answers, labels.limit(0)).first().n == 3
