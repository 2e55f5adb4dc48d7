"""Labels of the older formats against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chat as H
from loomgraph.operators import masking as M


def cut(text, opened=True):
    return (["<s>"] if opened else []) + ["-200" if p == "<graph>" else p for p in re.findall(M.PIECE, text)]


def by_rounds(tokens, rounds, asked, place, opened, extra, around):
    out, at = ["-100"] * len(tokens), place
    for r in rounds:
        parts = r.split(asked)
        if r == "" or len(parts) != 2:
            break
        n = len(cut(r, opened)) + extra
        told = max(0, len(cut(parts[0] + asked, opened)) - around)
        out[at + told : at + n] = tokens[at + told : at + n]
        at += n
    return out if at == len(tokens) else ["-100"] * len(tokens)


def plain(name, prompt):
    if name == "llama2":
        return (t := cut(prompt)), by_rounds(t, prompt.split("</s>"), "[/INST] ", 1, True, 0, 2)
    if name == "mpt":
        x = prompt.split("<|im_end|>")
        rounds = ["<|im_end|>".join(x[:3]), *("<|im_end|>".join(x[i : i + 2]) for i in range(3, len(x), 2))]
        return (t := cut(prompt, False)), by_rounds(t, rounds, "<|im_end|><|im_start|>assistant\n", 0, False, 1, 0)
    tokens, out, speaks = cut(prompt), [], False
    for t in tokens:
        out.append(t if speaks else "-100")
        speaks = (speaks or t == "ASSISTANT:") and t != "</s>"
    return tokens, out


def messages(rng, n, odd):
    words = lambda: " ".join(rng.choices(["one", "two", "a<b", "#x", "<graph>", "é.", "\n"], k=rng.randrange(1, 9)))
    out = [("user" if (i + odd) % 2 == 0 else "assistant", words()) for i in range(n)]
    return [(i, *m) for i, m in enumerate(out)]


@pytest.mark.parametrize("style,labels", [("llama2", M.instruction_labels), ("mpt", M.turn_labels), ("two", M.marker_labels)])
def test_labels_equal_a_plain_scan(spark, style, labels):
    rng = random.Random(4)
    rows = [(i, *m) for i in range(40) for m in messages(rng, rng.randrange(0, 8), i % 5 == 0)]
    given = H.ordered(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    words = next(t[1:] for t in H.TEMPLATES.values() if t[0] == style)
    prompts = given.select("conv_id", H.legacy(M.from_user(F.col("messages")), style, *words).alias("p"))
    extra = spark.createDataFrame([(100, ""), (101, "[INST] a [/INST] b"), (102, "x </s> y [/INST] z</s>"), (103, "<|im_end|><|im_end|>"), (104, "ASSISTANT: ASSISTANT: a</s>b</s> ASSISTANT:")], "conv_id long, p string")
    got = prompts.unionByName(extra).select("p", labels(F.col("p")).alias("t")).collect()
    supervised = 0
    for r in got:
        tokens, want = plain(style, r.p)
        assert ([x.token for x in r.t], [x.label for x in r.t]) == (tokens, want), r.p
        supervised += any(x != "-100" for x in want)
    assert supervised > 10


def test_a_prompt_whose_rounds_do_not_add_up_is_ignored(spark):
    bad = "[INST] q [/INST] a </s> stray </s>"
    (r,) = spark.createDataFrame([(bad,)], "p string").select(M.instruction_labels(F.col("p")).alias("t")).collect()
    assert {x.label for x in r.t} == {"-100"} and len(r.t) == len(cut(bad))


def test_speakers(spark):
    rows = [(1, 0, "assistant", "left out"), (1, 1, "user", "what is <graph>"), (1, 2, "assistant", "it is"), (2, 0, "user", ""), (3, 0, "assistant", "x")]
    given = H.ordered(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).select("conv_id", M.speaker_labels(M.from_user(F.col("messages")), "Hello there.").alias("t"))
    got = {r.conv_id: [(x.token, x.label) for x in r.t] for r in given.collect()}
    no = "-100"
    assert got[1] == [("<s>", no), ("Hello", no), ("there.", no), ("###", "###"), ("Human:", "Human:"), ("what", no), ("is", no), ("-200", no), ("###", no), ("Assistant:", "Assistant:"), ("it", "it"), ("is", "is"), ("###", "###")]
    assert got[2][3:] == [("###", "###"), ("Human:", "Human:"), ("###", no)]
    assert got[3][3:] == [("###", "###")]
