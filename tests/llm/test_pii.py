import hashlib
import re

import pytest

from loomgraph.llm import pii as P
from tests.llm.helpers import awkward_rows, frame, texts


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CASES = [
    "mail a.b@c.de_x@y.zz and a@b@c.d.e x@y é\U0001f600 q@r.st",
    "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.2.3.9 1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 5500005555555559 1-a 1 2",
    "+1 (555) 123-4567 +12 +1-2-3-4-5-6-7-8-9-0. +1 5551234567890123456789",
    "@@@@ a@ .@. +-+-",
    "GB82 WEST 1234 5698 7654 32 is the IBAN; GB82 WEST 1234 5698 7654 33 is not. SSN 123-45-6789 and then some more plain words follow on here. order 123-45-6788",
    "+15551234567@x.com 10.0.0.1@h.io",
]


def test_base_spans_equal_plain_rules(spark, data):
    got = {r.doc_id: r for r in P.personal_data(texts(spark, CASES)).collect()}
    for i, t in enumerate(CASES):
        want = base_spans(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)], t
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest(), (t, r.spans, said(want))
        assert set(said(want).split(",")) - {""} <= set(r.spans.split(","))
    assert got[5].n_iban == 1 and got[5].n_ssn == 1
    docs = spark.read.parquet(f"{data}/documents.parquet")
    raw = dict(docs.select("doc_id", "text").collect())
    for r in P.personal_data(docs).collect():
        assert r.base_sha256 == hashlib.sha256(said(base_spans(raw[r.doc_id])).encode()).hexdigest()


def test_random_texts(spark):
    import random

    rng = random.Random(3)
    bag = ["@", ".", "a", "b_", "+", "1", "22", "255", "4111111111111111", " ", "-", "(", ")", "é", "x.y", "%"]
    made = ["".join(rng.choice(bag) for _ in range(rng.randrange(60))) for _ in range(400)]
    for r in P.personal_data(texts(spark, made)).collect():
        assert r.base_sha256 == hashlib.sha256(said(base_spans(made[r.doc_id])).encode()).hexdigest(), made[r.doc_id]


def test_long_and_awkward(spark):
    rows = awkward_rows() + [(90, "x." * 30000 + "@", None, None, 0, None, None), (91, "12 " * 40000, None, None, 0, None, None), (92, "a1@b.cc " * 3000, None, None, 0, None, None), (93, "A1" * 40000, None, None, 0, None, None), (94, "+1" * 30000, None, None, 0, None, None)]
    got = P.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.n_email for r in got if r.doc_id == 92] == [3000]
    assert P.personal_data(frame(spark, [])).collect() == []


def test_redact(spark):
    out = P.redact(texts(spark, ["call +1 (555) 123-4567 or a@b.cc now", None]))
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["call [phone] or [email] now", None]


@pytest.mark.parametrize("iban,ok", [("GB82WEST12345698765432", True), ("GB82WEST12345698765431", False), ("DE89370400440532013000", True)])
def test_mod97(spark, iban, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(P.mod97(F.lit(iban)).alias("x")).first().x is ok


def test_redact_leaves_other_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, found string, __found string")
    out = P.redact(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "mail [email] now", "x", "y"), (2, None, "x", "y")]


def seconds(spark, n):
    import time

    docs = texts(spark, ["a1@b.cc +1 555 123 4567 call 10.0.0.1 " * n]).cache()
    docs.count()
    start = time.time()
    (r,) = P.personal_data(docs).collect()
    assert (r.n_email, r.n_ip) == (n, n)
    return time.time() - start


def test_time_follows_the_number_of_spans(spark):
    """Four times the spans: four times the seconds or so, where a quadratic rule takes sixteen times."""
    seconds(spark, 500)
    few, many = seconds(spark, 4000), seconds(spark, 16000)
    assert many < 8 * few, (few, many)


def test_surroundings_are_those_of_the_text(spark):
    """Scores equal a plain reading of 40 characters on either side, at every offset of the text's blocks."""
    got = {}
    given = [("\U0001f600x " * ((P.BLOCK + k) // 3))[: P.BLOCK + k] + f" {w} 123-45-6789 " + "é" * 300 for k in range(-60, 3) for w in ("ssn", "invoice", "ssn" + "\n" * 33, "ssn" + " " * 37)]
    for r in P.personal_data(texts(spark, given)).collect():
        got[r.doc_id] = (r.n_ssn, r.best_score)
    for i, t in enumerate(given):
        at = t.index("123-45")
        near = t[max(0, at - 40) : at] + " " + t[at + 11 : at + 51]
        score = round(0.4 + 0.2 * bool(re.search(P.CONTEXT["ssn"], near)) - 0.2 * bool(re.search(P.AGAINST, near)), 3)
        assert got[i] == ((1, score) if score >= P.KEEP else (0, None)), (i, got[i], score)
