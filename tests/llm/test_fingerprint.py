import hashlib
from collections import Counter

import numpy as np

from loomgraph.llm import fingerprint as S
from loomgraph.llm.shingles import shingles, word_hashes
from tests.llm.helpers import awkward_rows, frame


def bag(t, n=5):
    w = t.encode().lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jaccard(a, b):
    a, b = bag(a), bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_words_and_shingles_follow_the_plain_rule():
    given = ["One two  three\n\tFOUR five six", "", "two", "éa b\x0bc\x0c d e f one two"]
    raw = [t.encode() for t in given]
    h, owner = word_hashes(raw)
    plain = [(i, w) for i, t in enumerate(raw) for w in t.lower().split()]
    assert owner.tolist() == [i for i, _ in plain]
    assert len(set(h.tolist())) == len({w for _, w in plain})
    s, owner = shingles(raw, 5)
    assert np.bincount(owner, minlength=4).tolist() == [sum(bag(t).values()) for t in given]


def test_share_of_equal_samples_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    sampler, off = S.Sampler(samples=512), []
    for _ in range(12):
        words = [f"w{i}" for i in rng.integers(0, 6, 300)]  # shingles repeat
        cut = int(rng.integers(20, 280))
        a, b = " ".join(words), " ".join(words[:cut] + words[: 300 - cut])
        sig = sampler([a.encode(), b.encode()])
        off.append((sig[0] == sig[1]).mean() - jaccard(a, b))
    assert np.abs(off).max() < 0.1 and abs(np.mean(off)) < 0.03


def test_long_texts_are_estimated_as_well_as_short_ones():
    """Two long texts that share a passage, which both repeat, and nothing else."""
    for unique, shared, times in ((100_000, 4000, 6), (15_000, 1000, 10)):
        passage = " ".join(f"s{i}" for i in range(shared))
        a, b = (" ".join([*(f"{side}{i}" for i in range(unique)), *[passage] * times]) for side in "ab")
        sig = S.Sampler(samples=512)([a.encode(), b.encode()])
        assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.06


def test_edited_texts_follow_the_contract(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    raw = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in S.edited_fingerprints(docs).collect()}
    assert len(got) == len(raw)
    near, away = [], []
    for i, (d, t) in enumerate(raw):
        nxt = raw[(i + 1) % len(raw)][1]
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        near.append(got[d].near_edited - jaccard(t, e))
        away.append(got[d].near_next - jaccard(t, nxt))
    assert np.abs(near).max() < 0.3 and abs(np.mean(near)) < 0.02 and abs(np.mean(away)) < 0.02
    prints = {t: got[d].fingerprint for d, t in raw}
    assert all(prints[t] == got[d].fingerprint for d, t in raw)


def test_many_parts_meet_at_their_borders(spark, monkeypatch):
    rows = [(i * 3, f"text number {i} " * 3, None, None, 0, None, None) for i in range(50)]
    real = S.next_in_order
    monkeypatch.setattr(S, "next_in_order", lambda docs: real(docs, 7))
    got = {r.doc_id: r for r in S.edited_fingerprints(frame(spark, rows)).collect()}
    for i in range(50):
        t, nxt = rows[i][1], rows[i - 1][1]
        k = len(t) // 2
        assert got[i * 3].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = S.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert [r.fingerprint for r in got if r.doc_id in (0, 1, 2)] == [""] * 3
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert S.edited_fingerprints(frame(spark, [])).collect() == []
    one = S.edited_fingerprints(frame(spark, rows[6:7])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(S.fingerprints(frame(spark, rows)).collect()) == len(rows)


def test_the_search_for_a_part_is_as_large_for_many_parts(spark):
    cuts = [3 * i for i in range(1, 800)]
    rows = spark.range(0, 2500).withColumnRenamed("id", "doc_id")
    few, many = (S._below(S.long_array(c), len(c)) for c in (cuts[:7], cuts))
    assert len(str(many)) - len(str(few)) < 12 * len(cuts)
    got = dict(map(tuple, rows.select("doc_id", many.alias("n")).collect()))
    assert got == {d: min(d // 3, len(cuts)) for d in range(2500)}
