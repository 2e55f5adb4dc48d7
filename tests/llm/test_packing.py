import random
from collections import defaultdict

import pytest

from loomgraph.llm import packing as P
from tests.llm.helpers import awkward_rows, frame


def plain(size, source, cluster, capacity):
    """Every piece against every open bin."""
    out, count, rest = [], 0, []
    for i, n in enumerate(size):
        whole = n // capacity
        out += [(i, k * capacity, capacity, count + k, 0) for k in range(whole)]
        count += whole
        if n % capacity:
            rest.append((i, whole * capacity, n % capacity))
    bins = []
    for i, at, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and source[i] not in b["s"] and cluster[i] not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, at, n, count + k, capacity - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["s"].add(source[i])
        bins[k]["c"].add(cluster[i])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 150)
    size = [rng.choice([0, 1, rng.randrange(40), rng.randrange(400)]) for _ in range(n)]
    source = [rng.choice("aaaabcdef") if seed % 3 else str(i) for i in range(n)]
    cluster = [rng.randrange(n) for _ in range(n)]
    assert P.pack_group(size, source, cluster, 100) == plain(size, source, cluster, 100)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    got = P.pack(docs, group=300).collect()
    of, bins = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        if r.bin is not None:
            bins[r.bin].append(r)
    assert set(of) == set(text)
    for d, pieces in of.items():
        n = len(text[d][0].encode().split())
        at = 0
        for r in sorted(pieces, key=lambda r: r.first_word):
            assert r.first_word == at
            at += r.n_words
        assert at == n
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_words
        assert at <= P.CAPACITY
        assert len({text[r.doc_id][1] for r in pieces}) == len(pieces)
        assert len({"".join(text[r.doc_id][0].lower().split()) for r in pieces}) == len(pieces)


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = P.pack(frame(spark, rows)).collect()
    words = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r.n_words for r in got) == words
    assert sorted({str(r.doc_id) for r in got}) == sorted({str(r[0]) for r in rows})
    assert [(r.n_words, r.bin) for r in got if r.doc_id in (0, 1, 2)] == [(0, None)] * 3
    twice = [r for r in got if r.doc_id == 3]
    assert len(twice) == 3 and len({r.bin for r in twice}) == 3
    assert P.pack(frame(spark, [])).collect() == []
