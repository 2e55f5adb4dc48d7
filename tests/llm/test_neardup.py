import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import neardup as N
from loomgraph.llm.common import Steps
from loomgraph.llm.components import components
from tests.llm.helpers import awkward_rows, frame, texts


def plain_print(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(rows, most=4):
    fp = {d: plain_print(t) for d, t in rows}
    ids = sorted(fp)
    return fp, plain_components(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= most])


def test_documents_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    fp, comp = plain(docs.select("doc_id", "text").collect())
    got = N.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", comp[d]) for d in fp}
    kept = {r.doc_id for r in N.keep_one(docs).collect()}
    first = {}
    for d, t in docs.select("doc_id", "text").orderBy("doc_id").collect():
        first.setdefault(t, d)
    assert kept <= set(first.values()) and len(kept) > 0.7 * len(first)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    given, group = [], []
    for g in range(60):
        base = [word() for _ in range(rng.randrange(80, 400))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(len(w) // 100):
                w[rng.randrange(len(w))] = word()
            given.append(" ".join(w))
            group.append(g)
    kept = {r.doc_id for r in N.keep_one(texts(spark, given)).collect()}
    first = {g: group.index(g) for g in set(group)}
    assert set(first.values()) <= kept and len(kept) <= 1.05 * len(first)


def test_texts_longer_than_a_block():
    rng = random.Random(9)
    given = [" ".join(str(rng.randrange(50)) for _ in range(n)) for n in (70_000, 3, 140_000, 0, 4, 5)]
    assert N.simhash(given).tolist() == [plain_print(t) for t in given]


def made(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    for b in base:
        for _ in range(rng.randrange(10)):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                b ^= 1 << bit
            out.add(b)
    dense = rng.getrandbits(64)
    out |= {dense ^ x for x in range(64)} | {0, (1 << 64) - 1}
    return sorted(out)


def test_trie_join_finds_every_pair():
    rng = random.Random(1)
    for most in (0, 1, 3, 4, 7):
        keys = np.array(made(rng, 300), np.uint64)
        want = {(i, j) for i in range(len(keys)) for j in range(i) if int(keys[i] ^ keys[j]).bit_count() <= most}
        got = []
        N.join_tries(N.Trie(keys), N.Trie(keys), True, most, [64], lambda i, j: got.extend(zip(j.tolist(), i.tolist())))
        assert len(got) == len(set(got)) and set(got) == want
        a, b = keys[::2], keys[1::2]
        for blocks, lead in ((2, 0), (4, 1), (5, 0), (5, 4)):
            got, ends = [], N.block_ends(blocks, lead)
            assert len(ends) == blocks and ends[-1] == 64
            N.join_tries(N.Trie(a), N.Trie(b), False, most, ends, lambda i, j: got.extend(zip(i.tolist(), j.tolist())))
            assert set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if all((int(a[i] ^ b[j]) >> (64 - end)).bit_count() <= k * most // blocks for k, end in enumerate(ends, 1))}


def test_links_connect_what_is_near_whatever_the_top_nodes(spark, monkeypatch):
    rng = random.Random(2)
    keys = made(rng, 800)
    ids = {k: i for i, k in enumerate(keys)}
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    df = spark.createDataFrame([(signed(k),) for k in keys], "fp long")
    for most, size in ((4, 100_000), (4, 5), (9, 40), (0, 40)):
        near = lambda x, y: (x ^ y).bit_count() <= most  # noqa: B023, E731
        want = plain_components(range(len(keys)), [(i, j) for j in range(len(keys)) for i in range(j) if near(keys[i], keys[j])])
        monkeypatch.setattr(N, "NODE_FINGERPRINTS", size)
        links = [(ids[r.a % (1 << 64)], ids[r.b % (1 << 64)]) for r in N.near_links(df, most).collect()]
        assert all(near(keys[a], keys[b]) for a, b in links)
        assert plain_components(range(len(keys)), links) == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)] + [(rng.randrange(7000, 8000), rng.randrange(7000, 8000)) for _ in range(700)]
    rng.shuffle(links)
    nodes = {x for e in links for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(nodes, [e for e in links if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    fp, comp = plain([(r[0], r[1]) for r in rows if r[0] is not None])
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id is None} == {0, None}
    assert N.near_duplicates(frame(spark, [])).collect() == []
    kept = N.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 4, 5, 6} <= set(ids) and not {1, 2, 50} & set(ids)
    assert N.keep_one(frame(spark, [])).collect() == []
    assert [r.doc_id for r in N.keep_one(texts(spark, [None, "", None], 3)).collect()] == [3]


def five(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_keep_one_goes_by_exact_similarity(spark):
    """Pairs just above 0.8 are linked, pairs just below are not, and neither is a link's end reached through one that is not similar."""
    rng = random.Random(12)
    given, want = [], set()
    for g in range(240):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(150, 400))]
        other, aim = list(base), 0.81 if g % 2 else 0.78 if g % 4 else 0.7
        at = list(range(2, len(base) - 4))
        rng.shuffle(at)
        like = lambda x: len(five(" ".join(base)) & five(x)) / len(five(" ".join(base)) | five(x))  # noqa: B023, E731
        for i in at:
            kept = other[i]
            other[i] = f"n{rng.randrange(10**9)}"
            if like(" ".join(other)) < aim:
                other[i] = kept
                break
        first = len(given)
        given += [" ".join(base), " ".join(other)]
        want |= {first} if like(given[-1]) >= 0.8 else {first, first + 1}
    assert 300 < len(want) < 420
    assert {r.doc_id for r in N.keep_one(texts(spark, given)).collect()} == want


def test_every_candidate_is_checked_unless_connected(spark):
    """A cluster whose least node is similar to some only: the rest still link among themselves."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(300)]
    given = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(2, 9)):
            w[rng.randrange(300)] = f"n{rng.randrange(10**9)}"
        given.append(" ".join(w))
    sets = [five(t) for t in given]
    comp = plain_components(range(60), [(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) * 9 >= 4 * (len(sets[a]) + len(sets[b]))])
    assert 1 < len(set(comp.values())) < 60
    assert {r.doc_id for r in N.keep_one(texts(spark, given)).collect()} == set(comp.values())


def test_rare_pairs_lose_no_similar_pair(spark):
    rng = random.Random(14)
    made = [[rng.randrange(400) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    made += [[x for x in rng.choice(made) if rng.random() > 0.08] + [rng.randrange(400)] for _ in range(80)]
    sets = {i: sorted(set(x)) for i, x in enumerate(made)}
    with Steps(spark) as steps:
        df = spark.createDataFrame(list(sets.items()), "node long, terms array<long>")
        nodes = df.select("node", F.size("terms").cast("long").alias("size"), F.col("node").alias("root"))
        got = {(r.a, r.b) for r in N.rare_pairs(df, nodes, steps).distinct().collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) * 9 >= 4 * (len(sets[a]) + len(sets[b]))}
    assert len(want) > 50 and want <= got and len(got) < 120 * 119 / 4


def test_boilerplate_makes_no_pairs(spark, monkeypatch):
    """Texts that share half of their words, and no more, are not paired, however many there are."""
    pairs, real = [], N.rare_pairs

    def counted(*x):
        out = real(*x)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(N, "rare_pairs", counted)
    for n in (400, 800):
        rng = random.Random(15)
        shared = " ".join(f"s{i}" for i in range(60))
        given = [shared + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(n)]
        assert N.keep_one(texts(spark, given)).count() == n
    assert pairs == [0, 0]
    with Steps(spark) as steps:
        sets = [five(t) for t in given]
        number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
        df = spark.createDataFrame([(i, [number[x] for x in s]) for i, s in enumerate(sets)], "node long, terms array<long>")
        nodes = df.select("node", F.size("terms").cast("long").alias("size"), F.col("node").alias("root"))
        assert real(df, nodes, steps).count() == 0


def test_other_columns_and_repeated_rows(spark):
    """Columns of any name stay; of rows equal in id and text, the least by a hash of all columns."""
    t = "one two three four five six seven"
    rows = [(1, t, "x", 1), (1, t, "y", 2), (2, t, "z", 3), (3, "quite another text", "w", 4), (None, None, "v", 5), (None, "", "v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, node long")
    df = df.select("*", *(df["node"].alias(c) for c in ("h", "__id", "__h", "rep", "k", "t", "id_", "of", "a", "first")))
    out = N.keep_one(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"] and len({r.node for r in got} & {1, 2}) == 1
    assert sorted(map(str, got)) == sorted(map(str, N.keep_one(df.orderBy(df["node"].desc())).collect()))


def test_keep_one_goes_through_the_trie_join(spark, monkeypatch):
    """Without any band in common, what the fingerprints link is found, and held against the shingles."""
    real = N.with_bands

    def bare(docs, keep, shingle=N.WORDS):
        return real(docs, keep, shingle).withColumn("bands", F.array().cast("array<bigint>"))

    monkeypatch.setattr(N, "with_bands", bare)
    rng = random.Random(9)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(3000)) for _ in range(4)]
    given = [*long, *(t + " more" for t in long), " ".join(long[0].split()[:120])]
    assert sorted(r.doc_id for r in N.keep_one(texts(spark, given)).collect()) == [0, 1, 2, 3, 8]
    # Fingerprints that are equal by chance link nothing that differs.
    monkeypatch.setattr(N, "with_bands", lambda *x: bare(*x).withColumn("fp", F.lit(0).cast("long")))
    assert N.keep_one(texts(spark, long)).count() == 4
