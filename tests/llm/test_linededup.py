import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import linededup as D
from loomgraph.llm.shingles import SPACED, mix, spans_and_sums
from tests.llm.helpers import awkward_rows, frame


def word_hashes(words):
    start, end, total, inverse, _ = spans_and_sums(words, SPACED)
    return mix((total[end] - total[start]) * inverse[start]).tolist()


def plain_lines(t):
    """Word lists of a text's lines."""
    out = []
    for stretch in re.split(rb"[\n\r]", t.encode()):
        now = []
        for w in [*stretch.lower().split(), None]:
            if w is not None:
                now.append(w)
            if (w is None or w[-1:] in b".!?") and now:
                out += broken(now)
                now = []
    return out


def broken(words):
    if len(words) <= D.WHOLE:
        return [words]
    h = word_hashes(words)
    ends = {min(range(i, i + D.NEAR), key=lambda k: h[k]) for i in range(len(h) - D.NEAR + 1)}
    out = [[]]
    for i, w in enumerate(words):
        out[-1].append(w)
        if i in ends:
            out.append([])
    return [x for x in out if x]


def plain_stretches(t, least=D.LEAST):
    """(first word, word after the last, words) of every stretch that is compared."""
    lines = plain_lines(t)
    at = np.cumsum([0, *map(len, lines)]).tolist()
    words, out = [w for x in lines for w in x], set()
    for i in range(len(lines)):
        if end := next((e for e in at if e - at[i] >= least), None):
            out.add((at[i], end))
    if at[-1] >= least:
        out.add((max(b for b in at if at[-1] - b >= least), at[-1]))
    return [(b, e, tuple(words[b:e])) for b, e in sorted(out)]


def longest_rise(pairs):
    """A longest chain of pairs that rises in both, of several the one that table look-up finds; pairs come by rising b."""
    best = []
    for k, (_, j) in enumerate(pairs):
        before = max((best[m] for m in range(k) if pairs[m][1] < j), key=len, default=[])
        best.append([*before, pairs[k]])
    return max(map(len, best), default=0)


def plain_align(b, a, b0=0, a0=0):
    """Patience diff by recursion; where several longest chains are possible, the operator's own choice."""
    out = []
    while b and a and b[0] == a[0]:
        out.append((b0, a0))
        b, a, b0, a0 = b[1:], a[1:], b0 + 1, a0 + 1
    while b and a and b[-1] == a[-1]:
        b, a = b[:-1], a[:-1]
        out.append((b0 + len(b), a0 + len(a)))
    lone = [(i, a.index(x)) for i, x in enumerate(b) if b.count(x) == 1 and a.count(x) == 1]
    chain = [lone[k] for k in D.increasing([i for i, _ in lone], [j for _, j in lone])]
    assert len(chain) == longest_rise(lone)
    if chain:
        for (i, j), (k, m) in zip([(-1, -1), *chain], [*chain, (len(b), len(a))]):
            out += plain_align(b[i + 1 : k], a[j + 1 : m], b0 + i + 1, a0 + j + 1)
        out += [(b0 + i, a0 + j) for i, j in chain]
    return sorted(out)


def plain_dedup(given, least=D.LEAST, block=D.BLOCK, copy=D.COPY):
    """id -> (words left, words, words lost, whether a copy), of texts by id: documents are linked by comparing all words, and aligned anew."""
    out, earlier = {}, []
    for i in sorted(given):
        lines = [tuple(x) for x in plain_lines(given[i] or "")]
        at = np.cumsum([0, *map(len, lines)]).tolist()
        own, lost = plain_stretches(given[i] or "", least), set()
        linked = {first for _, _, words in own if (first := next((k for k, old in enumerate(earlier) if words in old[1]), None)) is not None}
        for k in linked:
            for b, e, words in own:
                if words in earlier[k][1]:
                    lost |= set(range(b, e))
            run = []
            both = set(lines) & set(earlier[k][0])
            own_at, other_at = ([n for n, x in enumerate(side) if x in both] for side in (lines, earlier[k][0]))
            aligned = plain_align([lines[n] for n in own_at], [earlier[k][0][n] for n in other_at])
            for pair in [*((own_at[n], other_at[m]) for n, m in aligned), None]:
                if run and (pair is None or (pair[0] - run[-1][0], pair[1] - run[-1][1]) != (1, 1)):
                    if at[run[-1][0] + 1] - at[run[0][0]] >= block:
                        lost |= set(range(at[run[0][0]], at[run[-1][0] + 1]))
                    run = []
                run.append(pair)
        words = (given[i] or "").encode().lower().split()
        runs = "".join("x" if k in lost else "." for k in range(len(words))).split("x")
        out[i] = ([w for k, w in enumerate(words) if k not in lost], len(words), len(lost), bool(lost) and len(lost) >= copy * len(words) and max(map(len, runs)) < least)
        earlier.append((lines, {x[2] for x in own}))
    return out


def docs(spark, given):
    return frame(spark, [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in given])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)).capitalize() + "."


def prose(rng, n):
    return "".join(sentence(rng, rng.randrange(3, 14)) + rng.choice([" ", "\n", "  "]) for _ in range(n)).strip()


def held(rng, n):
    """n words without any end."""
    return sentence(rng, n)[:-1].lower()


def check(spark, given):
    """Both forms against the plain rule."""
    want = plain_dedup(given)
    got = {r.doc_id: r for r in D.dedup_lines(docs(spark, given.items())).collect()}
    assert set(got) == {i for i, x in want.items() if not x[3]}
    for i, r in got.items():
        assert (r.text or "").encode().lower().split() == want[i][0], i
        assert r.n_chars == len(r.text or "")
    report = {r.doc_id: r for r in D.line_report(docs(spark, given.items())).collect()}
    assert {i: (r.n_words, r.words_cut, r.is_copy) for i, r in report.items()} == {i: x[1:] for i, x in want.items()}
    return got


def test_lines_follow_the_plain_rule():
    rng = random.Random(6)
    given = ["One two. Three\nfour! five six?seven  eight.\r\n\n Nine", "", "  ", "a", "É x. y\n", held(rng, 14), held(rng, 15), held(rng, 200), prose(rng, 40), "same " * 60]
    lines = D.Lines([t.encode() for t in given])
    want = [(i, len(x)) for i, t in enumerate(given) for x in plain_lines(t)]
    assert list(zip(lines.owner.tolist(), (lines.end - lines.first).tolist())) == want
    line, size, stretch, n, last = lines.index()
    assert n.tolist() == [len(plain_lines(t)) for t in given] and size.tolist() == [len(x) for t in given for x in plain_lines(t)]
    by = {}
    for h, x in zip(line.tolist(), [tuple(x) for t in given for x in plain_lines(t)]):
        assert by.setdefault(h, x) == x
    for i, t in enumerate(given):
        own, begins = plain_stretches(t), np.cumsum([0, *map(len, plain_lines(t))]).tolist()
        there = stretch[n[:i].sum() : n[: i + 1].sum()]
        assert {begins[k] for k in np.flatnonzero(there)} == {b for b, e, _ in own if e == next(x for x in begins if x - b >= D.LEAST)}
        assert (last[i] != 0) == bool(own)
    assert D.without(b"One two. Three\nfour! five", np.array([0, 4, 9, 15, 21]), [(1, 3), (4, 5)]) == b"One four! "
    b, a = D.Lines([b"A b  c. " * 9]), D.Lines([b"x y. \na B\tC." + b" a b c." * 8])
    assert set(b.index()[2].tolist()) - {0} <= set(a.index()[2].tolist()) and b.index()[0][0] == a.index()[0][1]


def test_united():
    begin, end = D.united(np.array([9, 0, 3, 20]), np.array([12, 4, 9, 21]))
    assert (begin.tolist(), end.tolist()) == ([0, 20], [12, 21])


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(9)
        b = sorted(rng.randrange(8) for _ in range(n))
        a = [rng.randrange(8) for _ in range(n)]
        best = 0
        for m in range(1 << n):
            s = [i for i in range(n) if m >> i & 1]
            if all(b[i] < b[j] and a[i] < a[j] for i, j in zip(s, s[1:])):
                best = max(best, len(s))
        got = D.increasing(b, a)
        assert len(got) == best and all(b[i] < b[j] and a[i] < a[j] for i, j in zip(got, got[1:]))
        x, y = [rng.randrange(9) for _ in range(rng.randrange(15))], [rng.randrange(9) for _ in range(rng.randrange(15))]
        chain = D.patience(x, y)
        assert chain == plain_align(x, y) and all(x[i] == y[j] for i, j in chain)
        assert all(i < k and j < m for (i, j), (k, m) in zip(chain, chain[1:]))


def test_many_repeats_take_little_time():
    n = 20_000
    assert len(D.patience([7] * n, [7] * (n - 5))) == n - 5
    assert len(D.patience(list(range(n)), list(range(n)))) == n
    assert D.patience(list(range(n)), list(range(n, 0, -1))) != []


def test_alignment_decides_what_goes(spark, monkeypatch):
    """A short line goes where it aligns, between documents that share a stretch, and stays where it does not."""
    rng = random.Random(12)
    passage, line, other = prose(rng, 9), sentence(rng, 10), sentence(rng, 10)
    own = [sentence(rng, 12) for _ in range(6)]
    given = {1: " ".join([line, own[0], passage, other, own[1]]), 2: " ".join([own[2], line, own[3], passage, own[4], other]), 3: " ".join([other, passage, own[5], line]), 4: line + " " + own[5] + " " + other}
    got = check(spark, given)
    assert line not in got[2].text and other not in got[2].text and passage not in got[2].text
    assert line in got[3].text and other in got[3].text and passage not in got[3].text
    assert got[4].text == given[4]
    batch = pa.RecordBatch.from_pydict({"lines": [[8], [1, 2, 3]], "sizes": [[9], [10, 30, 10]], "stretches": [[0, 0], [0, 9, 0, 0]], "a_lines": [[1, 2], [1, 2, 5, 3]], "a_stretches": [[9], [9]]})
    spans = lambda: tuple(np.array(x).tolist() for x in D.common_of_all(batch.slice(1))[0])
    assert spans() == ([0], [50], 0)
    monkeypatch.setattr(D, "patience", lambda b, a: [])
    assert spans() == ([10], [40], 1)


@pytest.mark.parametrize("seed", range(3))
def test_every_passage_of_51_words_is_hit(spark, seed):
    """Wherever it stands, whatever its sentences, in all documents but the first; foreign words stay."""
    rng = random.Random(seed)
    given, passages = {}, {}
    for k in range(40):
        n = rng.choice([51, 51, 52, 55, 60])
        p = held(rng, n).split()
        for _ in range(rng.randrange(6)):
            p[rng.randrange(n)] += "."
        passages[k] = " ".join(p)
        for _ in range(3):
            given[len(given)] = held(rng, rng.randrange(40)) + " " + passages[k] + " " + held(rng, rng.randrange(40))
    got = check(spark, given)
    for i, t in given.items():
        p = passages[i // 3].split()
        if i % 3 == 0:
            assert got[i].text == t
        elif i in got:
            left = got[i].text.lower().split()
            assert len(set(p) & set(left)) <= 26
            assert set(t.split()) - set(p) <= set(left)


def test_passages_from_two_documents_that_no_one_holds_whole_stay(spark):
    """Two stretches of 14 words from two documents, or from one that has other words between, are no block."""
    rng = random.Random(9)
    x, y = sentence(rng, 14), sentence(rng, 14)
    given = {1: prose(rng, 9) + " " + x, 2: y + " " + prose(rng, 9), 3: x + " " + y}
    assert check(spark, given)[3].text == given[3]
    given = {1: x + " " + prose(rng, 8) + " " + y, 3: x + " " + y, 4: prose(rng, 5) + "\n" + x + " " + y}
    got = check(spark, given)
    assert got[3].text == given[3] and x not in got[4].text


def test_repeated_passages_go_from_later_documents_only(spark):
    rng = random.Random(2)
    passage, other = prose(rng, 9), prose(rng, 8)
    given = {}
    for i in range(40):
        parts = re.findall(r".*?[.](?:\s+|$)", prose(rng, rng.randrange(6, 30)), re.S)
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), passage + " ")
        if i % 5 == 0:
            parts.insert(rng.randrange(len(parts)), other + "\n")
        given[i] = "".join(parts)
    got = check(spark, given)
    for i, t in got.items():
        assert (passage in t.text) == (i == 0) and (other in t.text) == (i == 0)


def test_blocks_are_those_of_a_brute_force_search(spark):
    """Blocks that repeat, move, overlap and come from several documents."""
    rng = random.Random(3)
    bank = [prose(rng, rng.randrange(5, 9)) for _ in range(12)]
    given = {i: "\n".join(rng.choice(bank) if rng.random() < 0.5 else prose(rng, 5) for _ in range(6)) for i in range(40)}
    check(spark, given)
    given = {i: " ".join(rng.choice(bank).split()[rng.randrange(20) :][: rng.randrange(90)] and rng.choice(bank) or "x" for _ in range(5)) for i in range(30)}
    check(spark, given)
    moved = {r.doc_id: r.stretches_moved for r in D.line_report(docs(spark, [(1, bank[0] + "\n" + bank[1]), (2, bank[1] + "\n" + bank[0])])).collect()}
    assert moved[1] == 0 and moved[2] > 0


def test_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    a, b = prose(rng, 30), prose(rng, 30)
    given = [(3, a), (5, a), (4, b), (9, a + " " + sentence(rng, 6)), (6, "Yes. No. The end.\nYes. No. The end."), (7, "Yes. No. The end."), (8, None), (2, "")]
    got = {r.doc_id: r.text for r in D.dedup_lines(docs(spark, given)).collect()}
    assert got == {3: a, 4: b, 6: given[4][1], 7: given[5][1], 8: None, 2: ""}


def test_no_passage_goes_with_a_copy(spark):
    """A document that is nearly all copied keeps the passage it brought, and later holders lose it; scraps go with a copy."""
    rng = random.Random(5)
    a, b, passage, tail = prose(rng, 120), prose(rng, 30), prose(rng, 9), sentence(rng, 8)
    given = {1: a, 2: a + "\n" + passage, 3: b + "\n" + passage, 4: passage + "\n" + tail, 5: a, 6: a + "\n" + tail}
    got = check(spark, given)
    assert set(got) == {1, 2, 3} and got[2].text == passage and got[3].text.strip() == b


def test_string_ids_are_ordered_as_strings(spark):
    rng = random.Random(7)
    p = prose(rng, 12)
    rows = [("b", p), ("a", p + "\n" + held(rng, 30)), (None, p), ("10", held(rng, 40) + "\n" + p)]
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"10", "a"} and got["10"] == rows[3][1] and p not in got["a"]


def test_other_columns_may_have_any_names(spark):
    rng = random.Random(8)
    p = prose(rng, 12)
    rows = spark.createDataFrame([(1, p), (2, prose(rng, 9) + "\n" + p)], "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in ("row", "ord", "starts", "ENDS", "moved", "h", "info", "first", "__row", "__gone", "starts_", "a.b", "c0", "lines")))
    out = D.dedup_lines(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == rows.columns and p not in got[2].text and all(v == 7 for v in got[2][2:])


def test_awkward_rows(spark):
    rows = awkward_rows()
    out = D.dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert sorted(map(str, out.collect())) == sorted(map(str, frame(spark, rows).collect()))
    assert len(D.line_report(frame(spark, rows)).collect()) == len(rows)
    assert D.dedup_lines(frame(spark, [])).collect() == [] and D.line_report(frame(spark, [])).collect() == []
