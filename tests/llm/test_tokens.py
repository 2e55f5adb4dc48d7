import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import tokens as K
from tests.llm.helpers import awkward_rows, frame, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(given):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(given, add_special_tokens=False)]


def test_documents_count_as_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], plain([r[1] for r in rows])))
    got = K.count_tokens(docs, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_special_strings_spaces_and_every_kind_of_character(spark):
    rng = random.Random(5)
    odd = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x0660, 0x0E33, 0x200D]]
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(80))) for _ in range(300)]
    made += ["<|endoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext|", "aaaaaaaaaaaaaaa", "hehehehe", "'s 'S 're x'll", "  \n\n  \t a", "a" * 5001, "=" * 999 + "-" * 777, "ab" * 2000]
    got = {r.doc_id: r for r in K.count_tokens(texts(spark, made), PATH).collect()}
    for i, n in enumerate(plain(made)):
        assert got[i].n_tokens == n, repr(made[i])
        assert got[i].n_bytes == len(made[i].encode())


def test_awkward_rows_and_memory_bound(spark, monkeypatch):
    rows = awkward_rows()
    got = K.count_tokens(frame(spark, rows), PATH).collect()
    assert len(got) == len(rows) and [r.n_tokens for r in got if r.doc_id == 0] == [0]
    assert K.count_tokens(frame(spark, []), PATH).collect() == []
    monkeypatch.setattr(sys.modules[K.__name__], "REMEMBERED", 3)
    counter = K.Counter(K.MergeTable.read(PATH))
    for _ in range(3):
        assert counter(["some words here", "and more words", ""]) == plain(["some words here", "and more words", ""])


def test_one_long_word_takes_little_more_than_its_length():
    """Both ways of merging count as the library does; twice as long takes about twice as much, not four times."""
    import time

    rng = random.Random(11)
    table = K.MergeTable.read(PATH)
    made = ["".join(rng.choices(v, k=n)) for v in ("abcdefghijklmnopqrstuvwxyz", "ab", "é\u4e2d", "the quick") for n in (K.LONG - 3, K.LONG + 3, 5000)] + ["a" * 4000]
    made = [t.replace(" ", "x") for t in made]
    assert [table.count_long(t.encode()) for t in made] == plain(made) == table.count_short([t.encode() for t in made]).tolist()
    took = []
    for n in (40_000, 160_000):
        t = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        start = time.time()
        got = table.count([t.encode()])
        took.append(time.time() - start)
        assert got.tolist() == plain([t])
    assert took[1] < 9 * took[0] and took[1] < 10, took
