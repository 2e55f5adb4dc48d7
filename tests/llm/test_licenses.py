import random

from loomgraph.llm import licenses as L
from tests.llm.helpers import awkward_rows, frame, texts, words


def plain(t):
    w, places, labels = words(t), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_places_equal_plain_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    raw = dict(docs.select("doc_id", "text").collect())
    got = L.licenses(docs).collect()
    assert all(base(r) == plain(raw[r.doc_id]) for r in got) and any(r.n_base for r in got)
    assert any(r.labels == "gpl-3" for r in got)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score > 0) == (r.labels != "") for r in got)


def test_random_and_made_texts(spark):
    rng = random.Random(6)
    bag = "under the mit license apache version 2 cc by nc License, MIT é Apache/ 2.0 CC-BY-NC x".split()
    made = [" ".join(rng.choice(bag) for _ in range(rng.randrange(40))) for _ in range(500)]
    made += ["cc by nc cc by nc by nc cc", "UNDER the\nMIT-License", "under the mit", "licensе under the mit license", "Licensed under the GNU General Public License, version 3.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "gnu general public license"]
    got = {r.doc_id: r for r in L.licenses(texts(spark, made)).collect()}
    for i, t in enumerate(made):
        assert base(got[i]) == plain(t), t
    assert [got[len(made) - k].labels for k in (3, 2, 1)] == ["gpl-3", "bsd-3", ""]


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = L.licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.n_words, r.base_labels, r.labels, r.score) for r in got if r.doc_id == 0] == [(0, "", "", 0.0)]
    assert L.licenses(frame(spark, [])).collect() == []
