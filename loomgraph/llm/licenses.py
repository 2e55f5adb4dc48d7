"""Licence scans with a positional index of rare words.

Every template (a notice, or a phrase) is a row of words with one mandatory key phrase. The index
posts, for each template, the ANCHORS words of its key phrase with the highest inverse template
frequency, with their positions. A file's words that the index knows give postings; those of one
template that agree on where it would begin are intersected; where all anchors meet, the key
phrase is verified word by word, and the share of the template's words in place is its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, small_batches, texts
from .shingles import LETTERS, mix, spans_and_sums

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public licence notices as (label, words, key phrase).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge to any person obtaining a copy of this software"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
]
ANCHORS = 3
#: A notice counts if its key phrase stands and this share of its words is in place.
LEAST_SHARE = 0.5


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    start, end, total, inverse, _ = spans_and_sums(raw, LETTERS)
    return mix((total[end] - total[start]) * inverse[start])


class Index:
    """Postings (word hash, template, position), sorted by hash; as large as the templates, not the files."""

    def __init__(self, base: dict[str, str] = BASE, notices: list[tuple[str, str, str]] = NOTICES):
        self.templates = [(label, phrase.split(), 0, len(phrase.split()), True) for phrase, label in base.items()]
        for label, text, key in notices:
            words, k = text.split(), key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            self.templates.append((label, words, at, len(k), False))
        seen: dict[str, int] = {}
        for _, words, *_ in self.templates:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        self.idf = {w: log(len(self.templates) / n) for w, n in seen.items()}
        self.hashes = [_hashes(t[1]) for t in self.templates]
        rows = []
        self.needed = np.zeros(len(self.templates), np.int64)
        for i, (_, words, at, n, _) in enumerate(self.templates):
            for p in sorted(range(at, at + n), key=lambda p: (-self.idf[words[p]], p))[:ANCHORS]:
                rows.append((int(self.hashes[i][p]), i, p))
                self.needed[i] += 1
        rows.sort()
        self.key = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.position = np.array([r[2] for r in rows], np.int64)

    def scan(self, raw: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
        """Words of each text, and (text, template, first word, share) of every verified place; the first word counts from the text's start."""
        start, end, total, inverse, owner = spans_and_sums(raw, LETTERS)
        counts = np.bincount(owner, minlength=len(raw))
        if len(start) == 0:
            return counts, []
        word = mix((total[end] - total[start]) * inverse[start])
        lo = np.searchsorted(self.key, word, side="left")
        known = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == word)
        if len(known) == 0:
            return counts, []
        hi = np.searchsorted(self.key, word[known], side="right")
        n = hi - lo[known]
        at = np.repeat(known, n)
        post = np.repeat(lo[known], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        template, begin = self.template[post], at - self.position[post]
        # where all anchors of a template agree on its beginning
        place, agree = np.unique(np.stack([template, begin, owner[at]], axis=1), axis=0, return_counts=True)
        place = place[agree == self.needed[place[:, 0]]]
        first = np.cumsum(counts) - counts
        joined = b" ".join([*raw, b""]).lower()
        out = []
        for i in np.unique(place[:, 0]):
            label, words, key_at, key_n, base = self.templates[i]
            begin, text = place[place[:, 0] == i, 1], place[place[:, 0] == i, 2]
            spot = begin[:, None] + np.arange(len(words))
            inside = (spot >= first[text][:, None]) & (spot < (first + counts)[text][:, None])
            same = inside & (word[np.clip(spot, 0, len(word) - 1)] == self.hashes[i])
            share = same.mean(axis=1)
            ok = same[:, key_at : key_at + key_n].all(axis=1) & (share >= LEAST_SHARE)
            for b, t, s in zip(begin[ok].tolist(), text[ok].tolist(), share[ok].tolist()):
                if all(joined[start[b + k] : end[b + k]] == words[k].encode() for k in range(key_at, key_at + key_n)):
                    out.append((t, int(i), b - int(first[t]), s))
        return counts, out


def licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """One row per row of docs: word count, the base phrases' places, labels and score, over whole texts.

    n_base counts all places of all base phrases, overlapping ones too; first_word and
    last_word are their least and greatest first words, null without any. labels adds those
    of verified notices. score is the best share of a template's words in place, 0 without
    labels. Null and empty texts have no words and empty labels; repeated rows and null ids
    keep their rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    index = index or Index()
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, k) for c, k in (("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", string), ("labels", string), ("score", T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, found = index.scan([t.encode() for t in texts(batch)])
            n = batch.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            score = [0.0] * n
            for text, template, at, share in found:
                label, *_, is_base = index.templates[template]
                labels[text].add(label)
                score[text] = max(score[text], share)
                if is_base:
                    base[text].add(label)
                    places[text].append(at)
            joined = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            columns = [counts, [len(p) for p in places], [min(p, default=None) for p in places], [max(p, default=None) for p in places]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), joined(base), joined(labels), pa.array(score, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
