"""Which of very many strings stand in a text: one automaton a shard of strings, one reading of each text.

Strings come sorted, in shards of bounded size: neighbours share their beginnings, so that a
shard's automaton is a narrow one. A shard is broadcast, and each worker builds its automaton
from it once. Rows go through one shard after another and gather the numbers of the classes
whose strings they hold; nothing is joined, and no shard's size depends on how many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash

#: Bytes of the strings of one shard; an automaton takes some hundred times as much.
SHARD_BYTES = 4 << 20
_built: dict[str, tuple] = {}


def shards(strings: DataFrame, most: int = SHARD_BYTES) -> Iterator[list[tuple[str, str | None, int]]]:
    """strings(plain, tight, class) in sorted order, in lists of at most most bytes (one longer string is a list of its own). The driver holds one at a time."""
    some, size = [], 0
    for r in strings.select("plain", "tight", "class").where("plain is not null").orderBy("plain", "class").toLocalIterator():
        own = len(r.plain.encode()) + 8
        if some and size + own > most:
            yield some
            some, size = [], 0
        some.append((r.plain, r.tight, r["class"]))
        size += own
    if some:
        yield some


class Automaton:
    """Classes of those strings that stand in a text; an empty string stands in every text."""

    def __init__(self, strings: list[tuple[str, int]]):
        by: dict[str, list[int]] = {}
        for s, c in strings:
            by.setdefault(s, []).append(c)
        self.always = frozenset(by.pop("", ()))
        self.tree = ahocorasick.Automaton() if by else None
        for s, c in by.items():
            self.tree.add_word(s, tuple(c))
        if self.tree is not None:
            self.tree.make_automaton()

    def classes(self, text: str | None) -> set[int]:
        if text is None:
            return set()
        found = set(self.always)
        if self.tree is not None:
            for c in {c for _, c in self.tree.iter(text)}:
                found.update(c)
        return found


def _automata(number: str, shared: Broadcast) -> tuple[Automaton, Automaton]:
    """A worker's automata of a shard: those of the last one are kept, as one task after another needs them."""
    if number not in _built:
        _built.clear()
        rows = shared.value
        _built[number] = Automaton([(p, c) for p, _, c in rows]), Automaton([(t, c) for _, t, c in rows if t is not None])
    return _built[number]


def with_classes(rows: DataFrame, strings: DataFrame, plain: Column, tight: Column | None = None, name: str = "classes", most: int = SHARD_BYTES) -> DataFrame:
    """rows with name, the sorted classes that they mention: one of whose plain strings stands in plain, or tight strings in tight.

    strings is (plain, tight, class long); tight may be null. A null text mentions none. Shards
    beyond the first are a pass over the rows each, written in between.
    """
    own = list(rows.columns)
    at = len(own)
    extra = [plain, F.lit(None).cast("string") if tight is None else tight, F.array().cast("array<bigint>")]
    # A caller's names may hold dots or be those of others: columns go by number until the end.
    out = rows.select(*(F.col(f"`{c}`") for c in own), *(c.alias(f"extra{k}") for k, c in enumerate(extra))).toDF(*(f"c{k}" for k in range(at + 3)))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])

    def gathered(df: DataFrame, shared: Broadcast) -> DataFrame:
        number = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loose, close = _automata(number, shared)
            for batch in batches:
                before = batch.column(at + 2).to_pylist()
                found = [sorted(loose.classes(t) | close.classes(p) | set(b)) for t, p, b in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), before)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at + 2)), pa.array(found, pa.list_(pa.int64()))], names=batch.schema.names)

        return df.mapInArrow(run, schema)

    first = True
    for shard in shards(strings, most):
        out = gathered(out if first else stash(out, "mentions"), rows.sparkSession.sparkContext.broadcast(shard))
        first = False
    return out.drop(f"c{at}", f"c{at + 1}").toDF(*own, name)
