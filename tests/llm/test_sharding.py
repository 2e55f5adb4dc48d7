import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomgraph.llm import sharding as S
from tests.llm.helpers import awkward_rows, frame


def test_places_every_row_and_evens_bytes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = S.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    texts = dict(docs.select("doc_id", "text").collect())
    sums = np.zeros(16)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sums[r.shard] += r.size
    for s in range(16):
        at = sorted(r.slot for r in rows if r.shard == s)
        assert at == list(range(len(at)))
    assert sums.max() <= max(sums.mean() * 1.05, max(r.size for r in rows))


def test_awkward_rows(spark):
    rows = S.shard_documents(frame(spark, awkward_rows())).collect()
    assert len(rows) == len(awkward_rows())
    assert [r.size for r in rows if r.doc_id == 0] == [1]
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert S.shard_documents(frame(spark, [])).collect() == []


def plain_slot(doc_id, size, crc, n=S.N_SLOTS):
    h = 42
    for x in (doc_id, size, crc):
        if x is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return (h - (1 << 64) if h >> 63 else h) % n


def test_every_row_stands_where_the_map_and_its_order_say(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(frame(spark, awkward_rows()).select("doc_id", "text", "lang", "source", "n_chars"))
    got = S.shard_documents(docs, map_path=str(tmp_path / "m")).collect()
    slots = S.read_map(spark, str(tmp_path / "m"))
    by = {}
    for d, t in docs.select("doc_id", "text").collect():
        raw = (t or "").encode()
        key = (d, len(raw) + 1, zlib.crc32(raw))
        by.setdefault(plain_slot(*key), []).append(key)
    want, at = [], Counter()
    for v in range(S.N_SLOTS):
        for d, size, crc in sorted(by.get(v, ()), key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1])):
            shard = int(slots.shard[v])
            want.append((d, size, crc, v, shard, at[shard]))
            at[shard] += 1
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot)) for r in got)


def test_map_grows_only_into_the_new_shard_and_round_trips(spark, tmp_path):
    path, rng = str(tmp_path / "map"), np.random.default_rng(1)
    w = rng.integers(1, 1000, 512)
    assert S.read_map(spark, path) is None
    m = S.current_map(spark, path, 8, 512, w)
    load = np.bincount(m.shard, weights=w)
    assert m.version == 1 and load.max() - load.min() <= 20
    assert S.current_map(spark, path, 8, 512, w).version == 1  # nothing to edit
    g = m.grow(w)
    moved = g.shard != m.shard
    assert set(g.shard[moved]) == {8} and g.version == 2
    assert np.bincount(g.shard, weights=w, minlength=9)[8] > 0.9 * w.sum() / 9
    n = S.current_map(spark, path, 9, 512, w)
    assert (S.read_map(spark, path, 2).shard == g.shard).all() and n.version in (2, 3)
    other = S.current_map(spark, path, 9, 512, w + rng.integers(0, 30, 512))
    assert other.version == n.version + 1 and (other.shard != n.shard).mean() < 0.5
    for v, want in enumerate([S.SlotMap.initial(8, 512), m, g]):
        back = S.read_map(spark, path, v)
        assert back.version == v and back.n_shards == want.n_shards and (back.shard == want.shard).all()
    assert (S.read_map(spark, path).shard == other.shard).all()
    with pytest.raises(ValueError):
        S.current_map(spark, path, 4, 512, w)
    assert not S.write_map(m, spark, path) and (S.read_map(spark, path, 1).shard == m.shard).all()


def test_a_write_that_was_cut_off_is_made_again(spark, tmp_path):
    path, w = tmp_path / "map", np.arange(1, 65)
    S.write_map(S.SlotMap.initial(4, 64), spark, str(path))
    (path / "version=1").mkdir()
    (path / "version=1" / "part-0.parquet").write_bytes(b"half")
    (path / ".writing-dead").mkdir()
    assert S.read_map(spark, str(path)).version == 0
    m = S.current_map(spark, str(path), 4, 64, w)
    assert m.version == 1 and (S.read_map(spark, str(path)).shard == m.shard).all()
    assert not any(p.name.startswith(".writing") and p.name != ".writing-dead" for p in path.iterdir())


def test_of_two_runs_at_once_one_is_first(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    rng = np.random.default_rng(2)
    path, weights = str(tmp_path / "map"), [rng.integers(1, 1000, 64) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda w: S.current_map(spark, path, 5, 64, w), weights))
    stored = [S.read_map(spark, path, v) for v in range(S.read_map(spark, path).version + 1)]
    assert all(any((m.shard == s.shard).all() for s in stored) for m in got)
    assert all(len(s.shard) == 64 for s in stored) and not list((tmp_path / "map").glob("*/.writing*"))
