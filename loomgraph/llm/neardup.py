"""SimHash near-duplicates through a binary trie self-join.

Distinct fingerprints form a binary trie: a sorted array in which a node is a range. Pairs of
nodes are traversed together, bit by bit; the differing bits are added up and a pair of nodes
is pruned once they exceed the budget. If two fingerprints differ in at most k bits, there is
one of m blocks from which on, cyclically, the first j blocks differ in at most jk/m bits, for
every j. So m tries are joined, each led by another block, with those budgets. With m above k the
leading block has no budget at all: a trie is spread over tasks by its top bits, every fingerprint
goes to m tasks, one a trie, whatever their number, and no task needs another one's.

A task keeps only links that join fingerprints not yet connected in it. Copies of a text share
their fingerprint, and of fingerprints within r bits of one there are 64 over r at most.

keep_one, the pipeline's stage, links by the similarity of the shingles themselves: the trie join of
the fingerprints proposes pairs, bands of minima those whose fingerprints are farther apart, and every
pair is held against both texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, small_batches, texts
from .common import Steps, fresh, stash
from .components import components
from .shingles import mix, shingles

BITS, SHINGLE, SEED = 64, 4, 42
#: Fingerprints aimed at below one top node, and the fewest bits of top nodes; the leading block's bits are the most.
NODE_FINGERPRINTS, LEAST_TOP = 100_000, 4
#: Node pairs expanded at once, and the product of sizes below which a pair is compared leaf by leaf.
FRONTIER, LEAVES = 1 << 18, 24


# -- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(batch: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of all texts, and how many each text has."""
    from xxhash import xxh64_digest

    digests, counts = [], []
    for t in batch:
        words = t.encode().lower().split()
        n = len(words)
        if n <= shingle:
            digests.extend([xxh64_digest(b" ".join(words), SEED)] if n else [])
            counts.append(min(n, 1))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = (ends - np.diff(ends, prepend=0)).tolist()
        digests.extend([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])
        counts.append(n - shingle + 1)
    return np.frombuffer(b"".join(digests), ">u8"), np.array(counts, np.int64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint64 per text: the bits set in over half of its hashes (big-endian); zero for a text without any."""
    out = np.zeros(len(counts), np.uint64)
    ends, block = np.cumsum(counts), 1 << 16
    lo = 0
    while lo < len(counts):
        a = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, a + block, side="right")))
        full = np.flatnonzero(counts[lo:hi]) + lo
        if len(full):
            bits = lambda x, y: np.unpackbits(hashes[x:y].view(np.uint8).reshape(-1, 8), axis=1)
            if hi - lo == 1:  # one text, which may be long, in parts
                sums = sum(bits(p, min(p + block, ends[lo])).sum(axis=0, dtype=np.int64) for p in range(a, ends[lo], block))[None]
            else:
                sums = np.add.reduceat(bits(a, ends[hi - 1]), (ends - counts)[full] - a, axis=0, dtype=np.int32)
            out[full] = np.packbits(sums * 2 > counts[full, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
        lo = hi
    return out


def simhash(batch: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 per text: a bit is set if it is in over half the shingles' XXH64 values; no words: zero."""
    return majority(*shingle_hashes(batch, shingle))


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns keep of docs, and fp: the fingerprint of its column text as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = simhash(texts(batch), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


# -- the trie -------------------------------------------------------------------------------


class Trie:
    """A binary trie over sorted distinct 64-bit keys; a node is a range of them at a depth."""

    def __init__(self, keys: np.ndarray):
        self.keys, self._ones = keys, {}

    def middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the second child of each node begins."""
        if depth not in self._ones:
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        ones = self._ones[depth]
        return hi - (ones[hi] - ones[lo])


def block_ends(blocks: int, lead: int = 0) -> list[int]:
    """The bits at which near equal blocks end, in the cyclic order that begins with the block lead."""
    width = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    return np.cumsum(width[lead:] + width[:lead]).tolist()


def join_tries(a: Trie, b: Trie, same: bool, most: int, ends: list[int], found) -> None:
    """Call found(i, j) with arrays of positions of keys in a and b whose first j blocks, which end at ends, differ in at most j * most / blocks bits, for every j.

    With same, a is b and each pair is given once, i < j.
    """
    budgets = [(int(np.searchsorted(ends, d, side="right")) + 1) * most // len(ends) for d in range(BITS)]
    if len(a.keys) == 0 or len(b.keys) == 0:
        return
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero + len(a.keys), zero, zero + len(b.keys), np.zeros(1, np.int8))]
    while stack:
        depth, lo1, hi1, lo2, hi2, acc = stack.pop()
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            stack.append((depth, lo1[half:], hi1[half:], lo2[half:], hi2[half:], acc[half:]))
            lo1, hi1, lo2, hi2, acc = lo1[:half], hi1[:half], lo2[:half], hi2[:half], acc[:half]
            stack.append((depth, lo1, hi1, lo2, hi2, acc))
            continue
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = (n1 * n2 <= LEAVES) | (depth == BITS)
        if small.any():
            _leaves(a, b, same, most, ends, lo1[small], n1[small], lo2[small], n2[small], found)
            big = ~small
            lo1, hi1, lo2, hi2, acc = lo1[big], hi1[big], lo2[big], hi2[big], acc[big]
        if len(lo1) == 0:
            continue
        m1, m2 = a.middle(lo1, hi1, depth), b.middle(lo2, hi2, depth)
        more = acc < budgets[depth]
        twin = (lo1 == lo2) & (hi1 == hi2) if same else np.zeros(len(lo1), bool)
        cross = more & ~twin
        parts = [
            (lo1, m1, lo2, m2, acc),
            (m1, hi1, m2, hi2, acc),
            (lo1[more], m1[more], m2[more], hi2[more], acc[more] + 1),
            (m1[cross], hi1[cross], lo2[cross], m2[cross], acc[cross] + 1),
        ]
        lo1, hi1, lo2, hi2, acc = (np.concatenate(x) for x in zip(*parts))
        live = (lo1 < hi1) & (lo2 < hi2)
        stack.append((depth + 1, lo1[live], hi1[live], lo2[live], hi2[live], acc[live]))


def _leaves(a, b, same, most, ends, lo1, n1, lo2, n2, found) -> None:
    size = n1 * n2
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        start = upto[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, start + (1 << 21), side="right")))
        s = size[lo:hi]
        pair = np.repeat(np.arange(lo, hi), s)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
        i, j = lo1[pair] + at // n2[pair], lo2[pair] + at % n2[pair]
        diff = a.keys[i] ^ b.keys[j]
        ok = np.bitwise_count(diff) <= most
        for k, end in enumerate(ends[:-1], 1):
            ok &= np.bitwise_count(diff >> np.uint64(BITS - end)) <= k * most // len(ends)
        if same:
            ok &= i < j
        if ok.any():
            found(i[ok], j[ok])
        lo = hi


class Forest:
    """Keeps, of the links it is given, those that join parts not yet connected: fewer than its nodes."""

    def __init__(self, n: int):
        self.root, self.kept = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self._find(i), self._find(j)
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if len(i) == 0:
                return
            high, low = np.maximum(ri, rj), np.minimum(ri, rj)
            _, first = np.unique(high, return_index=True)  # one link for each root that goes below another
            self.root[high[first]] = low[first]
            self.kept.append((i[first], j[first]))

    def _find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                self.root[x] = r
                return r
            r = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([k[0] for k in self.kept]), np.concatenate([k[1] for k in self.kept])


# -- the distributed join -------------------------------------------------------------------


def near_links(prints: DataFrame, most: int, n: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct values of column fp that differ in at most most bits: all that connect, though not all."""
    n, blocks = prints.count() if n is None else n, most + 1
    top = LEAST_TOP
    while top < BITS // blocks and n >> top > NODE_FINGERPRINTS:
        top += 1
    top = min(top, BITS // blocks)
    back = [0, *block_ends(blocks)[:-1]]
    turned = [F.col("fp") if r == 0 else F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", BITS - r)) for r in back]
    rows = prints.select(F.posexplode(F.array(*turned)).alias("trie", "key"))
    rows = rows.select((F.shiftrightunsigned("key", BITS - top) * blocks + F.col("trie")).alias("task"), "key")
    parts = max(1, min(blocks << top, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2))
    rows = rows.repartition(parts, "task").sortWithinPartitions("task")

    def done(task, held):
        key = np.sort(np.concatenate(held))
        forest, trie, turn = Forest(len(key)), Trie(key), task % blocks
        join_tries(trie, trie, True, most, block_ends(blocks, turn), forest.add)
        r = back[turn]
        fp = key if r == 0 else (key >> np.uint64(r)) | (key << np.uint64(BITS - r))
        i, j = forest.links()
        for at in range(0, len(i), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(fp[x[at : at + (1 << 16)]].view(np.int64)) for x in (i, j)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            tasks, key = batch.column("task").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if task is not None and tasks[x] != task:
                    yield from done(task, held)
                    held = []
                task = int(tasks[x])
                held.append(key[x:y])
        if held:
            yield from done(task, held)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Documents whose fingerprints differ in at most most bits are linked; component_id is the
    least doc_id reachable. Copies share a fingerprint, which enters the join once. Null and
    empty texts have the fingerprint zero and link like others; null ids count for no
    component's id (null if it has no other); repeated rows keep their rows; an empty table
    gives none; other columns are not read.
    """
    rows = stash(with_fingerprints(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), ["doc_id"], shingle), "fingerprints")
    n = rows.count()
    with Steps(docs.sparkSession) as steps:
        prints = steps.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints", at_most=n)
        linked = components(near_links(prints, most, n=n), at_most=(most + 1) * n)
        rooted = prints.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of_print = stash(rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id"), "classes", at_most=n)
    return rows.join(of_print, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: keep_one's shingle and similarity, as a fraction, and its bands of minima: a pair at 0.8 shares none with a probability of 0.00006.
WORDS, SIMILAR, BANDS, MINIMA = 5, (4, 5), 32, 6


def shingle_sets(batch: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text by text in rising order, where each text's begin, and how many there are."""
    term, owner = shingles([t.encode() for t in batch], shingle)
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    if len(term):
        new = np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]
        term, owner = term[new], owner[new]
    size = np.bincount(owner, minlength=len(batch)).astype(np.int64)
    return term, np.cumsum(size) - size, size


def with_bands(docs: DataFrame, keep: list[str], shingle: int = WORDS) -> DataFrame:
    """The columns keep of docs, and of its column text: node, a hash of the set of shingles, its size, bands, each a hash of MINIMA minima, none for a text without words, and fp, the fingerprint."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    rng = np.random.Generator(np.random.PCG64(SEED))
    salts, odd = (rng.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = texts(batch)
            term, first, size = shingle_sets(given, shingle)
            full = np.flatnonzero(size)
            node = np.zeros(len(size), np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                node[full] = mix(np.add.reduceat(mix(term), first[full]) + size[full].astype(np.uint64))
                for k in range(BANDS * MINIMA):
                    h = (term ^ salts[k]) * odd[k]
                    h = (h ^ (h >> np.uint64(32))) * odd[k]
                    bands[:, k // MINIMA] = mix(bands[:, k // MINIMA] + np.minimum.reduceat(h, first[full]) + np.uint64(k))
            offsets = np.r_[0, np.cumsum((size > 0) * BANDS)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(node.view(np.int64)), pa.array(size), lists, pa.array(simhash(given).view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, terms): the set of shingles of each text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            term, first, _ = shingle_sets(texts(batch), shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(term)].astype(np.int32)), pa.array(term.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "terms"])

    return docs.select("node", "text").mapInArrow(run, "node long, terms array<long>")


def similar(a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity of two sets of longs is SIMILAR or more, in whole numbers."""
    over, under = SIMILAR
    return F.size(F.array_intersect(a, b)) * (over + under) >= (F.size(a) + F.size(b)) * over


def fits(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    over, under = SIMILAR
    return F.least(x, y) * under >= F.greatest(x, y) * over


def rare_pairs(sets: DataFrame, nodes: DataFrame, steps: Steps) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, size, root) of different roots whose sets (node, terms) may be similar.

    Terms are ordered by how many of the sets hold them. Sets of a similarity of s or more have
    s times the larger one's size in common at least, so that not all of one's rarest
    size - s * size + 1 terms can be missing from the other's. Terms that one set holds alone are the
    rarest, and need not be compared.
    """
    over, under = SIMILAR
    terms = sets.select("node", F.explode("terms").alias("term"))
    shared = terms.groupBy("term").agg(F.count(F.lit(1)).alias("often")).where("often > 1").select(F.col("term").alias("of"), "often")
    ordered = terms.join(shared, F.col("term") == F.col("of")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "term"))).alias("shared"))  # a text's own shingles
    prefix = F.col("size") - F.ceil(F.col("size") * over / F.lit(under)) + 1 - (F.col("size") - F.size("shared"))
    rare = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix).cast("int"))
    placed = steps.written(ordered.join(nodes, "node").select("node", "size", "root", F.explode(rare).alias("r")).select("node", "size", "root", "r.term"), "rare")
    x, y = (placed.select("term", *(F.col(c).alias(p + c) for c in ("node", "size", "root"))) for p in "xy")
    return x.join(y, "term").where((F.col("xnode") < F.col("ynode")) & (F.col("xroot") != F.col("yroot")) & fits(F.col("xsize"), F.col("ysize"))).select(F.col("xnode").alias("a"), F.col("ynode").alias("b"))


def print_pairs(prints: DataFrame, n: int, steps: Steps, most: int = 4) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, size, fp) that the trie join of their fingerprints links, or that share one, and whose sizes allow the similarity.

    A fingerprint stands for its least node; the others of it meet that one.
    """
    held = steps.written(prints.groupBy("fp").agg(F.min("node").alias("of_fp"), F.min_by("size", "node").alias("of_size")), "held", at_most=n)
    end = lambda p: held.select(F.col("fp").alias(p), F.col("of_fp").alias(p + "_node"), F.col("of_size").alias(p + "_size"))
    linked = near_links(held.select("fp"), most, n=n).join(end("a"), "a").join(end("b"), "b").select("a_node", "a_size", "b_node", "b_size")
    shared = prints.join(held, "fp").where("node <> of_fp").select("of_fp", "of_size", "node", "size").toDF("a_node", "a_size", "b_node", "b_size")
    met = linked.unionByName(shared).where(fits(F.col("a_size"), F.col("b_size")))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def similar_links(docs: DataFrame, prints: DataFrame, n: int, shingle: int, steps: Steps) -> DataFrame:
    """(of, root): the least node that each linked node reaches over pairs of a similarity of SIMILAR or more whose fingerprints are linked or that share a band.

    Candidates are linked by the trie join or share a band, and their sizes allow the similarity. Every
    candidate is held against the shingles themselves, unless verified links connect it already: first those
    of the trie join, and each node and the least node it meets, then each node and the least of each of its bands. What
    is left are nodes that meet another one without being connected to it. Those are paired by
    rare shingles: of two sets that are similar, the rarest fifth and one more of either's
    elements has one in common. Texts that share boilerplate and no more are not paired at all.
    """
    rows = prints.select("node", "size", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.min_by("size", "node").alias("least_size")).where("n > 1").select(F.col("band").alias("shared"), "least", "least_size")
    met = steps.written(rows.join(shared, F.col("band") == F.col("shared")).select("band", "node", "size", "least", "least_size"), "met", at_most=BANDS * n)
    stars = met.where((F.col("node") != F.col("least")) & fits(F.col("size"), F.col("least_size"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    id_name, h_name, node_name = fresh(docs, "id", "h", "node")
    reps = prints.select(F.col("node").alias("rep"), "first.doc_id", "first.h")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, terms) of (rep), written."""
        wanted = nodes.join(reps, "rep").toDF(node_name, id_name, h_name)
        rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(h_name))).select(F.col(node_name).alias("node"), "text")
        return steps.written(_sets(rows, shingle).dropDuplicates(["node"]), "sets")

    def others() -> DataFrame:
        placed = met.join(roots, F.col("node") == F.col("of"), "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("band").alias("mixed"))
        open_ = steps.written(placed.join(mixed, F.col("band") == F.col("mixed")).select("node", "size", "root").distinct(), "open", at_most=n)
        return rare_pairs(sets_of(open_.select(F.col("node").alias("rep"))), open_, steps)

    tested = links = roots = None
    first = lambda: print_pairs(prints, n, steps).unionByName(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    for step in (first, lambda: stars, others):
        pairs = step().distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
            of = lambda c: roots.select(F.col("of").alias(f"of_{c}"), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
            pairs = pairs.join(of("a"), F.col("a") == F.col("of_a"), "left").join(of("b"), F.col("b") == F.col("of_b"), "left")
            pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        pairs = steps.written(pairs, "pairs")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("terms").alias("a_terms")), "a").join(sets.select(F.col("node").alias("b"), F.col("terms").alias("b_terms")), "b")
        found = steps.written(both.where(similar(F.col("a_terms"), F.col("b_terms"))).select("a", "b"), "links", at_most=n)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        roots = components(links, at_most=4 * n).withColumnRenamed("node", "of")
    return roots


def keep_one(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """docs with one document of each group of near-duplicates; all columns stay as they are, whatever their names.

    Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more are
    linked. Of a group, that of the least doc_id stays, the least text hash among rows that
    share it, null ids last; of rows equal in both, the one with the least hash of all its
    columns. Texts without words are one group.
    """
    id_name, h_name = fresh(docs, "id", "h")
    n = docs.count()
    with Steps(docs.sparkSession) as steps:
        rows = with_bands(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("h")), ["doc_id", "h"], shingle)
        first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
        prints = steps.written(rows.groupBy("node").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "prints", at_most=n * BANDS // 4)
        linked = similar_links(docs, prints, n, shingle, steps)
        best = prints.select("node", "first").join(linked, F.col("node") == F.col("of"), "left")
        chosen = stash(best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(id_name), F.col("first.h").alias(h_name)), "chosen", at_most=n)
        repeated = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").limit(1).count()
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(h_name)), "left_semi")
    if not repeated:
        return kept
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return kept.groupBy(F.col("doc_id").alias("k"), F.col("text").alias("t")).agg(least.alias("r")).select("r.*")
