"""Operator 3, SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words joined by one space into shingles of four (fewer words: all of them
as one; none: fingerprint 0), XXH64 with seed 42 of each shingle, repeats included; a bit is 1 if over
half of the hashes have it.  Fingerprints that differ in at most four bits are linked.

Search: equal fingerprints are one class.  The 64 bits form six blocks; two fingerprints within four bits
agree in two blocks at least, so each is dealt to 15 tables by a pair of blocks, about 21 bits.  Within a
table key, fingerprints are sorted by Gray rank; runs with equal leading bits are nodes of a tree whose
upper nodes hold the shared pattern once.  Node pairs are compared from the top with the differences so
far; whole groups go when these exceed the limit, or when all below them is known to be one component.
Only a spanning forest of each key leaves the task, never all pairs.  Keys with more than `hot`
fingerprints are dealt once more by two of six blocks of their other bits, which loses no link either.
The forests are joined by alternating large-star and small-star steps, each written to the shared folder.

Null text: fingerprint 0, linked like any other.  Null doc_id: kept; a component of null ids only has a
null component_id.  Repeated rows: each returned.  Empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from .common import U, counts_to_rows, discard, materialize, ready, runs, shuffle_parts, step_texts, stored, words_of

BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))  # (shift, bits)
LEVELS = (16, 32, 48, 64)  # leading bits that a node's leaves share
ROOM = 1 << 20  # node pairs expanded at a time
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def step_fingerprints(body: np.ndarray, offsets: np.ndarray, width: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints (int64) of the texts of one step."""
    import xxhash

    starts, ends, first = words_of(body, offsets)
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(starts):
        return out
    sizes = ends - starts
    text = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    at = np.cumsum(sizes + 1) - sizes - 1
    inside = np.repeat(at, sizes) + runs(sizes)
    text[inside] = LOWER[body[np.repeat(starts, sizes) + runs(sizes)]]
    raw, stop, digest = text.tobytes(), at + sizes, xxhash.xxh64_digest
    for d in range(len(out)):
        i, j = int(first[d]), int(first[d + 1])
        if i == j:
            continue
        n = max(1, j - i - width + 1)
        a = at[i : i + n].tolist()
        b = stop[min(i + width, j) - 1 : j].tolist()
        hashes = b"".join([digest(raw[x:y], seed) for x, y in zip(a, b, strict=True)])
        ones = np.zeros(64, np.int64)
        bits = np.frombuffer(hashes, np.uint8).reshape(n, 8)
        for k in range(0, n, 8192):
            ones += np.unpackbits(bits[k : k + 8192], axis=1).sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > n).view(">u8").astype(U).view(np.int64)[0]
    return out


def fingerprints(docs: DataFrame, kind: DataType | None = None) -> DataFrame:
    """(doc_id, fp): one row a document. doc_id is a long, or of another `kind` that can be ordered."""

    def run(batches):
        for batch in batches:
            for i, j, body, offsets in step_texts(batch):
                fp = pa.array(step_fingerprints(body, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), fp], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id") if kind else F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, StructType().add("doc_id", kind or LongType()).add("fp", LongType()))


# --------------------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(k))
    return x


class Forest:
    """Components by smallest member, with union of many pairs at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while True:
            x, y = of[a], of[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low = np.minimum(x, y)
            np.minimum.at(of, x, low)
            np.minimum.at(of, y, low)
            while not np.array_equal(of, up := of[of]):
                of[:] = up


def link(keys: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Component label (an index) of each of the fingerprints sorted by (key, Gray rank); fps too.

    Pairs are looked for within equal keys only.
    """
    rank = gray_rank(fps)
    order = np.lexsort((rank, keys))
    keys, fps = keys[order], fps[order]
    n = len(fps)
    forest = Forest(n)
    near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= limit))
    forest.union(near, near + 1)  # neighbours in Gray order differ least
    # nodes: level 0 is a key, then runs of equal leading bits; the last level is a fingerprint
    marks = [np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])]
    for bits in LEVELS:
        lead = fps >> U(64 - bits)
        marks.append(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (lead[1:] != lead[:-1])]))
    patterns = [np.zeros(len(marks[0]), U)]
    for k, bits in enumerate(LEVELS):
        own = bits - (LEVELS[k - 1] if k else 0)
        patterns.append((fps[marks[k + 1]] >> U(64 - bits)) & U((1 << own) - 1))
    child = [np.searchsorted(marks[k + 1], np.r_[marks[k], n]) for k in range(len(LEVELS))]

    def settled(level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        low, high = np.minimum.reduceat(forest.of, marks[level]), np.maximum.reduceat(forest.of, marks[level])
        return (low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v])

    def search(level: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        if level == len(LEVELS):
            forest.union(marks[level][u], marks[level][v])
            return
        live = ~settled(level, u, v)
        u, v, d = u[live], v[live], d[live]
        first, count = child[level][:-1], np.diff(child[level])
        pairs = count[u] * count[v]
        upto = np.cumsum(pairs)
        i = 0
        while i < len(u):
            base = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, base + ROOM, "right")))
            if i:  # what was joined meanwhile
                live = ~settled(level, u[i:j], v[i:j])
            else:
                live = np.ones(j - i, bool)
            a, b, e = u[i:j][live], v[i:j][live], d[i:j][live]
            wide = count[a] * count[b]
            # one pair of nodes may have more children than there is room for
            for lo in range(0, max(1, int(wide.max(initial=0))), ROOM):
                some = np.clip(wide - lo, 0, ROOM)
                row = counts_to_rows(some)
                k = runs(some) + lo
                x, y = first[a[row]] + k // count[b[row]], first[b[row]] + k % count[b[row]]
                diff = e[row] + np.bitwise_count(patterns[level + 1][x] ^ patterns[level + 1][y])
                ok = (diff <= limit) & ((a[row] != b[row]) | (x <= y))
                if level + 1 == len(LEVELS):
                    ok &= x != y
                x, y, diff = x[ok], y[ok], diff[ok]
                if len(x):
                    search(level + 1, x, y, diff)
            i = j

    roots = np.flatnonzero(np.diff(np.r_[marks[0], n]) > 1)
    search(0, roots, roots, np.zeros(len(roots), np.int64))
    return fps, forest.of


def block_keys(fp: Column, blocks=BLOCKS) -> Column:
    """An array with a key for each pair of blocks."""
    keys = []
    for k, ((s1, b1), (s2, b2)) in enumerate(combinations(blocks, 2)):
        one = F.shiftrightunsigned(fp, s1).bitwiseAND((1 << b1) - 1)
        two = F.shiftrightunsigned(fp, s2).bitwiseAND((1 << b2) - 1)
        keys.append(F.lit(k << 24) + F.shiftleft(one, b2) + two)
    return F.array(*keys)


def rest_keys(fp: Column, key: Column) -> Column:
    """For a crowded key: keys by two of six blocks of the bits that the key doesn't hold."""
    out = []
    for k, pair in enumerate(combinations(range(6), 2)):
        free = [s + i for n, (s, b) in enumerate(BLOCKS) if n not in pair for i in range(b)]
        parts = []
        for lo in range(6):
            mask = sum(1 << i for i in free[lo::6])
            parts.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        subs = F.array(*[F.xxhash64(key, F.lit(j), parts[x], parts[y]) for j, (x, y) in enumerate(combinations(range(6), 2))])
        out.append((F.floor(key / (1 << 24)) == k, subs))
    got = F.when(*out[0])
    for cond, subs in out[1:]:
        got = got.when(cond, subs)
    return got


def local_forests(dealt: DataFrame, limit: int, parts: int) -> DataFrame:
    """(a, b): fingerprints with the smallest-index member of their component within one key."""

    def flush(keys, fps):
        keys, fps = np.concatenate(keys), np.concatenate(fps).view(U)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        many = counts[inverse] > 1
        if not many.any():
            return None
        fps, of = link(keys[many], fps[many], limit)
        at = np.flatnonzero(of != np.arange(len(of)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[of[at]].view(np.int64))], names=["a", "b"])

    def run(batches):
        keys, fps, held = [], [], 0
        for batch in batches:
            k, f = np.asarray(batch.column("key")), np.asarray(batch.column("fp"))
            if not len(k):
                continue
            keys.append(k)
            fps.append(f)
            held += len(k)
            if held >= 100_000 and keys[0][0] != k[-1]:  # all but the last key are complete
                k, f = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(k, k[-1]))
                if (got := flush([k[:cut]], [f[:cut]])) is not None:
                    yield got
                keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
        if keys and (got := flush(keys, fps)) is not None:
            yield got

    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (a, b): alternating large-star and small-star steps."""
    edges, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old = path
        edges, path = stored(small.where("a <> b").distinct(), "edges")
        discard(edges.sparkSession, old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = now


def near_duplicates(docs: DataFrame, limit: int = 4, hot: int = 20_000, kind: DataType | None = None) -> DataFrame:
    """(doc_id, fp, component_id); `kind`: of doc_id, if it is no long (a struct, say, that says which row is least)."""
    spark = docs.sparkSession
    ready(spark)
    sigs = materialize(fingerprints(docs, kind), "fingerprints")
    classes = materialize(sigs.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    dealt = classes.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    parts = shuffle_parts(spark)
    crowded = dealt.groupBy("key").count().where(F.col("count") > hot).select("key")
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        forests = local_forests(dealt, limit, parts)
    else:
        again = dealt.join(crowded, "key", "left_semi").select("fp", F.explode(rest_keys(F.col("fp"), F.col("key"))).alias("key"))
        forests = local_forests(dealt.join(crowded, "key", "left_anti").select("fp", "key").union(again), limit, parts)
    roots = components(forests)
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return sigs.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
