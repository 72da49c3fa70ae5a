"""Operator 8, best-fit packing: repeat counts of length patterns by non-negative least squares.

Documents become token pieces of at most `size` tokens (longer ones are cut from the end, so only the
first piece is shorter).  Packing needs only the histogram of piece lengths, at most `size` numbers:
patterns of up to three lengths (in classes of `grain` tokens) that fill a sequence are enumerated, a
non-negative least-squares fit says how often to use each, counts are rounded down, and what is left is
packed best-fit decreasing into the room of those sequences and into new ones.  The plan is a table of
runs (length, first rank, how many, first sequence, offset) whose size depends on `size` alone; pieces
meet it by their rank within their length, counted in two levels so that a length that a third of all
pieces have is never ranked in one task.

Null text: only the end id.  Repeated rows are packed each for itself.  Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_ids, id_text, materialize, ready, shuffle_parts
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    def run(batches):
        enc = encoder(tokenizer)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            ids, valid = column_ids(batch.column("doc_id"))
            for i, _, flat, at in enc.encode_column(batch.column("text")):
                rows = []
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    x = np.concatenate((flat[a:b], tail)).astype("<u4")
                    cuts = list(range(len(x), 0, -size))[::-1]
                    for p, (a, b) in enumerate(zip([0, *cuts], cuts)):
                        rows.append((int(ids[i + k]) if valid[i + k] else None, p, a, b - a, zlib.crc32(x[a:b].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |ax - b|, x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        if passive.all() or gradient[~passive].max() <= tol:
            break
        passive[np.argmax(np.where(passive, -np.inf, gradient))] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if not len(at) or s.min() > 0:
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            passive[at[(x[at] <= 1e-12)]] = False
            x[~passive] = 0
        x[:] = 0
        x[at] = s
        gradient = a.T @ (b - a @ x)
    return x


def patterns(n: int) -> list[tuple[int, ...]]:
    """All ways to fill n class units by one to three classes, larger first."""
    out = [(n,)] + [(a, n - a) for a in range((n + 1) // 2, n)]
    return out + [(a, b, n - a - b) for a in range(n - 2, 0, -1) for b in range(min(a, n - a - 1), 0, -1) if 1 <= n - a - b <= b]


def plan(histogram: dict[int, int], size: int, grain: int = 16) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    units = size // grain
    used: dict[int, int] = defaultdict(int)  # pieces of a length that have a place
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    n_seq = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    if size in left:  # a full piece is a sequence
        count = left[size]
        place(size, count, 0, 0)
        n_seq = count
    if units >= 2 and left:
        h = np.zeros(units + 1)
        for length, count in left.items():
            h[-(-length // grain)] += count
        ways = patterns(units)
        a = np.zeros((units + 1, len(ways)))
        for j, w in enumerate(ways):
            for c in w:
                a[c, j] += 1
        scale = 1 / np.sqrt(np.maximum(h, 1))  # a class counts by its own size
        x = np.floor(nnls(a * scale[:, None], h * scale) + 1e-6).astype(np.int64)
        stock = defaultdict(list)
        for length in sorted(left):
            stock[-(-length // grain)].append(length)
        for j in np.argsort(-x, kind="stable"):
            want = int(x[j])
            while want > 0:
                pick: list[int] = []
                for c in ways[j]:
                    stock[c] = [z for z in stock[c] if z in left]
                    fits = [z for z in stock[c] if left[z] > pick.count(z)]
                    if not fits:
                        pick = []
                        break
                    pick.append(fits[-1])
                if not pick:
                    break
                many = min(want, *(left[z] // pick.count(z) for z in pick))
                offset = 0
                for z in pick:
                    place(z, many, n_seq, offset)
                    offset += z
                room[size - offset].append((n_seq, many))
                n_seq += many
                want -= many
    for length in sorted(left, reverse=True):  # residuals: best fit, longest first
        while left.get(length, 0):
            free = min((r for r, v in room.items() if r >= length and v), default=None)
            if free is None:
                per, count = size // length, left[length]
                seqs = count // per
                if seqs:
                    for k in range(per):
                        place(length, seqs, n_seq, k * length)
                    room[size - per * length].append((n_seq, seqs))
                    n_seq += seqs
                rest = left.get(length, 0)
                for k in range(rest):
                    place(length, 1, n_seq, k * length)
                if rest:
                    room[size - rest * length].append((n_seq, 1))
                    n_seq += 1
                continue
            first, many = room[free].pop()
            take = min(many, left[length])
            place(length, take, first, size - free)
            if take < many:
                room[free].append((first + take, many - take))
            room[free - length].append((first, take))
    return runs


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset."""
    spark = pieces.sparkSession
    parts = shuffle_parts(spark)
    keyed = pieces.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("length", "sub").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    schema = "length int, first long, many long, sequence long, at int"
    runs = spark.createDataFrame(plan(histogram, size), schema)
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("own_rank", F.row_number().over(own) - 1).join(bases, ["length", "sub"])
    ranked = ranked.withColumn("rank", F.col("own_rank") + F.col("base"))
    # at most a few runs a length, and lengths are at most `size`: bounded whatever the input
    meets = (ranked.length == runs.length) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["first"] + runs["many"])
    return ranked.join(F.broadcast(runs), meets).select(
        "doc_id", "piece", "start", ranked.length.cast("long").alias("length"), "ids_crc32",
        (runs["sequence"] + ranked["rank"] - runs["first"]).alias("sequence_id"), runs["at"].cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    ready(docs.sparkSession)
    return pack_pieces(materialize(token_pieces(docs, tokenizer, end_id, size), "pieces"), size)
