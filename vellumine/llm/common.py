"""Shared plumbing: the shared folder, lineage cuts, and vectorised views of Arrow text columns.

Conventions used by every operator here.  A null text is an empty text.  Only the columns an
operator names are read, so extra or clashing columns are ignored; operators that return the documents
themselves carry each input row as one struct, so that no name of theirs can meet one of the input's.  Words are runs of bytes other
than 0x20 and 0x09-0x0D, which is the same on UTF-8 bytes and on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, materialize, new_folder, shared_dir, shuffle_parts, stored  # noqa: F401
from ..workers import ship

#: Bytes of text that a vectorised step looks at together; single longer texts are taken alone.
STEP_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run."""
    ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; any other column is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_count(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# --------------------------------------------------------------------------- Arrow text as bytes


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets) of a string or binary column; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # still chunked if it was empty
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def column_ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids as int64, validity); a null id is 0 and not valid."""
    valid = ~np.asarray(col.is_null())
    return np.asarray(col.fill_null(0)).astype(np.int64), valid


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, whole rows only."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def step_texts(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES):
    """For each row range of a batch: (first row, last row, bytes, offsets from 0)."""
    body, offsets = column_bytes(batch.column(name))
    for i, j in steps(offsets, limit):
        yield i, j, body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text as offsets) of all words; words never cross texts."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    in_word = ~SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    before = np.empty(len(body), bool)
    before[0] = False
    before[1:] = in_word[:-1]
    starts = np.flatnonzero(in_word & (~before | first))
    after = np.empty(len(body), bool)
    after[-1] = True
    after[:-1] = ~in_word[1:] | first[1:]
    ends = np.flatnonzero(in_word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --------------------------------------------------------------------------- 64-bit hashes of byte ranges

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes (uint8, by a random table) or of 64-bit symbols."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((_BYTE[values] if values.dtype == np.uint8 else values) * up[:-1], out=sums[1:])
    got = (sums[ends] - sums[starts]) * down[starts]
    return mix(got ^ ((ends - starts).astype(U) * U(0xE7037ED1A0B428DB)))


def counts_to_rows(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; read with unpack()."""
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
