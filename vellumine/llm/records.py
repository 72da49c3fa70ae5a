"""Operator 1, token-id output: length-delimited binary records with masked checksums and an offset index.

A record is `u64 length | u32 masked crc32c(length bytes) | data | u32 masked crc32c(data)`, all little
endian, where masked(c) = rotate_right(c, 15) + 0xa282ead8.  The data is one serialized sequence:
`u8 flags | u8 bytes per id | u16 0 | u32 ids | i64 doc_id | ids` (flag 1: the doc_id is null).
Beside each shard `x.rec` lies `x.idx`, three int64 arrays (doc_id, offset, length of the record) after
their count, so that a shuffled reader fetches any record by one ranged read.

Shards hold ranges of doc_id in ascending order (null first); rows with one doc_id are ordered by their
ids.  Null text: only the end id.  Empty table: no shard, no row.  Repeated rows are repeated records.
Each attempt of a task writes files of its own; only those of the attempt that succeeded are ever named.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U, column_bytes, column_ids, id_text, new_folder, ready, shuffle_parts
from .tokens import encoder

IDS = "doc_id long, shard int, n_ids long, ids binary"
MANIFEST = "shard int, path string, n_records long, n_ids long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record_offset long, record_bytes long"
BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(255)]
    # shift[j, b]: what byte j of a checksum becomes after BLOCK zero bytes
    shift = np.zeros((4, 256), np.uint32)
    for j in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        for _ in range(BLOCK):
            c = (c >> np.uint32(8)) ^ t[0][c & np.uint32(255)]
        shift[j] = c
    return t, shift


_T, _SHIFT = _tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings (4 bytes each at least), all together by blocks."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    room = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - sizes  # zeros in front change nothing, since the register starts at 0
    for p, s in zip(parts, starts.tolist(), strict=True):
        room[s : s + len(p)] = np.frombuffer(p, np.uint8)
    for k in range(4):  # the usual start value, folded into the first four bytes
        room[starts + k] ^= 255
    rows = room.reshape(-1, BLOCK)
    c = np.zeros(len(rows), np.uint32)
    for at in range(0, BLOCK, 8):
        b = rows[:, at : at + 8]
        w = b[:, :4].copy().view("<u4")[:, 0] ^ c
        c = _T[7][w & 255] ^ _T[6][(w >> 8) & 255] ^ _T[5][(w >> 16) & 255] ^ _T[4][w >> 24]
        c ^= _T[3][b[:, 4]] ^ _T[2][b[:, 5]] ^ _T[1][b[:, 6]] ^ _T[0][b[:, 7]]
    first = np.cumsum(blocks) - blocks
    total, live, k = np.zeros(len(parts), np.uint32), np.arange(len(parts)), 0
    while len(live):
        t = total[live]
        t = _SHIFT[0][t & 255] ^ _SHIFT[1][(t >> 8) & 255] ^ _SHIFT[2][(t >> 16) & 255] ^ _SHIFT[3][t >> 24]
        total[live] = t ^ c[first[live] + k]
        k += 1
        live = live[blocks[live] > k]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    head = struct.pack("<BBHIq", int(doc_id is None), width, 0, len(ids), doc_id or 0)
    return head + ids.astype(f"<u{width}").tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    null, width, _, n, doc_id = struct.unpack_from("<BBHIq", data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", n, 16).astype("<u4")


def frame(datas: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(d)) for d in datas]
    a, b = masked(crc32c(heads)).tolist(), masked(crc32c(datas)).tolist()
    return [b"".join((h, struct.pack("<I", x), d, struct.pack("<I", y))) for h, x, d, y in zip(heads, a, datas, b, strict=True)]


def unframe(buffer: bytes) -> list[tuple[int, bytes]]:
    """(offset, data) of each record of a buffer of whole records; raises if a checksum differs."""
    at, found, sums = 0, [], []
    while at < len(buffer):
        size, a = struct.unpack_from("<QI", buffer, at)
        data = buffer[at + 12 : at + 12 + size]
        if len(data) != size or at + 16 + size > len(buffer):
            raise ValueError(f"record at {at} is cut short")
        found.append((at, data))
        sums.append((buffer[at : at + 8], a, struct.unpack_from("<I", buffer, at + 12 + size)[0]))
        at += 16 + size
    if found and not (
        np.array_equal(masked(crc32c([s[0] for s in sums])), np.array([s[1] for s in sums], np.uint32))
        and np.array_equal(masked(crc32c([d for _, d in found])), np.array([s[2] for s in sums], np.uint32))
    ):
        raise ValueError("a record's checksum differs")
    return found


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """(doc_id, shard, n_ids, ids as little-endian 32-bit or 16-bit integers)."""

    def run(batches):
        enc = encoder(tokenizer)
        width = 4 if enc.wide else 2
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        edges = np.array(bounds, np.int64)
        for batch in batches:
            ids, valid = column_ids(batch.column("doc_id"))
            for i, j, flat, at in enc.encode_column(batch.column("text")):
                got = [np.concatenate((flat[a:b], tail)).astype(f"<u{width}").tobytes() for a, b in zip(at[:-1], at[1:])]
                own, ok = ids[i:j], valid[i:j]
                shard = np.where(ok, np.searchsorted(edges, own, "left"), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=~ok), pa.array(shard, pa.int32()), pa.array(np.diff(at) + len(tail)), pa.array(got, pa.binary())],
                    names=["doc_id", "shard", "n_ids", "ids"],
                )

    return id_text(docs).mapInArrow(run, IDS)


def write_shards(ids: DataFrame, n_shards: int, folder: str) -> DataFrame:
    """Write one .rec and one .idx a shard; a manifest row for each, naming the files of this attempt."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, out, index, at, n_ids, path, done = None, None, [], 0, 0, "", []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                cols = np.array(index, "<i8").reshape(-1, 3).T
                with store.open_output_stream(f"{path}.idx") as f:
                    f.write(struct.pack("<q", len(index)) + cols.tobytes())
                done.append((shard, path, len(index), n_ids, at))
            out = None

        for batch in batches:
            body, offsets = column_bytes(batch.column("ids"))
            ids_, valid = column_ids(batch.column("doc_id"))
            shards, ns = batch.column("shard").to_pylist(), batch.column("n_ids").to_pylist()
            for lo in range(0, batch.num_rows, 512):
                hi, datas = min(lo + 512, batch.num_rows), []
                for r in range(lo, hi):
                    raw = body[offsets[r] : offsets[r + 1]]
                    width = len(raw) // ns[r] if ns[r] else 4
                    datas.append(struct.pack("<BBHIq", int(not valid[r]), width, 0, ns[r], int(ids_[r])) + raw.tobytes())
                for r, rec in zip(range(lo, hi), frame(datas), strict=True):
                    if shards[r] != shard or out is None:
                        close()
                        shard, index, at, n_ids = shards[r], [], 0, 0
                        path = f"{root}/shard-{shard:07d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{path}.rec")
                    out.write(rec)
                    index.append((int(ids_[r]), at, len(rec)))
                    at += len(rec)
                    n_ids += ns[r]
        close()
        cols = list(zip(*done, strict=True)) if done else [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "path", "n_records", "n_ids", "n_bytes"])

    placed = ids.repartitionById(n_shards, ids.shard).sortWithinPartitions("shard", "doc_id", "ids")
    return placed.mapInArrow(run, MANIFEST)


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Read the record files back, checking every checksum: one row a record."""
    if not manifest:
        return spark.createDataFrame([], READ)
    manifest = sorted(manifest, key=lambda m: m["shard"])
    bases = np.cumsum([0, *[m["n_ids"] for m in manifest]]).tolist()
    todo = {k: (m["shard"], m["path"], bases[k]) for k, m in enumerate(manifest)}

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard, path, start = todo[k]
                with store.open_input_file(f"{path}.idx") as f:
                    (n,) = struct.unpack("<q", f.read(8))
                    _, offsets, sizes = np.frombuffer(f.read(), "<i8").reshape(3, n)
                with store.open_input_file(f"{path}.rec") as f:
                    i = 0
                    while i < n:
                        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (4 << 20))))
                        rows = []
                        part = f.read_at(int(offsets[j - 1] + sizes[j - 1] - offsets[i]), int(offsets[i]))
                        for at, data in unframe(part):
                            doc_id, ids = deserialize(data)
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), shard, int(offsets[i]) + at, len(data) + 16))
                            start += len(ids)
                        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int64(), pa.int64())
                        names = [c.split()[0] for c in READ.split(", ")]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        i = j

    return spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, READ)


def read_record(folder: str, path: str, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index, for a shuffled reader."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}.rec") as f:
        return deserialize(unframe(f.read_at(size, offset))[0][1])


def write_records(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None, n_shards: int | None = None) -> tuple[str, list]:
    """Encode and write; (folder, manifest rows, one a shard). Shard bounds are quantiles of doc_id."""
    spark = docs.sparkSession
    ready(spark)
    folder = folder or new_folder(spark, "records")
    n_shards = n_shards or shuffle_parts(spark)
    cuts = [k / n_shards for k in range(1, n_shards)]
    bounds = id_text(docs).select("doc_id").approxQuantile("doc_id", cuts, 0.1 / n_shards) if cuts else []
    bounds = sorted({int(b) for b in bounds})
    ids = encode_ids(docs, tokenizer, end_id, bounds)
    return folder, write_shards(ids, len(bounds) + 1, folder).collect()


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    folder, manifest = write_records(docs, tokenizer, end_id)
    return read_shards(docs.sparkSession, folder, manifest)
