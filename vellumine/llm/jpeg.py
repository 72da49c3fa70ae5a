"""Operator 4, media columns: progressive JPEG in numpy.

decode() reads any 8-bit Huffman-coded progressive file (spectral selection, successive approximation,
restart intervals, sampling factors up to 4): scans are accumulated into coefficient arrays, which are
dequantized, inverse-transformed, upsampled by repetition and turned into a full-resolution RGB tensor.
Scans whose tables hold one code are read as arrays of bits; all others symbol by symbol.

A text's payload (its UTF-8 bytes, then bytes 255 up to a positive multiple of 576) is stored in the
format's unit, the quantized coefficient: 64 bytes a block, four Y blocks, one Cb and one Cr a unit of
16 x 16 pixels, quantizers 1.  An AC coefficient is +-(256 + byte); a DC coefficient is 2 d + (byte & 1)
where d changes by +-(128 + (byte >> 1)) from block to block.  Signs alternate.  Every coefficient then
has a category of its own bits only, so nothing is lost.  Blocks beyond the payload hold 255; a comment
holds the payload's length.

Null text: an empty payload, 576 bytes 255.  Null doc_id: kept.  Repeated rows: equal values.  Empty
table: empty result.  A very long text is one file, made by one task in some 60 times its bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STEP_BYTES, id_text, new_folder, ready, step_texts

UNIT = 576
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_c = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
#: pixels = coefficients in zigzag order @ INVERSE
INVERSE = np.ascontiguousarray(np.einsum("yv,xu->vuyx", _c, _c).reshape(64, 64)[ZIGZAG])
SIGN = np.where(np.arange(64) % 2 == 0, 1, -1)
AC_BANDS = ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63))  # component, first and last coefficient


@dataclass
class Component:
    id: int
    h: int
    v: int
    quantizer: int
    blocks: np.ndarray | None = None  # rows, columns, 64 in zigzag order; whole units
    own: tuple[int, int] = (0, 0)  # rows and columns of blocks in a scan of its own


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _one_code(kind: int, ident: int, symbol: int) -> bytes:
    return bytes([kind << 4 | ident, 1, *[0] * 15, symbol])


def _entropy(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate((bits, np.ones(pad, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan_head(ids: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(ids), *[x for i in ids for x in (i, 0)], ss, se, ah << 4 | al]))


_BITS8 = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def _coded(values: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Bits of magnitudes 128..255 in category 8 after a code of one 0: nine bits each."""
    out = np.zeros((*values.shape, 9), np.uint8)
    out[..., 1:] = _BITS8[np.where(negative, 255 - values, values)]
    return out


def encode_payload(payload: np.ndarray) -> bytes:
    """A progressive JPEG file that holds bytes (a positive multiple of 576) as coefficients."""
    units = -(-len(payload) // 384)
    high = -(-units // max(64, -(-units // 4095)))
    wide = -(-units // high)
    data = np.full(wide * high * 384, 255, np.uint8)
    data[: len(payload)] = payload
    data = data.reshape(high, wide, 6, 64)
    y = data[:, :, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * high, 2 * wide, 64)
    parts = (y, data[:, :, 4], data[:, :, 5])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, _one_code(0, 0, 8) + _one_code(1, 0, 8)))
    # DC: signs alternate along each component
    dc = data[..., 0].reshape(-1, 6)
    turn = np.empty(dc.shape, bool)
    turn[:, :4] = (np.arange(4) % 2 == 1)[None]
    turn[:, 4:] = (np.arange(len(dc)) % 2 == 1)[:, None]
    out += [_scan_head([1, 2, 3], 0, 0, 0, 1), _entropy(_coded(128 + (dc >> 1), turn).reshape(-1))]
    for c, ss, se in AC_BANDS:
        part = parts[c][..., ss : se + 1]
        out += [_scan_head([c + 1], ss, se, 0, 1), _entropy(_coded(128 + (part >> 1), np.broadcast_to(SIGN[ss : se + 1] < 0, part.shape)).reshape(-1))]
    out.append(_segment(0xC4, _one_code(1, 0, 0)))
    for c in range(3):
        part = parts[c]
        bits = (part & 1).reshape(-1, 64).copy()
        bits[:, 0] = 0  # the code of the block's end
        out += [_scan_head([c + 1], 1, 63, 1, 0), _entropy(bits.reshape(-1))]
    out += [_scan_head([1, 2, 3], 0, 0, 1, 0), _entropy((dc & 1).reshape(-1)), b"\xff\xd9"]
    return b"".join(out)


# --------------------------------------------------------------------------- decoding


class _Table:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                self.codes[size, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(self.codes) == 1 and counts[0] == 1 else None


class _Reader:
    """Bits of one entropy-coded segment, one after another."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def bit(self) -> int:
        if self.at >= len(self.bits):
            raise ValueError("a scan is cut short")
        self.at += 1
        return int(self.bits[self.at - 1])

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.bit()
        return x

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if n == 0 or x >> (n - 1) else x - (1 << n) + 1

    def symbol(self, table: _Table) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.bit()
            if (size, code) in table.codes:
                return table.codes[size, code]
        raise ValueError("no such code")

    def rows(self, n: int, wide: int) -> np.ndarray:
        if self.at + n * wide > len(self.bits):
            raise ValueError("a scan is cut short")
        self.at += n * wide
        return self.bits[self.at - n * wide : self.at].reshape(n, wide)


def _numbers(bits: np.ndarray, size: int) -> np.ndarray:
    """Signed values of `size` bits each (last axis)."""
    if size == 8:
        x = np.packbits(bits, axis=-1)[..., 0].astype(np.int32)
    else:
        x = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
    return np.where(x >> (size - 1) & 1, x, x - (1 << size) + 1) if size else x


@lru_cache(256)
def _raster(rows: int, cols: int) -> np.ndarray:
    return np.stack(np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij"), -1).reshape(-1, 1, 2)


@lru_cache(256)
def _units(high: int, wide: int, v: int, h: int) -> np.ndarray:
    """Places of a component's blocks, unit by unit."""
    r, k, y, x = np.meshgrid(np.arange(high), np.arange(wide), np.arange(v), np.arange(h), indexing="ij")
    return np.stack((r * v + y, k * h + x), -1).reshape(high * wide, v * h, 2)


def _scan(image: Image, members, tables, ss, se, ah, al, segments: list[bytes], restart: int) -> None:
    alone = len(members) == 1
    if alone:
        c = members[0][0]
        rows, cols = c.own
        order = [_raster(rows, cols)]
        n = rows * cols
    else:
        order = []
        for c, *_ in members:
            high, wide = c.blocks.shape[0] // c.v, c.blocks.shape[1] // c.h
            order.append(_units(high, wide, c.v, c.h))
            n = high * wide
    step = restart or n
    for s, lo in enumerate(range(0, n, step)):
        if s >= len(segments):
            raise ValueError("a restart interval is missing")
        reader, hi = _Reader(segments[s]), min(lo + step, n)
        where = [o[lo:hi] for o in order]
        if ss == 0:
            _dc(reader, members, tables, where, ah, al)
        else:
            table = tables[1, members[0][2]]
            block = members[0][0].blocks
            at = where[0][:, 0]
            part = block[at[:, 0], at[:, 1], ss : se + 1]
            (_ac_first if ah == 0 else _ac_refine)(reader, table, part, al)
            block[at[:, 0], at[:, 1], ss : se + 1] = part


def _dc(reader, members, tables, where, ah, al):
    per = [w.shape[1] for w in where]
    n = len(where[0])
    if ah:
        bits = reader.rows(n, sum(per)).astype(np.int32)
        k = 0
        for (c, *_), w, p in zip(members, where, per, strict=True):
            c.blocks[w[..., 0], w[..., 1], 0] |= bits[:, k : k + p] << al
            k += p
        return
    only = {tables[0, td].only for _, td, _ in members}
    if len(only) == 1 and None not in only and 0 < (size := next(iter(only))) <= 11:
        bits = reader.rows(n, sum(per) * (1 + size)).reshape(n, sum(per), 1 + size)
        if bits[..., 0].any():
            raise ValueError("no such code")
        diff, k = _numbers(bits[..., 1:], size), 0
        for (c, *_), w, p in zip(members, where, per, strict=True):
            c.blocks[w[..., 0], w[..., 1], 0] = np.cumsum(diff[:, k : k + p].reshape(-1)).reshape(n, p) << al
            k += p
        return
    last = [0] * len(members)
    for i in range(n):
        for m, ((c, td, _), w) in enumerate(zip(members, where, strict=True)):
            for y, x in w[i]:
                last[m] += reader.signed(reader.symbol(tables[0, td]))
                c.blocks[y, x, 0] = last[m] << al


def _ac_first(reader, table, part, al):
    n, band = part.shape
    if table.only is not None and table.only >> 4 == 0 and 0 < (size := table.only & 15) <= 14:
        bits = reader.rows(n * band, 1 + size)
        if bits[:, 0].any():
            raise ValueError("no such code")
        part[:] = _numbers(bits[:, 1:], size).reshape(n, band) << al
        return
    run = 0
    for i in range(n):
        if run:
            run -= 1
            continue
        k = 0
        while k < band:
            rs = reader.symbol(table)
            r, size = rs >> 4, rs & 15
            if size:
                k += r
                part[i, k] = reader.signed(size) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + reader.take(r) - 1
                break


def _ac_refine(reader, table, part, al):
    n, band = part.shape
    one = 1 << al
    if table.only == 0 and part.all():
        bits = reader.rows(n, 1 + band)
        if bits[:, 0].any():
            raise ValueError("no such code")
        part += np.where(part > 0, 1, -1) * (bits[:, 1:].astype(np.int32) << al)
        return
    run = 0

    def correct(i, k):
        if reader.bit() and not abs(part[i, k]) & one:
            part[i, k] += one if part[i, k] > 0 else -one

    for i in range(n):
        k = 0
        if not run:
            while k < band:
                rs = reader.symbol(table)
                r, size = rs >> 4, rs & 15
                new = 0
                if size:
                    new = one if reader.bit() else -one
                elif r < 15:
                    run = (1 << r) + reader.take(r)
                    break
                while k < band:
                    if part[i, k]:
                        correct(i, k)
                    elif r == 0:
                        if new:
                            part[i, k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if run:
            for k in range(k, band):
                if part[i, k]:
                    correct(i, k)
            run -= 1


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """Coefficients of a progressive file, from all its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, tables, quantizers, restart, comments = 2, None, {}, {}, 0, []
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quantizers[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("only 8-bit images of one or three components")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            image = Image(height, width, parts)
            top_h, top_v = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                rows, cols = -(-height // (8 * top_v)) * c.v, -(-width // (8 * top_h)) * c.h
                c.blocks = np.zeros((rows, cols, 64), np.int32)
                c.own = (-(-(-(-height * c.v // top_v)) // 8), -(-(-(-width * c.h // top_h)) // 8))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            by_id = {c.id: c for c in image.components}
            members = [(by_id[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _END.search(data, at)
            if not end:
                raise ValueError("a scan has no end")
            coded, at = data[at : end.start()], end.start()
            segments = [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(coded) if restart else [coded])]
            _scan(image, members, tables, ss, se, approx >> 4, approx & 15, segments, restart)
    if image is None:
        raise ValueError("no frame")
    image.quantizers, image.comments = quantizers, comments
    return image


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component, inverse-transformed; whole blocks."""
    out = []
    for c in image.components:
        rows, cols, _ = c.blocks.shape
        q = image.quantizers[c.quantizer]
        flat = (c.blocks.reshape(-1, 64) * q).astype(np.float64) @ INVERSE
        # ties are rounded up by more than the error of the sum, so equal blocks give equal samples
        flat = np.clip(np.floor(flat + 128.5 + 2.0**-20), 0, 255).astype(np.uint8)
        out.append(flat.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    return out


def rgb(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor, height x width x 3."""
    got = planes(image)
    h, w = image.height, image.width
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, got, strict=True):
        if top_v % c.v or top_h % c.h:
            p = p[np.arange(h) * c.v // top_v][:, np.arange(w) * c.h // top_h]
        else:
            p = p.repeat(top_v // c.v, 0).repeat(top_h // c.h, 1)
        full.append(p[:h, :w].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0].astype(np.uint8)[..., None], 3, -1)
    y, cb, cr = full
    cb, cr = cb - 128, cr - 128
    y = (y << 16) + (1 << 15)
    out = np.stack((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb), -1) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)


def payload_of(image: Image) -> np.ndarray:
    """The bytes that encode_payload() stored."""
    n = int(next(c for c in image.comments if c.startswith(b"payload ")).split()[1])
    high, wide = (x // 16 for x in (image.height, image.width))
    out = np.empty((high, wide, 6, 64), np.uint8)
    y, cb, cr = (c.blocks for c in image.components)
    out[:, :, :4] = _bytes_of(y).reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, 64)
    out[:, :, 4], out[:, :, 5] = _bytes_of(cb), _bytes_of(cr)
    dc = np.concatenate((y[..., :1].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(-1), cb[..., 0].reshape(-1), cr[..., 0].reshape(-1)))
    k = high * wide
    for part, lo, hi in ((slice(0, 4), 0, 4 * k), (4, 4 * k, 5 * k), (5, 5 * k, 6 * k)):
        v = dc[lo:hi]
        d = v >> 1
        change = np.abs(np.diff(np.r_[0, d])) - 128
        out[:, :, part, 0] = ((change << 1) | (v & 1)).reshape(out[:, :, part, 0].shape)
    return out.reshape(-1)[:n]


def _bytes_of(blocks: np.ndarray) -> np.ndarray:
    return (np.abs(blocks) - 256).astype(np.uint8)


def features(tensor: np.ndarray) -> str:
    """height x width, then mean and deviation of each channel in hundredths, rounded down."""
    flat = tensor.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    total, square = flat.sum(0), (flat * flat).sum(0)
    mean = [int(t) * 100 // n for t in total]
    dev = [int((max(0, n * int(s) - int(t) ** 2) * 10_000 // (n * n)) ** 0.5) for t, s in zip(total, square)]
    return f"{tensor.shape[0]}x{tensor.shape[1]};mean={mean[0]},{mean[1]},{mean[2]};dev={dev[0]},{dev[1]},{dev[2]}"


def padded(text: np.ndarray) -> np.ndarray:
    out = np.full(max(1, -(-len(text) // UNIT)) * UNIT, 255, np.uint8)
    out[: len(text)] = text
    return out


class Shard:
    """Byte strings put one after another into a file of the shared folder, closed, and read back."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{name}"

    def keep(self, items: list[bytes]) -> list[bytes]:
        sizes = np.cumsum([0, *map(len, items)]).tolist()
        with self.store.open_output_stream(self.path, compression=None) as f:
            for x in items:
                f.write(x)
        with self.store.open_input_file(self.path) as f:
            return [f.read_at(b - a, a) for a, b in zip(sizes[:-1], sizes[1:])]

    def drop(self) -> None:
        self.store.delete_file(self.path)


def stored_media(body: np.ndarray, offsets: np.ndarray, folder: str, kept: bool):
    """For each text of a step: (file, image, tensor), the file decoded from the bytes that were stored, and
    the tensor as it was stored. The step's two shards go afterwards unless they are kept."""
    name = uuid.uuid4().hex
    files, tensors = Shard(folder, f"{name}.jpegs"), Shard(folder, f"{name}.rgb")
    ends = offsets.tolist()
    back = files.keep([encode_payload(padded(body[a:b])) for a, b in zip(ends[:-1], ends[1:])])
    images = [decode(x) for x in back]
    pixels = tensors.keep([rgb(x).tobytes() for x in images])
    if not kept:
        files.drop()
        tensors.drop()
    return [(x, i, np.frombuffer(p, np.uint8).reshape(i.height, i.width, 3)) for x, i, p in zip(back, images, pixels)]


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, media, height, width, rgb): the stored file and its full-resolution tensor; a batch holds
    what about a tenth of a megabyte of text makes, or one text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j, body, offsets in step_texts(batch, limit=STEP_BYTES // 10):
                files = [encode_payload(padded(body[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                images = [decode(x) for x in files]
                cols = [pa.array(files, pa.binary()), pa.array([x.height for x in images], pa.int32()), pa.array([x.width for x in images], pa.int32()), pa.array([rgb(x).tobytes() for x in images], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *cols], names=["doc_id", "media", "height", "width", "rgb"])

    return id_text(docs).mapInArrow(run, "doc_id long, media binary, height int, width int, rgb binary")


def media_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Digests of media that are stored and read back: files and tensors are written into shards of the
    shared folder, closed, opened again, and all columns but n_bytes are computed from what is read.
    With a `folder` the shards stay there; else each goes when its digests are known, since files and
    tensors together take several times the disk of the texts."""
    spark = docs.sparkSession
    ready(spark)
    kept = folder is not None
    folder = folder or new_folder(spark, "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for i, j, body, offsets in step_texts(batch):
                rows = []
                for n, (file, image, tensor) in zip(np.diff(offsets).tolist(), stored_media(body, offsets, folder, kept)):
                    back = payload_of(image).tobytes()
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(tensor)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=names)

    return id_text(docs).mapInArrow(run, schema)
