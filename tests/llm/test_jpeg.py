"""The decoder on files with ordinary code tables, runs of zeros, block-end runs and restart intervals."""

import struct

import numpy as np
import pytest

from vellumine.llm import jpeg


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        return jpeg._entropy(np.array(self.bits, np.uint8))


SYMBOLS = sorted({r << 4 | s for r in range(16) for s in range(11)})


def code(symbol):  # every symbol has a code of nine bits
    return SYMBOLS.index(symbol), 9


def signed(b, v, size):
    b.put(v if v > 0 else v + (1 << size) - 1, size)


def table(kind, ident):
    return jpeg._segment(0xC4, bytes([kind << 4 | ident, *[0] * 8, len(SYMBOLS), *[0] * 7, *SYMBOLS]))


def shifted(v, al):
    return int(np.sign(v)) * (abs(int(v)) >> al)


def dc_scan(blocks, al, restart):
    out, last, b = [], 0, Bits()
    for n, x in enumerate(blocks):
        if restart and n and n % restart == 0:
            out.append(b.bytes())
            last, b = 0, Bits()
        d = (int(x[0]) >> al) - last
        last = int(x[0]) >> al
        size = abs(d).bit_length()
        b.put(*code(size))
        if size:
            signed(b, d, size)
    return join([*out, b.bytes()])


def join(parts):
    out = parts[0]
    for k, p in enumerate(parts[1:]):
        out += bytes([255, 0xD0 + k % 8]) + p
    return out


def ac_first(blocks, ss, se, al):
    b, run = Bits(), 0

    def flush():
        nonlocal run
        if run:
            r = run.bit_length() - 1
            b.put(*code(r << 4))
            b.put(run - (1 << r), r)
            run = 0

    for x in blocks:
        zeros = 0
        last = max([k for k in range(ss, se + 1) if shifted(x[k], al)], default=-1)
        for k in range(ss, last + 1):
            v = shifted(x[k], al)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                b.put(*code(0xF0))
                zeros -= 16
            size = abs(v).bit_length()
            b.put(*code(zeros << 4 | size))
            signed(b, v, size)
            zeros = 0
        if last < se:
            run += 1
    flush()
    return b.bytes()


def ac_refine(blocks, ss, se, al):
    b = Bits()
    for x in blocks:
        known = [shifted(x[k], al + 1) != 0 for k in range(64)]
        now = [shifted(x[k], al) for k in range(64)]
        fresh = [k for k in range(ss, se + 1) if now[k] and not known[k]]
        last, zeros, held = max(fresh, default=-1), 0, []
        for k in range(ss, last + 1):
            if known[k]:
                held.append(abs(now[k]) & 1)
            elif now[k]:
                b.put(*code(zeros << 4 | 1))
                b.put(int(now[k] > 0), 1)
                for h in held:
                    b.put(h, 1)
                zeros, held = 0, []
            else:
                if zeros == 15:
                    b.put(*code(0xF0))
                    for h in held:
                        b.put(h, 1)
                    zeros, held = 0, []
                else:
                    zeros += 1
        if last < se:
            b.put(*code(0))
            for k in range(last + 1 if last >= 0 else ss, se + 1):
                if known[k]:
                    b.put(abs(now[k]) & 1, 1)
    return b.bytes()


@pytest.mark.parametrize("seed,restart", [(0, 0), (1, 0), (2, 3)])
def test_general_scans(seed, restart):
    g = np.random.default_rng(seed)
    high, wide = 20, 29  # 3 x 4 blocks
    x = np.where(g.random((12, 64)) < 0.2, g.integers(-60, 60, (12, 64)), 0)
    x[:, 0] = g.integers(-400, 400, 12)
    x[5, 1:] = 0
    q = g.integers(1, 9, 64)
    out = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes(q.tolist())) + jpeg._segment(0xC2, struct.pack(">BHHB", 8, high, wide, 1) + bytes([1, 0x11, 0]))
    out += table(0, 0) + table(1, 0)
    if restart:
        out += jpeg._segment(0xDD, struct.pack(">H", restart))
    out += jpeg._scan_head([1], 0, 0, 0, 1) + dc_scan(x, 1, restart) + jpeg._segment(0xDD, b"\0\0")
    out += jpeg._scan_head([1], 1, 5, 0, 2) + ac_first(x, 1, 5, 2) + jpeg._scan_head([1], 6, 63, 0, 2) + ac_first(x, 6, 63, 2)
    for al in (1, 0):
        out += jpeg._scan_head([1], 1, 63, al + 1, al) + ac_refine(x, 1, 63, al)
    b = Bits()
    for row in x:
        b.put(int(row[0]) & 1, 1)
    out += jpeg._scan_head([1], 0, 0, 1, 0) + b.bytes() + b"\xff\xd9"
    image = jpeg.decode(out)
    assert np.array_equal(image.components[0].blocks.reshape(12, 64), x)
    tensor = jpeg.rgb(image)
    assert tensor.shape == (high, wide, 3)
    # the inverse transform by its definition
    f = np.zeros((8, 8))
    f.reshape(64)[jpeg.ZIGZAG] = x[0] * q
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    for i, j in ((0, 0), (3, 5), (7, 7)):
        s = sum(c(u) * c(v) * f[v, u] * np.cos((2 * j + 1) * u * np.pi / 16) * np.cos((2 * i + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
        assert abs(int(tensor[i, j, 0]) - np.clip(s + 128, 0, 255)) <= 0.51


def test_broken_files():
    good = jpeg.encode_payload(np.arange(576).astype(np.uint8))
    for bad in (b"", good[:300], good[:-700], b"\x89PNG" + good):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_chroma_is_upsampled():
    image = jpeg.decode(jpeg.encode_payload((np.arange(2304) * 7 % 251).astype(np.uint8)))
    y, cb, _ = jpeg.planes(image)
    assert y.shape == (cb.shape[0] * 2, cb.shape[1] * 2) and jpeg.rgb(image).shape == (*y.shape, 3)
