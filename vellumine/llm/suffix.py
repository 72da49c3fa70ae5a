"""Suffix arrays by induced sorting, permuted common prefixes, and a wavelet FM-index, in numpy.

Induced sorting is vectorised in waves: a wave is the longest stretch of the array from which nothing is
induced into the stretch itself, so its entries can be placed together, in order.
"""

from __future__ import annotations

import numpy as np

from .common import U, mix, range_hashes, runs


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type: smaller than the suffix after it. The last symbol is the unique smallest."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    s = np.ones(n, bool)
    if n > 1:
        at = change[np.searchsorted(change, np.arange(n - 1))]
        s[:-1] = t[at] < t[at + 1]
    return s


def _scan(sa: np.ndarray, t: np.ndarray, want: np.ndarray, free: np.ndarray, right: bool) -> None:
    """Induce from left to right into bucket heads, or from right to left into bucket tails."""
    n, done, m = len(sa), 0, 256
    while done < n:
        upto = min(done + m, n)
        part = sa[n - upto : n - done][::-1] if right else sa[done:upto]
        idx = (part > 0).nonzero()[0]
        p = part[idx] - 1
        ok = want[p]
        idx, p = idx[ok], p[ok]
        if len(p):
            c = t[p]
            nearest = int((n - free[c]).min() if right else free[c].min())  # first place to be filled, from this end
            if nearest < upto:
                upto = max(nearest, done + 1)
                ok = idx < upto - done
                p, c = p[ok], c[ok]
                m = max(64, 2 * (upto - done))
            else:
                m = min(2 * m, 1 << 16)
            if len(p):
                order = np.argsort(c, kind="stable")
                c, p = c[order], p[order]
                fresh = np.empty(len(c) + 1, bool)
                fresh[0] = fresh[-1] = True
                np.not_equal(c[1:], c[:-1], out=fresh[1:-1])
                cut = fresh.nonzero()[0]
                counts = cut[1:] - cut[:-1]
                cut = cut[:-1]
                rank = np.arange(len(c)) - cut.repeat(counts)
                if right:
                    sa[free[c] - 1 - rank] = p
                    free[c[cut]] -= counts
                else:
                    sa[free[c] + rank] = p
                    free[c[cut]] += counts
        else:
            m = min(2 * m, 1 << 16)
        done = upto


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-S suffixes in the given order."""
    tails = np.cumsum(sizes)
    sa = np.full(len(t), -1, np.int64)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    c, lms = c[order], lms[order]
    counts = np.bincount(c, minlength=len(sizes))
    cut = np.cumsum(counts) - counts
    sa[tails[c] - counts[c] + np.arange(len(c)) - cut[c]] = lms
    _scan(sa, t, ~s, tails - sizes, False)
    clear = sa >= 0
    clear[clear] = s[sa[clear]]
    clear[0] = False  # the last symbol
    sa[clear] = -1
    _scan(sa, t, s, tails.copy(), True)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers >= 0 whose last one, 0, occurs once."""
    t = np.asarray(t, np.int64)
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    s = _types(t)
    sizes = np.bincount(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, s, lms, sizes)
    found = sa[is_lms[sa]]
    # names: leftmost-S substrings, each up to the next one's first symbol
    end = np.append(lms[1:] + 1, n)
    stop = np.zeros(n, np.int64)
    stop[lms] = end
    h = range_hashes(mix(t.astype(U) + U(0x5851F42D4C957F2D)), found, stop[found])
    same = np.r_[False, (h[1:] == h[:-1]) & (stop[found][1:] - found[1:] == stop[found][:-1] - found[:-1])]
    name = np.zeros(n, np.int64)
    name[found] = np.cumsum(~same) - 1
    if same.any():
        lms = lms[suffix_array(name[lms])]
    else:
        lms = found
    return _induce(t, s, lms, sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """plcp[i]: common prefix, at most cap, of suffix i and the one before it in the array (text order)."""
    n = len(t)
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate((t, np.arange(-cap - 8, 0)))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before < n)
    # eight symbols at a time while all agree, then one at a time where a block differed

    hashes = range_hashes(mix(pad.astype(np.int64).view(U)), np.arange(n), np.arange(n) + 8) if n else np.zeros(0, U)
    depth = 0
    while len(live) and depth + 8 <= cap:
        a, b = live + depth, before[live] + depth
        inside = np.maximum(a, b) < n
        same = np.zeros(len(live), bool)
        same[inside] = hashes[a[inside]] == hashes[b[inside]]
        _finish(pad, out, live[~same], before, depth, 8)
        live = live[same]
        depth += 8
    _finish(pad, out, live, before, depth, cap - depth)
    return out


def _finish(pad, out, at, before, depth, most) -> None:
    out[at] = depth
    for k in range(depth, depth + most):
        at = at[pad[at + k] == pad[np.minimum(before[at] + k, len(pad) - 1)]]
        if not len(at):
            return
        out[at] = k + 1


class WaveletIndex:
    """FM-index of integers ending in a unique 0: a wavelet matrix of packed bits with ranks by word."""

    def __init__(self, t: np.ndarray, sa: np.ndarray | None = None):
        t = np.asarray(t, np.int64)
        sa = suffix_array(t) if sa is None else sa
        cur = t[sa - 1]
        counts = np.bincount(t)
        self.n = len(t)
        self.below = np.cumsum(counts) - counts
        self.bits = max(1, int(len(counts) - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        first = np.zeros(len(counts), np.int64)
        symbols = np.arange(len(counts))
        for level in range(self.bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view("<u8").astype(U)
            self.words.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)))).astype(np.int64))
            self.zeros.append(int((~bit).sum()))
            cur = np.concatenate((cur[~bit], cur[bit]))
            first = self._down(len(self.words) - 1, first, ((symbols >> level) & 1).astype(bool))
        self.first = first  # where each symbol's run begins after the last level

    def _down(self, level: int, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        word = i >> 6
        ones = self.ranks[level][word] + np.bitwise_count(self.words[level][word] & ((U(1) << (i & 63).astype(U)) - U(1)))
        return np.where(bit, self.zeros[level] + ones, i - ones)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals: those of the patterns with c in front."""
        for k in range(self.bits):
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            lo, hi = self._down(k, lo, bit), self._down(k, hi, bit)
        base = self.below[c] - self.first[c]
        return lo + base, hi + base

    def count(self, text: np.ndarray, starts: np.ndarray, length: int, least: int = 2) -> np.ndarray:
        """Occurrences of text[s : s + length] for each start; less than `least` is given as 0.

        This is the matching statistic of each end position, followed up to `length` and given up as
        soon as its interval is smaller than `least`.
        """
        out = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        for k in range(length - 1, -1, -1):
            lo, hi = self.extend(text[starts[live] + k], lo, hi)
            ok = hi - lo >= least
            live, lo, hi = live[ok], lo[ok], hi[ok]
            if not len(live):
                return out
        out[live] = hi - lo
        return out


def joined(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (symbols from 2 on) with separators 1 between and 0 at the end; (text, segment starts)."""
    at = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(int(lengths.sum()) + len(lengths) + 1, np.int64)
    text[np.repeat(at, lengths) + runs(lengths)] = values
    text[-1] = 0
    return text, at


__all__ = ["WaveletIndex", "joined", "permuted_lcp", "suffix_array"]
