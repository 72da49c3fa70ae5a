"""Operators 2 and 7: removal of repeated windows, by suffix arrays of bytes and by an FM-index of words.

A window is `length` consecutive symbols (bytes, or words as 64-bit hashes) of one text.

1. Texts are written once, as compressed groups, into files of the shared folder; later steps read
   them there, so texts are never shuffled.
2. Each window has an anchor, its least-hashed run of `gram` symbols (a minimizer), which depends on the
   window alone; consecutive windows with one anchor form a segment. Hashes of anchors, distinct by
   group, are dealt out in packed arrays; those that occur twice or more come back to their groups.
   So windows that occur once, nearly all of them, never move.
3. Segments of repeated anchors are dealt to shards by anchor, each content once a group with the
   smallest doc_id, or the number of times, it has there. Anchors that occur `hot` times or more may
   stand at the edge of a passage that half the corpus shares, each time with other text beside it:
   they are dealt window by window instead, by the window's own hash, so no shard gets them all.
4. A shard decides windows exactly. Contents that stand alone at their anchor need no search. The others
   go into an index of at most `CHUNK` symbols or one anchor: for bytes a suffix array by induced
   sorting with permuted common prefixes, whose stretches of `length` and more are the classes of equal
   windows; for words an FM-index on a wavelet matrix, whose intervals count each window.
5. Decisions, a bit a window, return to their groups, where windows are spread to symbols and removed.

Null text: empty. Null doc_id: after all others, so it never removes from them; null doc_ids count as one
document. Rows with one doc_id: as one document, which for bytes removes nothing from itself. Long texts
are whole. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, column_bytes, column_ids, id_text, materialize, mix, new_folder, pack, range_hashes, ready, runs, shuffle_parts, steps, unpack, words_of
from .suffix import WaveletIndex, joined, permuted_lcp, suffix_array

GROUP_BYTES = 6 << 20
#: Bytes of text for each part that anchors and segments are dealt to, so no part grows with the corpus.
PART_BYTES = 32 << 20
CHUNK = 1 << 21
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    words: bool
    length: int
    gram: int
    hot: int = 2000

    @property
    def span(self) -> int:
        """Windows that can share an anchor."""
        return self.length - self.gram + 1

    def symbols(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets of texts in symbols)."""
        if not self.words:
            return body, offsets
        starts, ends, first = words_of(body, offsets)
        return range_hashes(body, starts, ends), first

    def segments(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, anchor as 48 bits) of each segment of one step."""
        n, w = len(values), self.span
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none.view(U)
        at = np.arange(n - self.gram + 1)
        grams = range_hashes(values, at, at + self.gram)
        low = U(max(20, int(n).bit_length()))
        key = (grams >> low << low) | at.astype(U)
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        m = n - self.length + 1
        anchor = (np.minimum(key[:m], key[w - span : w - span + m]) & ((U(1) << low) - U(1))).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - self.length + 1, 0)
        valid = np.repeat(offsets[:-1], sizes) + runs(sizes)
        if not len(valid):
            return none, none, none.view(U)
        own = anchor[valid]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return valid[cut], np.diff(np.r_[cut, len(own)]), mix(grams[own[cut]]) >> U(16)


BYTES = Windows(False, 50, 24)
WORDS = Windows(True, 35, 8)


# --------------------------------------------------------------------------- groups of texts


def grouped(docs: DataFrame) -> DataFrame:
    """(gid, path, at, size, length, head): groups of about GROUP_BYTES of text, compressed, in files of the
    shared folder, one a task. Only this list of them, with ids and sizes, is ever shuffled. An attempt
    writes a file of its own; the list is written out, so it names the files of one attempt for good."""
    folder = new_folder(docs.sparkSession, "texts")

    def run(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        part, k, at, out = TaskContext.get().partitionId(), 0, 0, None
        path = f"{root}/part-{part:07d}-{uuid.uuid4().hex}.texts"
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body, offsets = column_bytes(batch.column("text"))
            ids, valid = column_ids(batch.column("doc_id"))
            rows = []
            for i, j in steps(offsets, GROUP_BYTES):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                text = squeeze.compress(body[offsets[i] : offsets[j]].tobytes())
                out.write(text)
                rows.append(((part << 33) + k, path, at, len(text), int(offsets[j] - offsets[i]), pack(ids[i:j], valid[i:j], np.diff(offsets[i : j + 1]))))
                at, k = at + len(text), k + 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["gid", "path", "at", "size", "length", "head"])
        if out is not None:
            out.close()

    return materialize(id_text(docs).mapInArrow(run, "gid long, path string, at long, size long, length long, head binary"), "groups").withColumn("root", F.lit(folder))


def parts_for(listed: DataFrame) -> int:
    """Parts to deal to: twice the shuffle partitions, or as many as keep PART_BYTES of text to each."""
    total = listed.agg(F.sum("length")).first()[0] or 0
    return max(2 * shuffle_parts(listed.sparkSession), -(-total // PART_BYTES))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, valid, bytes, offsets) of a group."""
    import zstandard
    from pyarrow import fs

    ids, valid, sizes = unpack(row["head"], np.int64, bool, np.int64)
    raw, total = b"", int(sizes.sum())
    if total:
        store, _ = fs.FileSystem.from_uri(row["root"])
        with store.open_input_file(row["path"]) as f:
            raw = zstandard.ZstdDecompressor().decompress(f.read_at(row["size"], row["at"]), max_output_size=total)
    return ids, valid, np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum(sizes)]


def rows_of(batches):
    """Rows as dicts, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def all_segments(how: Windows, body: np.ndarray, offsets: np.ndarray):
    """For each step of a group: (symbols, first symbol in the group, offsets, first text, segments)."""
    base = 0
    for i, j in steps(offsets):
        values, off = how.symbols(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield values, base, off, i, how.segments(values, off)
        base += len(values)


def six(x: np.ndarray) -> np.ndarray:
    """48-bit numbers in six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy().reshape(-1)


def from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U)


def by_part(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) for each part that has keys."""
    p = (keys % U(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.r_[True, p[order][1:] != p[order][:-1]]) if len(p) else np.zeros(0, np.int64)
    return [(int(p[order[a]]), order[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(p)])]


BLOBS = "part int, gid long, blob binary"


def blob_batch(parts: list[int], gid: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([gid] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "gid", "blob"])


def repeated_anchors(groups: DataFrame, how: Windows, parts: int) -> DataFrame:
    """(gid, blobs): packed (anchors that occur twice or more, hot flags) of each group."""

    def count(batches):
        for row in rows_of(batches):
            _, _, body, offsets = opened(row)
            keys, counts = np.unique(np.concatenate([np.zeros(0, U), *[s[2] for *_, s in all_segments(how, body, offsets)]]), return_counts=True)
            out, blobs = [], []
            for p, at in by_part(keys, parts):
                many = at[counts[at] > 1]
                out.append(p)
                blobs.append(pack(six(keys[at[counts[at] == 1]]), six(keys[many]), counts[many].astype(np.uint32)))
            yield blob_batch(out, row["gid"], blobs)

    def meet(table: pa.Table) -> pa.Table:
        gids = table.column("gid").to_numpy()
        keys, counts, sizes = [], [], []
        for blob in table.column("blob").to_pylist():
            one, many, n = unpack(blob, np.uint8, np.uint8, np.uint32)
            keys += [from_six(one), from_six(many)]
            counts += [np.ones(len(one) // 6, np.int64), n.astype(np.int64)]
            sizes.append(len(one) // 6 + len(many) // 6)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], cut), np.diff(np.r_[cut, len(keys)]))
        ends, out = np.cumsum(sizes), []
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            own = np.flatnonzero(total[a:b] >= 2) + a
            out.append(pack(six(keys[own]), total[own] >= how.hot) if len(own) else None)
        kept = [k for k, x in enumerate(out) if x]
        return pa.table({"gid": pa.array(gids[kept], pa.int64()), "blob": pa.array([out[k] for k in kept], pa.binary())})

    dealt = groups.mapInArrow(count, BLOBS).repartition(parts, "part")
    return dealt.groupBy("part").applyInArrow(meet, "gid long, blob binary").groupBy("gid").agg(F.collect_list("blob").alias("blobs"))


# --------------------------------------------------------------------------- shards


def contents(values, offsets, text_of_step, ids, how, segs, places):
    """Weights of segments: doc_id (bytes) or 1 (words)."""
    if how.words:
        return np.ones(len(places), np.int64)
    doc = np.searchsorted(offsets, segs[0][places], "right") - 1 + text_of_step
    return ids[doc]


def distinct(keys: np.ndarray, weights: np.ndarray, how: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, joint weight) of each distinct key, and each place's key as an index."""
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    if how.words:
        joint = np.bincount(inverse, weights=weights, minlength=len(unique)).astype(np.int64)
    else:
        joint = np.full(len(unique), LAST)
        np.minimum.at(joint, inverse, weights)
        order = np.lexsort((np.arange(len(keys)), weights, inverse))  # the smallest document stands for all
        cut = np.flatnonzero(np.r_[True, inverse[order][1:] != inverse[order][:-1]]) if len(order) else order
        first = order[cut]
    return first, joint, inverse


def sent_ids(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.where(valid, ids, LAST)


def deal_segments(groups: DataFrame, anchors: DataFrame, how: Windows, parts: int) -> DataFrame:
    """BLOBS for shards: packed (place | hot bit, anchor, windows, weight, symbols) of distinct contents."""

    def run(batches):
        for row in rows_of(batches):
            ids, valid, body, offsets = opened(row)
            gid, blobs = row["gid"], row["blobs"]
            docs = sent_ids(ids, valid)
            keys, hot = [], []
            for b in blobs:
                k, h = unpack(b, np.uint8, bool)
                keys.append(from_six(k))
                hot.append(h)
            keys, hot = np.concatenate(keys), np.concatenate(hot)
            order = np.argsort(keys)
            keys, hot = keys[order], hot[order]
            parts_of: list[list[np.ndarray]] = [[] for _ in range(7)]  # content, place, anchor, windows, weight, hot, symbols
            for values, base, off, text, segs in all_segments(how, body, offsets):
                at = np.minimum(np.searchsorted(keys, segs[2]), len(keys) - 1)
                met = keys[at] == segs[2]
                cold = np.flatnonzero(met & ~hot[at])
                many = np.flatnonzero(met & hot[at])
                # hot: each window on its own
                sizes = segs[1][many]
                own = np.repeat(many, sizes)
                start = np.concatenate((segs[0][cold], segs[0][own] + runs(sizes)))
                n_win = np.concatenate((segs[1][cold], np.ones(len(own), np.int64)))
                is_hot = np.r_[np.zeros(len(cold), bool), np.ones(len(own), bool)]
                end = start + n_win - 1 + how.length
                content = range_hashes(values, start, end) ^ is_hot.astype(U)
                weight = contents(values, off, text, docs, how, segs, np.concatenate((cold, own)))
                first, joint, _ = distinct(content, weight, how)
                start, end = start[first], end[first]
                sizes = end - start
                anchor = np.where(is_hot[first], content[first] >> U(16), segs[2][np.concatenate((cold, own))[first]])
                symbols = values[np.repeat(start, sizes) + runs(sizes)]
                for k, x in enumerate((content[first], start + base, anchor, n_win[first], joint, is_hot[first], symbols)):
                    parts_of[k].append(x)
            content, place, anchor, n_win, weight, is_hot, symbols = map(np.concatenate, parts_of)
            first, joint, _ = distinct(content, weight, how)
            sizes = n_win + how.length - 1
            begin = np.cumsum(sizes) - sizes
            out, packed = [], []
            for p, at in by_part(anchor[first], parts):
                f = first[at]
                s = sizes[f]
                body_of = symbols[np.repeat(begin[f], s) + runs(s)]
                packed.append(pack((place[f] << 1 | is_hot[f]).astype(np.int64), six(anchor[f]), n_win[f].astype(np.uint8), joint[at], body_of))
                out.append(p)
            yield blob_batch(out, gid, packed)

    return groups.join(anchors, "gid").mapInArrow(run, BLOBS)


def decide(how: Windows, values: np.ndarray, n_win: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each window of each of some distinct segments: smallest doc_id, or number of occurrences."""
    lengths = n_win + how.length - 1
    seg = np.repeat(np.arange(len(n_win)), n_win)
    if how.words:
        _, codes = np.unique(values, return_inverse=True)
        text, at = joined(codes + 2, lengths)
        start = np.repeat(at, n_win) + runs(n_win)
        found = WaveletIndex(text).count(text, start, how.length)
        return np.maximum(found, weight[seg])
    text, at = joined(values.astype(np.int64) + 2, lengths)
    sa = suffix_array(text)
    plcp = permuted_lcp(text, sa, how.length)
    best = np.full(len(text), LAST)
    start = np.repeat(at, n_win) + runs(n_win)
    best[start] = weight[seg]
    in_order = best[sa]
    cut = np.flatnonzero(plcp[sa] < how.length)  # a class of equal windows begins
    lows = np.minimum.reduceat(in_order, cut)
    least = np.empty(len(text), np.int64)
    least[sa] = np.repeat(lows, np.diff(np.r_[cut, len(sa)]))
    return least[start]


def shard(table: pa.Table, how: Windows) -> pa.Table:
    """Packed (place | hot bit, bits of removed windows) for each group that sent something to a shard."""
    gids = table.column("gid").to_numpy()
    got = [unpack(b, np.int64, np.uint8, np.uint8, np.int64, U if how.words else np.uint8) for b in table.column("blob").to_pylist()]
    counts = np.array([len(g[0]) for g in got])
    place = np.concatenate([g[0] for g in got])
    anchor = from_six(np.concatenate([g[1] for g in got]))
    n_win = np.concatenate([g[2] for g in got]).astype(np.int64)
    weight = np.concatenate([g[3] for g in got])
    values = np.concatenate([g[4] for g in got])
    sizes = n_win + how.length - 1
    begin = np.cumsum(sizes) - sizes
    content = np.empty(len(sizes), U)
    for i, j in steps(np.append(begin, len(values))):  # by parts, for memory
        at = begin[i:j] - begin[i]
        content[i:j] = range_hashes(values[begin[i] : begin[j - 1] + sizes[j - 1]], at, at + sizes[i:j])
    content ^= anchor * U(0x9E3779B97F4A7C15)
    first, joint, inverse = distinct(content, weight, how)
    # contents by anchor: those alone at theirs are decided already
    order = np.argsort(anchor[first], kind="stable")
    a = anchor[first][order]
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    per = np.diff(np.r_[cut, len(a)])
    windows = n_win[first]
    mask_at = np.cumsum(windows) - windows
    result = np.repeat(joint, windows)
    todo = order[np.repeat(per, per) > 1]
    if len(todo):
        group = anchor[first][todo]
        upto = np.cumsum(sizes[first][todo])
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
            if hi < len(todo):  # an anchor is never cut
                back = int(np.searchsorted(group[:hi], group[hi - 1])) if group[hi] == group[hi - 1] else hi
                hi = back if back > lo else int(np.searchsorted(group, group[lo], "right"))
            k = todo[lo:hi]
            f = first[k]
            own = values[np.repeat(begin[f], sizes[f]) + runs(sizes[f])]
            result[np.repeat(mask_at[k], windows[k]) + runs(windows[k])] = decide(how, own, windows[k], joint[k])
            lo = hi
    # back to what each group sent
    at = np.repeat(mask_at[inverse], n_win) + runs(n_win)
    gone = result[at] >= 2 if how.words else result[at] < np.repeat(weight, n_win)
    bit = gone.astype(U) << runs(n_win).astype(U)
    masks = np.bitwise_or.reduceat(bit, np.cumsum(n_win) - n_win)
    ends, out, kept = np.cumsum(counts), [], []
    for k, (x, y) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        own = np.flatnonzero((masks[x:y] != 0) | (place[x:y] & 1 == 1)) + x
        if len(own):
            kept.append(k)
            out.append(pack(place[own], masks[own]))
    return pa.table({"gid": pa.array(gids[kept], pa.int64()), "blob": pa.array(out, pa.binary())})


def window_flags(how: Windows, body, offsets, docs, blobs) -> tuple[list, np.ndarray, np.ndarray]:
    """(steps, symbols' offsets, removed windows by symbol) of a whole group."""
    pieces = list(all_segments(how, body, offsets))
    n = sum(len(p[0]) for p in pieces)
    gone = np.zeros(n, bool)
    if not n:
        return pieces, np.zeros(len(offsets), np.int64), gone
    start = np.concatenate([p[4][0] + p[1] for p in pieces])
    n_win = np.concatenate([p[4][1] for p in pieces])
    anchor = np.concatenate([p[4][2] for p in pieces])
    first_of = np.concatenate([p[2][:-1] + p[1] for p in pieces] + [np.array([n])])
    if not len(start):
        return pieces, first_of, gone
    place, masks = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for b in blobs or []:
        x, m = unpack(b, np.int64, U)
        place.append(x)
        masks.append(m)
    place, masks = np.concatenate(place), np.concatenate(masks)
    hot = place & 1 == 1
    at, bits = place >> 1, masks
    # contents: what each segment shares its decision with
    hashes = np.concatenate([range_hashes(p[0], p[4][0], p[4][0] + p[4][1] - 1 + how.length) for p in pieces])
    _, inverse = np.unique(hashes, return_inverse=True)
    by_content = np.zeros(int(inverse.max()) + 1, U)
    seg = np.searchsorted(start, at[~hot])
    by_content[inverse[seg]] = bits[~hot]
    mask = by_content[inverse]
    weight = np.ones(len(start), np.int64) if how.words else docs[np.searchsorted(first_of, start, "right") - 1]
    if not how.words:  # the same content in a smaller document of this very group
        low = np.full(len(by_content), LAST)
        np.minimum.at(low, inverse, weight)
        mask = np.where(weight > low[inverse], ~U(0), mask)
    some = np.flatnonzero(mask)
    for k in range(0, len(some), 1 << 15):  # by parts, for memory
        part = some[k : k + (1 << 15)]
        sizes, place_of = n_win[part], runs(n_win[part])
        gone[np.repeat(start[part], sizes) + place_of] = (np.repeat(mask[part], sizes) >> place_of.astype(U)) & U(1) == 1
    if hot.any():
        seg_of = np.searchsorted(start, at[hot], "right") - 1
        hot_anchor = np.isin(anchor, np.unique(anchor[seg_of]))
        seg = np.flatnonzero(hot_anchor)
        w = np.repeat(start[seg], n_win[seg]) + runs(n_win[seg])
        own_weight = np.repeat(weight[seg], n_win[seg])
        bounds = np.cumsum([0, *[len(p[0]) for p in pieces]])
        h = np.empty(len(w), U)
        for k, p in enumerate(pieces):
            inside = (w >= bounds[k]) & (w < bounds[k + 1])
            h[inside] = range_hashes(p[0], w[inside] - bounds[k], w[inside] - bounds[k] + how.length)
        _, inv = np.unique(h, return_inverse=True)
        verdict = np.zeros(int(inv.max()) + 1, bool)
        sent = np.flatnonzero(np.isin(w, at[hot]))
        which = dict(zip(at[hot].tolist(), (bits[hot] & U(1) == 1).tolist(), strict=True))
        for k in sent[[which[x] for x in w[sent].tolist()]] if len(sent) else []:
            verdict[inv[k]] = True
        lost = verdict[inv]
        if not how.words:
            low = np.full(len(verdict), LAST)
            np.minimum.at(low, inv, own_weight)
            lost |= own_weight > low[inv]
        gone[w] |= lost
    return pieces, first_of, gone


def covered(gone: np.ndarray, length: int) -> np.ndarray:
    """Symbols that a flagged window covers."""
    step = np.zeros(len(gone) + length + 1, np.int32)
    at = np.flatnonzero(gone)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step)[: len(gone)] > 0


def removal(docs: DataFrame, how: Windows, finish, schema: str) -> DataFrame:
    """finish(ids, valid, body, offsets, removed flags by symbol, symbols' offsets) -> columns of schema."""
    spark = docs.sparkSession
    ready(spark)
    listed = grouped(docs)
    parts = parts_for(listed)
    # a list of a few rows a task: dealt out again, since reading it back would put it into few tasks
    groups = listed.repartition(parts, "gid")
    anchors = repeated_anchors(groups, how, parts)
    dealt = deal_segments(groups, anchors, how, parts).repartition(parts, "part")
    decided = dealt.groupBy("part").applyInArrow(lambda t: shard(t, how), "gid long, blob binary").groupBy("gid").agg(F.collect_list("blob").alias("blobs"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for row in rows_of(batches):
            ids, valid, body, offsets = opened(row)
            _, first, gone = window_flags(how, body, offsets, sent_ids(ids, valid), row["blobs"])
            cols = finish(body, offsets, covered(gone, how.length), first)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), *[pa.array(c) for c in cols]], names=names)

    return groups.join(decided, "gid", "left").mapInArrow(run, schema)


def finish_bytes(body, offsets, lost, first):
    n_bytes, n_removed, n_spans, hashes, texts = [], [], [], [], []
    begins = lost.copy()
    begins[1:] &= ~lost[:-1]
    begins[offsets[:-1][offsets[:-1] < len(lost)]] = lost[offsets[:-1][offsets[:-1] < len(lost)]]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n_bytes.append(b - a)
        gone = int(lost[a:b].sum())
        n_removed.append(gone)
        n_spans.append(int(begins[a:b].sum()))
        kept = (body[a:b][~lost[a:b]] if gone else body[a:b]).tobytes()
        hashes.append(hashlib.sha256(kept).hexdigest())
    return [np.array(n_bytes, np.int64), np.array(n_removed, np.int64), np.array(n_spans, np.int64), pa.array(hashes, pa.string())]


def finish_words(body, offsets, lost, first):
    n_words, n_removed, hashes = [], [], []
    for i, j in steps(offsets):
        part = body[offsets[i] : offsets[j]]
        starts, ends, own = words_of(part, offsets[i : j + 1] - offsets[i])
        sizes = ends - starts
        for k in range(j - i):
            a, b = int(own[k]), int(own[k + 1])
            gone = lost[first[i] + a : first[i] + b]
            keep = np.flatnonzero(~gone) + a
            n_words.append(b - a)
            n_removed.append(b - a - len(keep))
            s = sizes[keep]
            text = np.full(int(s.sum()) + max(0, len(s) - 1), 32, np.uint8)
            at = np.cumsum(s + 1) - s - 1
            text[np.repeat(at, s) + runs(s)] = part[np.repeat(starts[keep], s) + runs(s)]
            hashes.append(hashlib.sha256(text.tobytes()).hexdigest())
    return [np.array(n_words, np.int64), np.array(n_removed, np.int64), pa.array(hashes, pa.string())]


def suffix_dedup(docs: DataFrame, how: Windows = BYTES) -> DataFrame:
    """Operator 2: bytes that a window covers which also starts in a document with a smaller doc_id."""
    return removal(docs, how, finish_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def substring_dedup(docs: DataFrame, how: Windows = WORDS) -> DataFrame:
    """Operator 7: words that a window covers which also starts anywhere else."""
    return removal(docs, how, finish_words, "doc_id long, n_words long, n_removed long, kept_sha256 string")
