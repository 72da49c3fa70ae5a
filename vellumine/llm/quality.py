"""Operator 9, quality rules: divergence of a document's distributions from those of its language.

Base features (whole texts): word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines
(lines with a word, equal to an earlier line), n_repeat_words (words in 3-word windows found twice or
more in the text).  Method: two histograms of a document, of character classes and of the language's
most common words (hashed, the rest in one bin), are compared with the language's own by Jensen-Shannon
distance (the root of the divergence in bits).  The references are counted over all documents.  Documents with fewer than
`least_words` words are not compared, nor is a language with fewer than `least_reference` words.

Null text: no words, so the base fails.  Null lang: a language of its own.  Languages beyond the
`max_languages` with most words are compared with the whole corpus (the table of references is the only
thing that reaches the driver).  Repeated rows: each returned.  Empty table: empty result.  Empty texts
have no words and fail; very long ones are counted whole by one task, in memory of some 60 times their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U, materialize, mix, range_hashes, ready, step_texts, words_of

CLASSES = 8  # lower, upper, digit, space, punctuation, symbol, Latin letter with mark, other
SLOTS = 1 << 13
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
_kind = np.full(256, 7, np.int8)
for _k, _chars in ((0, bytes(range(97, 123))), (1, bytes(range(65, 91))), (2, bytes(range(48, 58))), (3, b" \t\n\v\f\r"), (4, b".,;:!?'\"()-"), (5, bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,;:!?'\"()-"))), (6, bytes(range(0xC2, 0xCA)))):
    _kind[list(_chars)] = _k
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def codes_of(langs: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """(distinct languages, null among them as itself, the place of each row's language in them)."""
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    coded = langs.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the bytes of each text are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def base_features(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = words_of(body, offsets)
    n = len(offsets) - 1
    n_words = np.diff(first)
    got = {"n_words": n_words, "word_chars": per_text(~SPACE[body] & LEAD[body], offsets), "n_symbols": per_text(SYMBOLS[body], offsets)}
    # lines: each text's start, and what follows each line feed
    feeds = np.flatnonzero(body == 10)
    line_at = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    line_of = np.searchsorted(offsets[:-1], np.sort(np.concatenate((offsets[:-1], feeds)), kind="stable"), "right") - 1
    if len(line_at):
        stop = np.append(line_at[1:], len(body))
        # a line ends before its line feed, which is the byte before the next line unless a text ends there
        fed = np.zeros(len(body) + 1, bool)
        fed[feeds + 1] = True
        line_end = np.where((stop > line_at) & fed[stop] & (stop <= offsets[line_of + 1]), stop - 1, np.minimum(stop, offsets[line_of + 1]))
        line_end = np.maximum(line_end, line_at)
        worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_at)
        a, b, of = line_at[worded], line_end[worded], line_of[worded]
        h = mix(range_hashes(body, a, b) + of.astype(U) * U(0x9E3779B97F4A7C15))
        fresh = np.unique(h, return_index=True)[1]
        got["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[fresh], minlength=n)
    else:
        got["n_dup_lines"] = np.zeros(n, np.int64)
    hashes = range_hashes(body, starts, ends)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= 3:
        of = np.repeat(np.arange(n), n_words)
        inside = of[:-2] == of[2:]
        h = mix(mix(hashes[:-2] * U(3) + hashes[1:-1] * U(5)) + hashes[2:] * U(7) + of[:-2].astype(U) * U(0x9E3779B97F4A7C15))
        at = np.flatnonzero(inside)
        _, inverse, counts = np.unique(h[at], return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[twice + k] = True
        np.cumsum(covered, out=repeated[1:])
    got["n_repeat_words"] = np.diff(repeated[first])
    return got


def class_histograms(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text by class."""
    n = len(offsets) - 1
    lead = np.flatnonzero(LEAD[body])
    of = np.repeat(np.arange(n), np.diff(offsets))[lead]
    return np.bincount(of * CLASSES + _kind[body[lead]], minlength=n * CLASSES).reshape(n, CLASSES)


def word_slots(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words_of(body, offsets)
    return (range_hashes(LOWER[body], starts, ends) % U(SLOTS)).astype(np.int64), first


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of rows of counts p and rows of shares q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame, common: int, max_languages: int) -> tuple[dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray, int]], tuple | None]:
    """By language, and of the whole corpus: (shares of classes, slots of common words, their shares and the rest's, words)."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            langs, own = codes_of(batch.column("lang"))
            for i, j, body, offsets in step_texts(batch):
                classes = class_histograms(body, offsets)
                slots, first = word_slots(body, offsets)
                present, code = np.unique(own[i:j], return_inverse=True)
                whole = np.bincount(np.repeat(code, np.diff(first)) * SLOTS + slots, minlength=len(present) * SLOTS).reshape(-1, SLOTS)
                for k, name in enumerate(langs[c] for c in present.tolist()):
                    got = np.concatenate((classes[code == k].sum(0), whole[k]))
                    if name not in total and len(total) >= 64:  # hand on what has been counted
                        yield from emit(total)
                        total = {}
                    total[name] = total[name] + got if name in total else got
        yield from emit(total)

    def emit(total):
        for name, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], names=["lang", "slot", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "quality-counts")
    in_words = F.sum(F.when(F.col("slot") >= CLASSES, F.col("n")).otherwise(0))
    named = counts.groupBy("lang").agg(in_words.alias("words")).orderBy(F.desc("words"), F.asc_nulls_first("lang")).limit(max_languages).select(F.col("lang").alias("own"))
    each = counts.join(F.broadcast(named), F.col("lang").eqNullSafe(F.col("own"))).select(F.lit(False).alias("whole"), "lang", "slot", "n")
    corpus = counts.groupBy("slot").agg(F.sum("n").alias("n")).select(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), "slot", "n")
    both = each.unionByName(corpus)
    rank = F.row_number().over(Window.partitionBy("whole", "lang", F.col("slot") < CLASSES).orderBy(F.desc("n"), "slot"))
    both = both.withColumn("words", in_words.over(Window.partitionBy("whole", "lang"))).withColumn("rank", rank)
    # (max_languages + 1) * (common + CLASSES) rows at most
    rows = both.where((F.col("rank") <= common) | (F.col("slot") < CLASSES)).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["whole"], r["lang"]), []).append((r["slot"], r["n"], r["words"]))
    out = {}
    for key, got in by.items():
        classes, slots = np.zeros(CLASSES), []
        for slot, n, _ in got:
            if slot < CLASSES:
                classes[slot] = n
            else:
                slots.append((slot - CLASSES, n))
        words, slots = got[0][2], sorted(slots)
        shares = np.array([n for _, n in slots] + [words - sum(n for _, n in slots)], float)
        out[key] = (classes / max(classes.sum(), 1), np.array([s for s, _ in slots], np.int64), shares / max(words, 1), words)
    whole = out.pop((True, None), None)
    return {lang: ref for (_, lang), ref in out.items()}, whole


def quality(docs: DataFrame, common: int = 64, least_words: int = 80, least_reference: int = 2000, max_classes: float = 0.06**0.5, max_words: float = 0.28**0.5, max_languages: int = 256) -> DataFrame:
    """One row a document: base features, both distances (null where not compared) and the verdict."""
    ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    refs, whole = references(slim, common, max_languages)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = "doc_id long, " + ", ".join(f"{f} long" for f in fields) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"

    def run(batches):
        for batch in batches:
            langs, own = codes_of(batch.column("lang"))
            for i, j, body, offsets in step_texts(batch):
                base = base_features(body, offsets)
                n_words = base["n_words"]
                failed = (n_words < 50) | (100 * base["n_repeat_words"] > 50 * n_words)
                classes = class_histograms(body, offsets)
                slots, first = word_slots(body, offsets)
                one, two = np.full(j - i, np.nan), np.full(j - i, np.nan)
                for code in np.unique(own[i:j]).tolist():
                    ref = refs.get(langs[code], whole)
                    at = np.flatnonzero((own[i:j] == code) & (n_words >= least_words))
                    if ref is None or ref[3] < least_reference or not len(at):
                        continue
                    place = np.full(SLOTS, len(ref[1]), np.int64)
                    place[ref[1]] = np.arange(len(ref[1]))
                    wide = len(ref[1]) + 1
                    rows = np.repeat(np.arange(len(at)), n_words[at])
                    mine = np.concatenate([slots[first[d] : first[d + 1]] for d in at])
                    hist = np.bincount(rows * wide + place[mine], minlength=len(at) * wide).reshape(-1, wide)
                    one[at], two[at] = distance(classes[at], ref[0][None]), distance(hist, ref[2][None])
                far = (one > max_classes) | (two > max_words)  # not compared: nan, never far
                cols = [batch.column("doc_id").slice(i, j - i), *[pa.array(base[f].astype(np.int64)) for f in fields], pa.array(failed), pa.array(~failed & ~far), pa.array(one, mask=np.isnan(one)), pa.array(two, mask=np.isnan(two))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *fields, "base_failed", "kept", "class_distance", "word_distance"])

    return slim.mapInArrow(run, schema)
