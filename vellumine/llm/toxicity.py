"""Operator 5, toxicity: a convolutional text classifier trained in numpy.

Words (A-Z lower-cased, cut at punctuation) and their prefixes of 4, 5 and 6 bytes are hashed into
embeddings, whose sum is the word's: invented or inflected forms share a stem.  Words of few training
documents share one embedding, since they could only be learned by heart.  Filters of widths 1, 2 and 3
run over them, each is max-pooled over the whole text, and a logistic layer gives a logit.  The gradient of everything is written out below (Adam, mini-batches).  Thresholds are calibrated
by language: languages are told apart from the text itself (shares of marked and of plain
letters, against centroids of the training sample found by k-means), and within each the logit
that separates best on the calibration part is moved to a score of 0.7.  No column but the text is used.

Training: at most `sample` labelled rows whose crc32(doc_id as text) mod 3 is not 1, the ones with the
smallest hash of their id, equally many of either label if there are, but for texts over `longest`
characters; every fifth calibrates.  Labels of
repeated ids are averaged (0.5 and more: 1).  Without labels, or with one label only, scores are 0.5 or
that label's share.  Null text: scored as empty.  Null doc_id: scored, not held out.  Repeated rows: each
returned.  Empty table: empty result.  Texts are scored whole, by blocks of words joined by maximum.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, column_bytes, id_text, range_hashes, ready, step_texts, steps, words_of

WIDTHS, FILTERS, DIM, SLOTS, GROUPS = (1, 2, 3), 6, 12, 1 << 16, 4
SAMPLE, LONGEST = 6000, 48_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?\"'()[]{}<>*_#-$%&|/\\~^+=@`")] = True
PREFIXES = (4, 5, 6)  # bytes


def word_slots(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each word and of its prefixes, first word of each text). Slot 0: no such prefix."""
    body = np.where(PUNCTUATION[body], np.uint8(32), LOWER[body])
    starts, ends, first = words_of(body, offsets)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint16)  # SLOTS fit
    out[:, 0] = range_hashes(body, starts, ends) % U(SLOTS - 1) + U(1)
    for k, size in enumerate(PREFIXES):
        long = np.flatnonzero(ends - starts > size)
        salt = U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
        out[long, k + 1] = (range_hashes(body, starts[long], starts[long] + size) ^ salt) % U(SLOTS - 1) + U(1)
    return out, first


class Network:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.emb = (g.standard_normal((SLOTS, DIM)) * 0.02).astype(np.float32)
        self.w = [(g.standard_normal((k, DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (g.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.tables: list[list[np.ndarray]] | None = None
        self.centroids: np.ndarray | None = None
        self.scale: list[tuple[float, float]] = [(0.0, 1.0)]

    def freeze(self) -> None:
        """Products of embeddings and filters, so that a filter is a sum of looked-up rows."""
        self.tables = [[np.ascontiguousarray(self.emb @ w[k]) for k in range(len(w))] for w in self.w]
        self.emb = None

    def pooled(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Max over all places of each filter (0 at least: a rectified filter, or no place at all)."""
        n = len(first) - 1
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        block = 1 << 15
        for lo in range(0, len(slots), block):
            hi = min(lo + block, len(slots))
            for c, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                end = min(hi + w - 1, len(slots))
                m = end - lo - w + 1
                if m <= 0:
                    continue
                act = np.tile(self.b[c], (m, 1))
                for k in range(w):
                    for part in slots[lo + k : lo + k + m].T:
                        act += t[k][part]
                at = np.arange(lo, lo + m)
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + w <= first[doc + 1]
                act, doc = act[inside], doc[inside]
                if len(doc):
                    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    part = slice(c * FILTERS, (c + 1) * FILTERS)
                    out[doc[cut], part] = np.maximum(out[doc[cut], part], np.maximum.reduceat(act, cut, axis=0))
        return out

    def logits(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (self.pooled(slots, first).astype(np.float64) * self.out.astype(np.float64)).sum(1) + float(self.bias[0])

    def group_of(self, features: np.ndarray) -> np.ndarray:
        d = ((features[:, None, :] - self.centroids[None]) ** 2).sum(2)
        return d.argmin(1)

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.centroids is None:
            return np.full(len(offsets) - 1, self.scale[0][0])
        slots, first = word_slots(body, offsets)
        z = self.logits(slots, first)
        group = self.group_of(language_features(body, offsets))
        mid, slope = np.array(self.scale).T
        top = np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip((z - mid[group]) * slope[group] + top, -30, 30)))


def language_features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of marked letters (by byte) and of letters: a text's language without its column."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    low = LOWER[body]
    kind = np.full(256, -1, np.int64)
    kind[97:123] = np.arange(26)
    kind[0x80:0xC0] = 26 + np.arange(64) % 32
    k = kind[low]
    hist = np.bincount(of[k >= 0] * 58 + k[k >= 0], minlength=n * 58).reshape(n, 58).astype(np.float64)
    hist[:, 26:] *= 3
    return hist / np.maximum(hist.sum(1, keepdims=True), 1)


def k_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    centre = x[:1]
    while len(centre) < min(k, len(x)):  # farthest first
        d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
        centre = np.vstack((centre, x[np.argmax(d)]))
    for _ in range(rounds):
        own = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.vstack([x[own == g].mean(0) if (own == g).any() else centre[g] for g in range(len(centre))])
    return centre


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> Network:
    net = Network(seed)
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        net.scale = [(float(labels[0]) if len(labels) else 0.5, 1.0)]
        return net
    docs, body = [], np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    for i, j in steps(offsets):
        slots, first = word_slots(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        docs += [slots[first[k] : first[k + 1]] for k in range(j - i)]  # views of one array a step
    # words of few documents can only be learned by heart: all of them are one word
    seen = np.zeros(SLOTS, np.int64)
    for d in docs:
        seen[np.unique(d)] += 1
    rare = seen < max(4, len(docs) // 1000)
    for d in docs:
        d[rare[d]] = 0
    held = np.arange(len(docs)) % 5 == 4
    fit, calibrate = np.flatnonzero(~held), np.flatnonzero(held)
    names = [net.emb, *net.w, *net.b, net.out, net.bias]
    m1, m2 = [np.zeros_like(p) for p in names], [np.zeros_like(p) for p in names]
    g, t = np.random.default_rng(seed), 0
    for _ in range(epochs):
        g.shuffle(fit)
        for lo in range(0, len(fit), batch):
            some, t = fit[lo : lo + batch], t + 1
            grads = backward(net, [docs[d] for d in some], labels[some])
            for k, (p, (rows, d)) in enumerate(zip(names, grads, strict=True)):
                if rows is None:
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.99 * m2[k] + 0.01 * d * d
                    p -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)
                else:
                    m2[k][rows] += d * d  # of embeddings, AdaGrad on the rows met
                    p[rows] -= 5 * rate * d / (np.sqrt(m2[k][rows]) + 1e-6)
    net.emb[rare] = net.emb[0]
    net.freeze()
    features = np.vstack([language_features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)])
    net.centroids = k_means(features, GROUPS)
    z = np.array([net.logits(d, np.array([0, len(d)]))[0] for d in docs])
    own = net.group_of(features)
    net.scale = []
    for k in range(len(net.centroids)):
        at = calibrate[own[calibrate] == k]
        if labels[at].sum() < 20 or (1 - labels[at]).sum() < 20:
            at = calibrate  # too few of its own
        net.scale.append(threshold(z[at], labels[at]))
    return net


def threshold(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut with the best balance of both error rates, in the middle of its gap; and a slope."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    if len(z) < 2 or y.min() == y.max():
        return 0.0, 1.0
    # clean documents left alone weigh three times as much as toxic ones caught
    good = np.cumsum(1 - y)[:-1] / max(1, (1 - y).sum()) * 3 + (y.sum() - np.cumsum(y)[:-1]) / max(1, y.sum())
    good = np.where(z[1:] > z[:-1], good, -1)
    k = int(np.argmax(good))
    return float((z[k] + z[k + 1]) / 2), 1.0


def backward(net: Network, docs: list[np.ndarray], y: np.ndarray):
    """Gradients of the mean logistic loss: (None, dense) or (rows, their gradients) by parameter."""
    sizes = np.array([len(d) for d in docs])
    first = np.r_[0, np.cumsum(sizes)]
    slots = np.concatenate(docs)
    x = sum(net.emb[part] for part in slots.T)
    n = len(docs)
    pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    argmax = np.full((n, FILTERS * len(WIDTHS)), -1, np.int64)
    for c, w in enumerate(WIDTHS):
        m = len(slots) - w + 1
        if m <= 0:
            continue
        act = x[:m] @ net.w[c][0] + net.b[c]
        for k in range(1, w):
            act += x[k : k + m] @ net.w[c][k]
        for d in range(n):
            a, b = first[d], first[d + 1] - w + 1
            if b > a:
                part = act[a:b]
                at = part.argmax(0)
                best = part[at, np.arange(FILTERS)]
                s = slice(c * FILTERS, (c + 1) * FILTERS)
                pooled[d, s] = np.maximum(best, 0)
                argmax[d, s] = np.where(best > 0, at + a, -1)
    z = pooled @ net.out + net.bias[0]
    dz = (1 / (1 + np.exp(-z)) - y) / n
    dpool = dz[:, None] * net.out[None]
    gw, gb = [np.zeros_like(w) for w in net.w], [np.zeros_like(b) for b in net.b]
    rows, parts = [], []
    for c, w in enumerate(WIDTHS):
        for f in range(FILTERS):
            at, dp = argmax[:, c * FILTERS + f], dpool[:, c * FILTERS + f]
            ok = at >= 0
            at, dp = at[ok], dp[ok]
            gb[c][f] = dp.sum()
            for k in range(w):
                gw[c][k, :, f] = dp @ x[at + k]
                for part in slots[at + k].T:
                    rows.append(part)
                    parts.append(dp[:, None] * net.w[c][k][:, f][None])
    rows, parts = np.concatenate(rows), np.concatenate(parts)
    unique, inverse = np.unique(rows, return_inverse=True)
    demb = np.zeros((len(unique), DIM), np.float32)
    np.add.at(demb, inverse, parts)
    decay = 1e-4
    return [(unique, demb + decay * net.emb[unique]), *[(None, g + decay * w) for g, w in zip(gw, net.w, strict=True)], *[(None, g) for g in gb], (None, pooled.T @ dz + decay * net.out), (None, np.array([dz.sum()], np.float32))]


def held_out(doc_id) -> F.col:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold: `sample` documents at most,
    of whole texts of at most `longest` characters each."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.union(part)
    chosen = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]  # `sample` pairs at most
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    texts = id_text(docs).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    whole = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    rows = whole.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")

    def run(batches):  # in one executor task, over `sample` rows at most: no text reaches the driver
        texts, marks = [], []
        for batch in batches:
            body, offsets = column_bytes(batch.column("text"))
            texts += [body[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            marks += batch.column("toxic").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(marks)))], pa.binary())], names=["network"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), F.col("doc_id")), "doc_id")
    got = one.mapInArrow(run, "network binary").first()
    return pickle.loads(got["network"]) if got is not None else train([], np.zeros(0))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) and nothing else of the input."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        for batch in batches:
            for i, j, body, offsets in step_texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sent.value.scores(body, offsets))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    ready(docs.sparkSession)
    got = score(docs, fit(docs, labels, sample))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is below 0.7, with their columns. Scored beside the row: no join."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for batch in batches:
            body, offsets = column_bytes(batch.column("text"))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in steps(offsets):
                keep[i:j] = sent.value.scores(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) < 0.7
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
