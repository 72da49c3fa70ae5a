"""Rows and texts that operators used to pass by, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from vellumine.llm import quality, toxicity
from vellumine.llm.queries import BYTE_TOKENS, WORD_TOKENS, vocabulary
from vellumine.llm.tokens import Encoder


def js(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return max(0, (part(p) + part(q)) / 2) ** 0.5


def features(text):
    body = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(body)])
    return quality.class_histograms(body, offsets)[0], Counter(quality.word_slots(body, offsets)[0].tolist())


def distances(rows, common, least_words, least_reference, max_languages):
    """By doc_id: both distances from the language's own counts, or the corpus's beyond max_languages."""
    counted = {d: features(t) for d, t, _ in rows}

    def reference(ids):
        classes, slots = np.zeros(quality.CLASSES), Counter()
        for d in ids:
            classes += counted[d][0]
            slots.update(counted[d][1])
        return classes, slots

    langs = {x: reference([d for d, _, y in rows if y == x]) for x in {x for _, _, x in rows}}
    order = sorted(langs, key=lambda x: (-sum(langs[x][1].values()), x is not None, x or ""))
    corpus = reference(list(counted))
    out = {}
    for d, _, x in rows:
        classes, slots = langs[x] if x in order[:max_languages] else corpus
        words = sum(slots.values())
        if sum(counted[d][1].values()) < least_words or words < least_reference:
            out[d] = None
            continue
        top = [s for s, _ in sorted(slots.items(), key=lambda v: (-v[1], v[0]))[:common]]
        shares = lambda c: [c[s] for s in top] + [sum(c.values()) - sum(c[s] for s in top)]
        out[d] = (js(counted[d][0], classes), js(shares(counted[d][1]), shares(slots)))
    return out


def make_languages():
    g, rows = random.Random(11), []
    for k in range(60):
        lang = (None, "en", "", "de")[k % 4]
        vocab = ["%s%d" % ({None: "n", "": "Q"}.get(lang, lang), v) for v in range(30)]
        text = " ".join(g.choice(vocab) for _ in range(g.randint(60, 160 + 40 * (k % 4))))
        rows.append((k, "!?# %d " % k * 100 if k in (8, 9) else text, lang))
    return rows


def compare(spark, max_languages):
    rows = make_languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.quality(docs, common=8, least_words=80, least_reference=500, max_languages=max_languages).collect()
    want = distances(rows, 8, 80, 500, max_languages)
    assert len(got) == len(rows)
    for r in got:
        if want[r.doc_id] is None:
            assert r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed)
        else:
            assert (r.class_distance, r.word_distance) == pytest.approx(want[r.doc_id], abs=1e-9)
            assert r.kept == (not r.base_failed and r.class_distance <= 0.06**0.5 and r.word_distance <= 0.28**0.5)
    lang = {d: x for d, _, x in rows}
    assert {lang[r.doc_id] for r in got if r.class_distance is not None} == {None, "en", "", "de"}


def test_quality_of_null_languages(spark):
    compare(spark, 256)


def test_quality_beyond_the_most_languages(spark):
    compare(spark, 1)


@pytest.mark.parametrize("name", [WORD_TOKENS, BYTE_TOKENS])
def test_added_tokens_as_the_library_has_them(name):
    from tokenizers import Tokenizer

    g = random.Random(3)
    parts = [" ", "\n", "a", "The", "é", ".", "  ", "\t", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "endoftext", "<"]
    texts = ["a <|endoftext|> b", "<|startoftext|>", "<|endoftext|><|endoftext|>"] + ["".join(g.choice(parts) for _ in range(g.randint(0, 20))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(vocabulary(name)).encode(texts)] == want


def test_toxicity_learns_from_whole_texts(monkeypatch):
    seen, backward = set(), toxicity.backward
    monkeypatch.setattr(toxicity, "backward", lambda net, docs, y: seen.update((len(d), int(v)) for d, v in zip(docs, y)) or backward(net, docs, y))
    texts = [" ".join("w%d" % (k * i % 97) for i in range(1300 + k)).encode() for k in range(20)]
    toxicity.train(texts, np.arange(20) % 2, epochs=1)
    assert seen == {(1300 + k, k % 2) for k in range(20) if k % 5 != 4}
