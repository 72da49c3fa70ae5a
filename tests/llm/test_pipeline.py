"""Each stage of the corpus pipeline, and the operators that return documents, against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from vellumine.llm import jpeg, mixing, secrets, simhash, toxicity
from vellumine.llm.queries import BYTE_TOKENS, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, copies long, kept string, `row` int, doc string, nth int"
KEY = "tok Abcdef0123456789Abcdef0123 end"


def prose(g, n):
    return " ".join("w%d" % g.randrange(300) for _ in range(n))


def make():
    g = random.Random(8)
    texts = [prose(g, g.randint(1, 90)) for _ in range(40)]
    texts += [texts[3]] * 4 + [None, "", " ", KEY, "x " + KEY, prose(g, 30) + " password = abcDEF123456!", "é" * 30 + " token: ABCDEFGHIJKLMNOP é"]
    rows = [(k // 2 if k % 9 == 0 else k, t, "en", g.choice(["a", "b", None]) if k % 3 else "hot", len(t or ""), 77, 88.0, 9, "keep", 5, "d", 6) for k, t in enumerate(texts)]
    rows += [rows[1], (2, texts[7], *rows[2][2:]), (5, texts[8], *rows[2][2:]), (5, texts[7], *rows[2][2:])]
    rows += [(None, texts[11], *rows[1][2:]), (None, texts[11], *rows[1][2:]), (None, texts[9] + " more", *rows[1][2:])]
    return rows


ROWS = make()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    g = random.Random(4)
    toxic = [(1000 + k, int(k % 4 == 0)) for k in range(400)]
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    more = [(d, prose(g, 40) + (" vile awful" if t else ""), "en", "a", 1, 77, 88.0, 9, "keep", 5, "d", 6) for d, t in toxic]
    spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def fingerprints(rows):
    import xxhash

    out = []
    for t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").split(" ") if x]
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_near_duplicates_keep_one_row_of_each_group(spark, docs):
    fps = fingerprints([r[1] for r in ROWS])
    of = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    of[i] = of[j] = min(of[i], of[j])
    groups = {}
    for k, g in enumerate(of):
        groups.setdefault(g, []).append(ROWS[k])
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(groups)
    for g in groups.values():
        kept = [r for r in got if r in g]
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == least
    again = corpus_pipeline.without_near_duplicates(spark, docs.repartition(2), "").collect()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again)
    assert {r[1] for r in ROWS if r[0] is None} & {r[1] for r in got}


def brute_redact(text, spans):
    out, at = "", 0
    for a, b in spans:
        if a < at:
            at = max(at, b)
        else:
            out, at = out + text[at:a] + "[secret]", b
    return out + text[at:]


def test_redact_leaves_other_columns_alone(spark, docs):
    named = {}
    for r in secrets.secrets_report(docs).collect():
        named.setdefault(r.doc_id, []).append(r.spans)
    got = secrets.redact(docs)
    assert got.schema == docs.schema
    want = Counter()
    report = spark.createDataFrame([(k, *r[1:4]) for k, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secrets.secrets_report(report).collect()}
    for k, r in enumerate(ROWS):
        text = brute_redact(r[1] or "", spans[k]) if spans[k] else r[1]
        want[(r[0], text, *r[2:4], len(text) if spans[k] else r[4], *r[5:])] += 1
    assert as_rows(got) == want
    assert sum(bool(s) for s in spans.values()) >= 2
    assert secrets.redact(docs.limit(0)).count() == 0


def test_token_spans_against_all_pairs():
    g = random.Random(3)
    for _ in range(200):
        text = "".join(g.choice("Ab1_ ") for _ in range(120))
        base = sorted((a := g.randrange(118), 0, a + g.randint(1, 9)) for _ in range(g.randrange(5)))
        import re

        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{6,}", text):
            t = m[0]
            if re.search("[A-Z]", t) and re.search("[a-z]", t) and re.search("[0-9]", t) and not any(a < m.end() and m.start() < b for a, _, b in base):
                want.append(m.span())
        assert secrets.token_spans(text, base, 6) == want


def test_mixture_copies_rows_as_they_are(spark, docs):
    taken = Counter()
    numbered = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(ROWS)], "at long, doc_id long, text string, lang string, source string")
    for r in mixing.repeats(numbered, carry=True).collect():
        if r.copies:
            taken[tuple(ROWS[r["row"]["at"]])] += r.copies
    got = mixing.mixture(docs)
    assert got.schema == docs.schema and as_rows(got) == taken
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    g = random.Random(1)
    rows = [(k if k % 5 else None, prose(g, g.randint(5, 60)) + f" u{k}", ["a", "b", "c", "d", None][min(4, g.randrange(9))]) for k in range(4000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), [0, 0.0])
        rate = r.target / r.source_size % 1
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] += rate * (1 - rate) * r.size**2
    for (_, target), (taken, variance) in by.items():
        assert abs(taken - target) <= 4 * variance**0.5 + 1e-6


def test_many_sources_are_ranked_in_ranges(spark):
    rows = [(k, "w " * (k % 7 + 1), "s%04d" % (k % 900)) for k in range(1800)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    left, live, target = 1.5 * sum(size.values()), set(size), {}
    while True:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            live.discard(s)
    target |= {s: left * weight[s] / total for s in live}
    for r in got.collect():
        assert r.target == pytest.approx(target[rows[r.doc_id][2]])


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.without_toxic(spark, docs, folder)
    assert got.schema == docs.schema
    left = Counter(r.doc_id for r in got.collect())
    rejected = [r.doc_id for r in docs.collect() if "vile" in (r.text or "")]
    assert sum(left[d] > 0 for d in rejected) <= 2
    scored = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(left) == {d for d, s in scored if s < 0.7}


def test_longest_words_do_not_matter_to_the_network():
    texts = [b"clean words here %d" % k for k in range(40)] + [b"vile words %d" % k for k in range(40)]
    net = toxicity.train(texts, np.r_[np.zeros(40), np.ones(40)])
    long = b"clean words here " * 40_000 + b"vile"
    score = lambda t: net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    assert score(long) == pytest.approx(score(long[len(b"clean words here ") * 39_990 :]), abs=1e-6)


def test_packed_pieces_are_whole(spark, docs):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(vocabulary(BYTE_TOKENS))
    got = corpus_pipeline.packed(spark, docs, "").collect()
    want = Counter((r[0], len(ids := tok.encode(r[1] or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in ROWS)
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_whole_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_hand = docs
    for _, stage in corpus_pipeline.STAGES:
        by_hand = spark.createDataFrame(stage(spark, by_hand, folder).collect(), stage(spark, by_hand, folder).schema)
    got = corpus_pipeline.run(spark, folder)
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(by_hand)


def test_the_pipeline_of_no_documents(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_media_is_stored_and_read_back(spark, docs, tmp_path):
    import hashlib

    kept = tmp_path / "media"
    kept.mkdir()
    rows = jpeg.media_report(docs, kept.as_uri()).collect()
    stored = b"".join(p.read_bytes() for p in kept.glob("*.jpegs"))
    assert len(stored) == sum(r.media_bytes for r in rows)
    assert sum(p.stat().st_size for p in kept.glob("*.rgb")) == sum(int(h) * int(w) * 3 for h, w in (r.feature.split(";")[0].split("x") for r in rows))
    by = {hashlib.sha256(m.media).hexdigest(): m for m in jpeg.media(docs).collect()}
    for r in rows:
        m = by[r.media_sha256]
        at = stored.find(bytes(m.media))
        image = jpeg.decode(stored[at : at + r.media_bytes])
        assert hashlib.sha256(jpeg.payload_of(image).tobytes()).hexdigest() == r.payload_sha256
        pixels = np.frombuffer(m.rgb, np.uint8).reshape(-1, 3).astype(float)
        mean = [int(x * 100 + 1e-6) for x in pixels.mean(0)]
        assert r.feature.split(";")[1] == "mean=" + ",".join(map(str, mean))
    assert jpeg.media_report(docs.limit(0)).count() == 0 and jpeg.media(docs.limit(0)).count() == 0
    assert sorted(r.media_sha256 for r in jpeg.media_report(docs).collect()) == sorted(r.media_sha256 for r in rows)


def test_components_leave_one_edge_table(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from vellumine.llm.common import shared_dir

    tables = lambda: set(Path(urlparse(shared_dir(spark)).path).glob("edges-*"))
    before = tables()
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {60: 50}
    assert len(tables() - before) == 1
