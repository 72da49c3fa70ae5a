"""Queries over rows that their SQL leaves out, against brute force."""

from vellumine.plans import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_char_error_rate_of_every_pair(spark, tmp_path):
    texts = ["naïve Straße", "naive Strasse", "日本語", "", "", "plain", "é" * 2100, "e" + "é" * 2050, "x" * 20001, "y", None, "z"]
    rows = [(c, t, x) for c in (1, 2) for t, x in enumerate(texts if c == 1 else texts[:3])]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for (c, _, a), (d, t, b) in zip(rows, rows[1:]):
        if c == d:
            if a is None or b is None or max(len(a), len(b)) > 20000:
                want[c, t] = (None, None)
            else:
                n = distance(a, b)
                want[c, t] = (n / len(a) if a else float(b != ""), 1 - n / max(len(a), len(b)) if a or b else 1.0)
    got = catalogue.QUERIES["char_error_rate"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.cer, r.edit_similarity) for r in got} == want and len(got) == len(want)


def test_norm_text_of_every_document(spark, tmp_path):
    import re

    rows = [(1, "İstanbul  # A*B"), (2, None), (3, "Plain > Text"), (4, ""), (5, "DİL ~ ı I")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {d: None if t is None else " ".join(re.sub(r"[#*_`|>~-]", " ", t).lower().split()) for d, t in rows}
    got = catalogue.QUERIES["norm_text"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)


def test_entities_are_decoded_once(spark):
    from pyspark.sql import functions as F

    from vellumine.functions import text as T
    from vellumine.sources import xmls

    texts = ["a&#65;&#x42;&#X43;b", "&#38;lt; &amp;lt; &amp;#65;", "&#0;&#55296;&#1114112;&#99999999999;&#xZ;&# 5;", "&copy; &nbsp;&apos;&#8364;&#x1F600;!", "", "&#", None, "&#169;&lt;b&gt;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.d for r in rows.select("k", T.decode_entities(F.col("t")).alias("d")).collect()}
    assert got == {k: None if t is None else xmls.decode_entities(t) for k, t in enumerate(texts)}
    assert got[1] == "&lt; &lt; &#65;" and got[0] == "aABCb" and got[3] == "&copy;  '€😀!"


def test_latex_of_what_is_not_ascii(spark):
    from pyspark.sql import functions as F

    from vellumine.functions import text as T

    row = spark.createDataFrame([("a\u00a0b–c—d‘e”f•g…h×i÷j≤k≥l≠m±n\tö{_}\x07\\",)], "t string")
    assert row.select(T.escape_latex(F.col("t"))).first()[0] == "a b-c---d'e\"f*g...hxi/j<=k>=l!=m+/-n ?\\{\\_\\}\\textbackslash{}"


def test_tau_against_all_pairs(spark):
    import random

    from vellumine.operators import metrics as M

    g, rows, want = random.Random(7), [], {}
    for k in range(40):
        n = g.randint(1, 40)
        own = [(g.randrange(g.choice([3, 50])), g.randrange(g.choice([4, 60]))) for _ in range(n)]
        rows += [(k, p, q) for p, q in own]
        c = d = tp = tq = 0
        for i in range(n):
            for j in range(i):
                x, y = own[i][0] - own[j][0], own[i][1] - own[j][1]
                c, d, tp, tq = c + (x * y > 0), d + (x * y < 0), tp + (x == 0), tq + (y == 0)
        under = ((n * (n - 1) // 2 - tp) * (n * (n - 1) // 2 - tq)) ** 0.5
        want[k] = (c, d, round((c - d) / under if under else 0.0, 9))
    got = M.kendall(spark.createDataFrame(rows, "k int, p int, g int"), "k").collect()
    assert {r.k: (r.concordant, r.discordant, round(r.tau, 9)) for r in got} == want


def test_overlaps_keep_lone_boxes(spark):
    import random

    from vellumine.operators import layout, segments

    g = random.Random(3)
    boxes = [(p, k, (float(g.randrange(300)), float(g.randrange(300)), float(g.randrange(1, 90)), float(g.randrange(1, 90)))) for p in range(6) for k in range(1 if p == 0 else 30)]
    rows = [(p, 100 * p + k, dict(zip(("x", "y", "width", "height"), b))) for p, k, b in boxes]
    got = segments.best_overlaps(spark.createDataFrame(rows, "page int, id int, bbox struct<x:double,y:double,width:double,height:double>"), ["page"], "id").collect()
    assert len(got) == len(rows)
    for r in got:
        mine = next(b for p, k, b in boxes if 100 * p + k == r.id)
        others = [layout.iou(mine, b) for p, k, b in boxes if p == r.page and 100 * p + k != r.id]
        assert abs(r.best_iou - max(others, default=0.0)) < 1e-12


def test_overlap_of_tokens(spark):
    from collections import Counter

    from vellumine.operators import metrics as M

    texts = [("a b a", "a a a c"), ("", "x"), (None, "x"), ("x", None), ("é b", "b é é"), ("", "")]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, t string, o string")
    want = {k: (len((t or "").split()), len((o or "").split()), sum((Counter((t or "").split()) & Counter((o or "").split())).values())) for k, (t, o) in enumerate(texts)}
    assert {r.k: (r.n_truth, r.n_output, r.n_both) for r in M.token_overlap(rows, "k", "t", "o").collect()} == want
    assert M.token_overlap(rows.limit(0), "k", "t", "o").count() == 0


def test_registered_formats_reach_the_workers(spark):
    from vellumine import api
    from vellumine.sources.blocks import Block

    api.register("reversed", lambda path, content: [Block("paragraph", content.decode()[::-1])], "zzz")
    got = api.extract(spark.createDataFrame([("a.zzz", bytearray(b"abc"))], "path string, content binary")).first()
    assert got.ok and got.text == "cba" and got.format == "reversed"


def test_a_stream_that_is_too_long_is_an_error(monkeypatch):
    import zlib

    import pytest

    from vellumine.sources import pdf

    monkeypatch.setattr(pdf, "MOST", 50)
    body = zlib.compress(b"x" * 500)
    content = b"%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n" % (len(body), body)
    with pytest.raises(pdf.TooLong):
        pdf.pdf(content)


def test_gate(spark, tmp_path):
    from vellumine.streaming import files

    base = spark.createDataFrame([(1, "f1", 0.9), (2, "f1", 0.5)], "id long, metric string, score double")
    spark.createDataFrame([(1, "f1", 0.8), (2, "f1", 0.5), (3, "f1", 0.1)], base.schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    files.gate(stream, base, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = {r.id: (r.side, r.verdict, r.passed, r.regressions) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("shared", "regressed", False, 1), 2: ("shared", "unchanged", False, 1), 3: ("only_in_candidate", None, False, 1)}
