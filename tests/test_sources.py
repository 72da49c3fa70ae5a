"""Decoders on small files of every format, and the ways they are called."""

import gzip
import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest

from vellumine import api
from vellumine.sources import containers, jsons, markup, tabular, xmls
from vellumine.sources.extract import decode
from vellumine.sources.glyphs import glyph_text
from vellumine.streaming.files import ingest


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in files.items():
            z.writestr(n, b)
    return out.getvalue()


def made_pdf(content: bytes, flate: bool = True, page: bytes = b"", font: bytes = b"") -> bytes:
    body = zlib.compress(content) if flate else content
    name = b"/Filter /FlateDecode " if flate else b""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>",
        b"<< /Type /Page /Parent 2 0 R " + page + b" /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< " + name + b"/Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica " + font + b" >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"%%EOF"


PAGE = b"""BT /F1 24 Tf 50 740 Td (A Report) Tj ET
BT /F1 10 Tf 50 700 Td (The first line of a para-) Tj 0 -12 Td (graph goes on here.) Tj ET
BT /F1 10 Tf 50 600 Td [(Na) -20 (me)] TJ 200 0 Td (Count) Tj 100 0 Td (Share) Tj ET
BT /F1 10 Tf 50 586 Td (one) Tj 200 0 Td (12) Tj 100 0 Td (5\\051) Tj ET
BT /F1 10 Tf 50 572 Td (two) Tj 200 0 Td (30) Tj 100 0 Td (6%) Tj ET"""


@pytest.mark.parametrize("flate", [True, False])
def test_pdf(flate):
    blocks = decode("a.pdf", made_pdf(PAGE, flate))[1]
    assert [(b.kind, b.text) for b in blocks] == [("heading_1", "A Report"), ("paragraph", "The first line of a paragraph goes on here."), ("table", "")]
    assert blocks[2].grid == [["Name", "Count", "Share"], ["one", "12", "5)"], ["two", "30", "6%"]]
    assert all(b.page == 1 and b.box[1] >= 0 for b in blocks)


def test_pdf_glyph_names():
    font = b"/Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 /f_f_i /eacute 65 /alpha /Omega /uni20AC /g7 /A.sc] >>"
    assert decode("a.pdf", made_pdf(b"BT /F1 10 Tf 50 700 Td (\\001\\002ABCDE \\216) Tj ET", font=font))[1][0].text == "ffiéαΩ€DA é"
    assert decode("a.pdf", made_pdf(b"BT /F1 10 Tf 50 700 Td <FEFF00E900670432> Tj ET"))[1][0].text == "égв"
    assert [glyph_text(n) for n in ("lambda", "Zcaron", "u1D49C", "uniD800", "f__i", "cid7", "period")] == ["λ", "Ž", "\U0001d49c", None, None, None, "."]


@pytest.mark.parametrize("angle,matrix", [(0, "1 0 0 1 0 0"), (90, "0 1 -1 0 600 0"), (180, "-1 0 0 -1 600 800"), (270, "0 -1 1 0 0 800"), (-90, "0 -1 1 0 0 800")])
def test_pdf_rotated_pages_read_as_shown(angle, matrix):
    turned = f"{matrix} cm\n".encode() + PAGE.replace(b"740", b"590").replace(b"700 Td", b"560 Td").replace(b"600 Td", b"500 Td").replace(b"586", b"486").replace(b"572", b"472")
    flat = decode("a.pdf", made_pdf(turned.partition(b"\n")[2]))[1]
    got = decode("a.pdf", made_pdf(turned, page=b"/Rotate %d" % angle))[1]
    assert [(b.kind, b.text, b.grid) for b in got] == [(b.kind, b.text, b.grid) for b in flat]
    lower = 200 if angle % 180 else 0  # a turned page is 600 high, not 800
    assert all(abs(p - q) < 1e-6 for a, b in zip(got, flat) for p, q in zip(a.box, (b.box[0], b.box[1] - lower, b.box[2], b.box[3])))


def ruled(xs, ys, cells, paint=b"S") -> bytes:
    lines = [b"%d %d m %d %d l" % (x, ys[0], x, ys[-1]) for x in xs] + [b"%d %d m %d %d l" % (xs[0], y, xs[-1], y) for y in ys]
    return b"\n".join([*lines, paint]) + b"\n" + said(cells)


def said(cells) -> bytes:
    return b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET\n" % c for c in cells)


def test_pdf_ruled_tables():
    xs, ys = [50, 150, 300, 400], [500, 520, 540, 560, 580]
    cells = [(60, 565, b"Item"), (160, 565, b"What it is"), (60, 545, b"a"), (160, 545, b"first words"), (310, 525, b"9"), (60, 505, b"c")]
    grid = [["Item", "What it is", ""], ["a", "first words", ""], ["", "", "9"], ["c", "", ""]]
    after = b"BT /F1 10 Tf 50 450 Td (Text below it.) Tj ET\n"
    got = decode("a.pdf", made_pdf(ruled(xs, ys, cells) + after))[1]
    assert [(b.kind, b.text, b.grid) for b in got] == [("table", "", grid), ("paragraph", "Text below it.", [])]
    assert got[0].box == (50, 220, 350, 80)
    assert all(b.kind != "table" for b in decode("a.pdf", made_pdf(ruled(xs, ys, cells, b"n")))[1])  # nothing drawn
    assert all(b.kind != "table" for b in decode("a.pdf", made_pdf(ruled(xs, ys, cells[:2])))[1])  # nothing below the head
    short = ruled(xs, ys[2:], cells[:4])  # two rows are a table below a label only
    label = b"BT /F1 10 Tf 50 600 Td (Table 1: things) Tj ET\n"
    assert [b.kind for b in decode("a.pdf", made_pdf(short))[1] if b.kind == "table"] == []
    assert [b.grid for b in decode("a.pdf", made_pdf(label + short))[1] if b.kind == "table"] == [grid[:2]]
    lower = ruled(xs[:3], [y - 300 for y in ys], [(60, 265, b"x"), (160, 265, b"y"), (60, 245, b"1")])
    assert [b.grid for b in decode("a.pdf", made_pdf(lower + ruled(xs, ys, cells)))[1]] == [grid, [["x", "y"], ["1", ""], ["", ""], ["", ""]]]
    boxes = b"".join(b"%d %d %d %d re\n" % (x, y, w, 20) for x, w in ((50, 100), (150, 150), (300, 100)) for y in ys[:-1])
    assert decode("a.pdf", made_pdf(boxes + b"B\n" + said(cells)))[1][0].grid == grid


def test_pdf_spans(spark):
    files = [("a.pdf", made_pdf(b"BT /F1 10 Tf 50 700 Td (one) Tj 0 -20 Td (two) Tj ET", page=b"/Rotate 180")), ("b.pdf", made_pdf(b"")), ("c.pdf", b"no"), ("d.pdf", None)]
    got = api.pdf_spans(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "span_index").collect()
    assert [(r.path, r.ok, r.page, r.span_index, r.text) for r in got] == [("a.pdf", True, 1, 0, "one"), ("a.pdf", True, 1, 1, "two"), ("b.pdf", True, 1, None, None), ("c.pdf", False, None, None, None), ("d.pdf", False, None, None, None)]
    assert (got[0].width, got[0].height, got[0].rotation) == (600, 800, 180) and got[0].bbox.x == 550 and got[0].bbox.y == 97.5


def test_pdf_two_columns():
    left = b"".join(b"BT /F1 10 Tf 50 %d Td (left side number %d ends.) Tj ET\n" % (700 - 14 * k, k) for k in range(3))
    right = b"".join(b"BT /F1 10 Tf 330 %d Td (right side number %d ends.) Tj ET\n" % (693 - 14 * k, k) for k in range(3))
    text = " ".join(b.text for b in decode("a.pdf", made_pdf(right + left))[1])
    assert text.index("left side number 2") < text.index("right side number 0")


def test_markdown_and_plain():
    got = markup.plain("# Title\n\nsome *text*\nmore\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n\n- one\n- two\n")
    assert [(b.kind, b.text) for b in got] == [("heading_1", "Title"), ("paragraph", "some *text* more"), ("table", ""), ("list", "one\ntwo")]
    assert got[2].grid == [["a", "b"], ["1", "x|y"]]
    assert [b.text for b in markup.plain("one\ntwo\n \nthree")] == ["one two", "three"]
    assert markup.plain("") == []


def test_latex():
    source = r"""\documentclass{article}\begin{document}\title{On \emph{Things}} % note
\section{First} Words~here with 100\% and \cite{x} more.
\begin{itemize}\item one \item two\end{itemize}
\begin{table}\caption{Sums}\begin{tabular}{lr}\hline a & 1 \\ b & 2 \\\end{tabular}\end{table}\end{document}"""
    got = markup.latex(source)
    assert [(b.kind, b.text) for b in got] == [("heading_1", "On Things"), ("heading_1", "First"), ("paragraph", "Words here with 100% and more."), ("list", "one\ntwo"), ("table", "Sums")]
    assert got[-1].grid == [["a", "1"], ["b", "2"]]


def test_token_labels_and_email():
    line = "\t".join(["{}", "{}", "10", "{}", "20", "0", "0", "0", "Font", "{}"])
    got = markup.plain("\n".join([line.format("Deep", 5, 20, "title"), line.format("Learning", 22, 40, "title"), line.format("Works", 5, 9, "paragraph")]))
    assert [(b.kind, b.text, b.box) for b in got] == [("title", "Deep Learning", (5, 10, 35, 10)), ("paragraph", "Works", (5, 10, 4, 10))]
    assert [(b.kind, b.text) for b in markup.email("From: a\r\nSubject: long\r\n subject\r\n\r\nhello\r\n\r\nbye")] == [("heading_1", "long subject"), ("paragraph", "hello"), ("paragraph", "bye")]


def test_tabular():
    assert [b.text for b in tabular.delimited('a,b\n"1", 2 \n,,\n', ",")] == ["a b", "1 2"]
    boxes = tabular.delimited("1,2,5,2,5,6,1,6,TOTAL, 9.00\n", ",")
    assert (boxes[0].kind, boxes[0].text, boxes[0].box) == ("ocr_line", "TOTAL, 9.00", (1, 2, 4, 4))
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    got = tabular.delimited(head + "\n5\t2\t1\t1\t1\t1\t10\t20\t30\t8\t90\tHello\n5\t2\t1\t1\t1\t2\t50\t20\t10\t8\t-1\tyou\n4\t2\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n", "\t")
    assert [(b.text, b.page, b.box, b.confidence) for b in got] == [("Hello you", 2, (10, 20, 50, 8), 0.9)]


def test_json_dialects():
    coco = {"images": [{"id": 7}, {"id": 8}], "categories": [{"id": 1, "name": "table"}], "annotations": [{"image_id": 8, "category_id": 1, "bbox": [5, 9, 2, 2]}, {"image_id": 8, "category_id": 2, "bbox": [1, 2, 3, 4]}]}
    assert [(b.kind, b.page, b.box) for b in jsons.one(coco)] == [("layout", 2, (1, 2, 3, 4)), ("table", 2, (5, 9, 2, 2))]
    form = {"form": [{"label": "answer", "text": "b", "box": [0, 9, 5, 12]}, {"text": "a", "box": [0, 1, 5, 4]}]}
    assert [(b.kind, b.text) for b in jsons.one(form)] == [("field", "a"), ("answer", "b")]
    page = [{"layout_dets": [{"category_type": "text", "text": "late", "poly": [0, 0, 1, 0, 1, 1, 0, 1]}, {"category_type": "title", "text": "first", "order": 1}, {"category_type": "text", "text": "no", "ignore": True}, {"category_type": "table", "order": 2, "html": "<table><tr><td>x</td></tr></table>"}]}]
    assert [(b.kind, b.text) for b in jsons.one(page)] == [("title", "first"), ("table", ""), ("text", "late")]
    tokens = {"html": {"structure": {"tokens": ["<tr>", "<td>", "</td>", "<td", ' colspan="2"', ">", "</td>", "</tr>"]}, "cell": [{"tokens": ["<b>", "a", "</b>"]}, {"tokens": ["b"]}]}}
    assert jsons.one(tokens)[0].grid == [["a", "b"]]
    assert [b.text for b in jsons.one({"words": [{"text": "b", "bbox": [5, 0, 6, 1]}, {"text": "a", "bbox": [0, 0, 1, 1]}]})] == ["a", "b"]
    assert jsons.one({"cells": [["a", {"text": 2}]]})[0].grid == [["a", "2"]]
    assert [(b.kind, b.text, b.page) for b in jsons.decode('{"title":"T","body":[{"text":"x"}]}\n{"text":"y"}')] == [("title", "T", 1), ("text", "x", 1), ("text", "y", 2)]


def test_xml_dialects():
    assert [b.text for b in xmls.html("<title>x</title><h1>Big &amp; small</h1><p>a <b>c</b></p><script>no</script>")] == ["Big & small", "a c"]
    hocr = '<div class="ocr_page" title="bbox 0 0 9 9"><span class="ocr_line" title="bbox 1 2 6 4"><span class="ocrx_word" title="bbox 1 2 3 4; x_wconf 80">Hi</span> <span class="ocrx_word" title="x_wconf 90">you</span></span></div>'
    assert [(b.text, b.box, round(b.confidence, 3)) for b in xmls.html(hocr)] == [("Hi you", (1, 2, 5, 2), 0.85)]
    alto = '<alto xmlns="u"><Layout><Page><TextLine><String CONTENT="a" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4" WC="0.5"/><String CONTENT="b"/></TextLine></Page></Layout></alto>'
    assert [(b.text, b.box, b.confidence) for b in xmls.xml(alto)] == [("a b", (1, 2, 3, 4), 0.5)]
    page = '<PcGts><Page><TextLine><Coords points="0,0 4,0 4,2"/><Word><TextEquiv conf="0.4"><Unicode>w</Unicode></TextEquiv></Word></TextLine></Page></PcGts>'
    assert [(b.text, b.box, b.confidence) for b in xmls.xml(page)] == [("w", (0, 0, 4, 2), 0.4)]
    voc = "<annotation><object><name>cat</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    assert [(b.kind, b.box) for b in xmls.xml(voc)] == [("cat", (1, 1, 2, 3))]
    assert [b.text for b in xmls.xml("<a><p>one</p><p>two")] == ["one", "two"]


def test_office_and_archives():
    w = "<w:document xmlns:w='u'><w:p><w:pPr/><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t><w:tab/></w:r></w:p><w:p/></w:document>"
    assert [b.text for b in decode("a.docx", zipped({"word/document.xml": w}))[1]] == ["Hello you"]
    sheet = "<worksheet><row><c t='s'><v>1</v></c><c><v>5</v></c><c t='inlineStr'><is><t>in</t></is></c></row></worksheet>"
    x = zipped({"xl/sharedStrings.xml": "<sst><si><t>a</t></si><si><t>b</t></si></sst>", "xl/worksheets/sheet10.xml": sheet, "xl/worksheets/sheet2.xml": sheet.replace(">5<", ">4<")})
    assert [(b.text, b.page) for b in decode("a.xlsx", x)[1]] == [("b 4 in", 1), ("b 5 in", 2)]
    slide = "<p:sld xmlns:p='u' xmlns:a='v'><a:p><a:t>{}</a:t></a:p></p:sld>"
    assert [b.text for b in decode("a.pptx", zipped({"ppt/slides/slide10.xml": slide.format("z"), "ppt/slides/slide9.xml": slide.format("y")}))[1]] == ["y", "z"]
    assert [b.text for b in decode("a.odt", zipped({"content.xml": "<o><h>Head</h><p>x <s>y</s></p></o>"}))[1]] == ["Head", "x y"]
    z = zipped({"b.txt": "text", "a.json": '{"text": "json"}', "c.bin": "no"})
    assert [(b.text, b.page) for b in decode("a.zip", z)[1]] == [("json", 1), ("text", 2)]
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("x.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    assert [b.text for b in decode("a.tar.gz", t.getvalue())[1]] == ["hi"]
    assert [b.text for b in decode("a.txt.gz", gzip.compress(b"packed"))[1]] == ["packed"]


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 40, 0) + struct.pack("<HHII", 257, 4, 1, 30) + b"\0" * 4
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (39).to_bytes(3, "little") + (29).to_bytes(3, "little")
    for b in (png, jpeg, tiff, webp, b"GIF89a" + struct.pack("<HH", 40, 30), b"BM" + b"\0" * 16 + struct.pack("<ii", 40, -30)):
        assert tuple(containers.image_size(b)) == (40, 30)
    assert containers.image_size(b"none") is None


def test_read_documents(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# T\n\nbody\n\n|a|b|\n|-|-|\n|1|2|\n")
    (tmp_path / "in" / "deep" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "in" / "c.doc").write_bytes(b"old")
    (tmp_path / "in" / "d.txt").write_text(" \n")
    (tmp_path / "in" / "._e.txt").write_text("sidecar")
    blocks = api.read_documents(spark, str(tmp_path / "in")).cache()
    assert {(r.path.rpartition("/")[2], r.ok, r.kind) for r in blocks.collect()} == {("a.md", True, "heading_1"), ("a.md", True, "paragraph"), ("a.md", True, "table"), ("b.pdf", False, None), ("c.doc", False, None), ("d.txt", True, None)}
    assert [r.markdown for r in api.to_markdown(blocks).collect()] == ["# T\n\nbody\n\n| a   | b   |\n| --- | --- |\n| 1   | 2   |"]
    assert "\\section{T}" in api.to_latex(blocks).first().latex and "\\begin{tabular}{rr}" in api.to_latex(blocks).first().latex
    assert [b["kind"] for b in json.loads(api.to_json(api.without_geometry(blocks)).first().json)["blocks"]] == ["heading_1", "paragraph", "table"]
    assert api.only_pages(blocks, "2-3,5").count() == 0 and api.only_pages(blocks, "1").count() == 3
    assert {(r.path.rpartition("/")[2], r.format, r.status) for r in api.inspect(spark, str(tmp_path / "in")).collect()} == {("a.md", "markdown", "supported"), ("b.pdf", "pdf", "supported"), ("c.doc", "planned", "planned"), ("d.txt", "text", "supported")}
    texts = spark.createDataFrame([(1, "x\n\ny"), (2, None)], "id int, t string")
    assert sorted((r.path, r.ok, r.text) for r in api.parse_text(texts, "id", "t").where("ok").collect()) == [("1.txt", True, "x"), ("1.txt", True, "y")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo")
    for n in (2, 3):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n  # a second run reads the new file only
        (tmp_path / "in" / "b.txt").write_text("three")
