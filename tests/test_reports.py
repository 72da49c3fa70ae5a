"""Feature tables, formulas as they are searched for, run artefacts and the command line."""

import json

from pyspark.sql import functions as F

from vellumine import __main__ as cli
from vellumine.functions import text as T
from vellumine.plans import reports
from vellumine.sources import tabular


def test_feature_table():
    text = "feature\tbounding boxes\ttext\nheading\t(2;[10;20;30;25]),(3;[5;40;50;60])\tA  title\tgoes on\n\t(0;[1;2;0;9])\tplain\nx\t\t \nshort\n"
    got = tabular.delimited(text, "\t")
    assert [(b.kind, b.text, b.page, b.box) for b in got] == [("heading", "A title goes on", 2, (5.0, 20.0, 45.0, 40.0)), ("row", "plain", 1, None)]
    assert tabular.feature_table(["a\tb"], "\t") is None and tabular.feature_table(["feature,bounding boxes,text"], ",") is None


def test_math_alias(spark):
    texts = ["\\alpha_{12} \\in {A}", "plain", "", None, "x^{n_{1}}", "\\infty"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.math_alias(F.col("t")).alias("a"))
    assert {r.k: r.a for r in got.collect()} == {0: "α_12 ∈ A", 1: None, 2: None, 3: None, 4: "x^n_1", 5: "∞"}


def test_write_run(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1.0, None), ("b", 0.5, 0.25), ("c", None, None)], "document string, f1 double, teds double")
    report = reports.write_run(scores, ["f1", "teds"], str(tmp_path / "run"), "Run")
    assert "| f1 | 0.7500 | 2 |" in report and "| teds | 0.2500 | 1 |" in report
    assert spark.read.json(str(tmp_path / "run/per_doc")).count() == 3
    assert {r.metric: r.mean for r in spark.read.json(str(tmp_path / "run/aggregate")).collect()} == {"f1": 0.75, "teds": 0.25}
    assert "".join(p.read_text() for p in (tmp_path / "run/report").glob("part-*")) == report


def test_replace_section():
    once = reports.replace_section("# A\n", "bench", "one\n")
    assert once == "# A\n\n<!-- bench:start -->\none\n<!-- bench:end -->\n" and reports.replace_section(once, "bench", "one") == once
    assert reports.replace_section(once + "tail", "bench", "two") == once.replace("one", "two") + "tail"
    assert reports.replace_section("", "b", "x") == "<!-- b:start -->\nx\n<!-- b:end -->\n"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Title\n\nSome text.\n")
    cli.main(["convert", str(tmp_path / "in")])
    line = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert line["path"].endswith("a.md") and line["markdown"] == "# Title\n\nSome text."
    cli.main(["extract", str(tmp_path / "in"), "--pages", "1", "--out", str(tmp_path / "out")])
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).orderBy("block_index").collect()] == ["Title", "Some text."]
    cli.main(["inspect", str(tmp_path / "in")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["format"] == "markdown"
