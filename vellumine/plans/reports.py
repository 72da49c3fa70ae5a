"""Artefacts of an evaluation run: scores by document, their means, and both as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.checks import metric_means


def markdown_report(means: DataFrame, title: str) -> str:
    """Means as a Markdown table, a row a metric; only those few rows reach the driver."""
    lines = [f"# {title}", "", "| Metric | Mean | Documents |", "| --- | ---: | ---: |"]
    for r in means.orderBy("metric").collect():
        lines.append(f"| {r['metric']} | {'n/a' if r['mean'] is None else format(r['mean'], '.4f')} | {r['documents']} |")
    return "\n".join(lines) + "\n"


def write_run(scores: DataFrame, metrics: list[str], folder: str, title: str = "Evaluation") -> str:
    """per_doc and aggregate as JSON lines and report as text below a folder; returns the report."""
    scores.write.json(f"{folder}/per_doc")
    done = scores.sparkSession.read.schema(scores.schema).json(f"{folder}/per_doc")
    means = metric_means(done, metrics)
    means.coalesce(1).write.json(f"{folder}/aggregate")
    report = markdown_report(means, title)
    scores.sparkSession.createDataFrame([(report.rstrip(),)], "value string").coalesce(1).write.text(f"{folder}/report")
    return report


def replace_section(text: str, name: str, body: str) -> str:
    """A text with the part between two marks replaced, or added at the end; doing it again changes nothing."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    before, found, rest = text.partition(start)
    section = f"{start}\n{body.strip()}\n{end}"
    if found and end in rest:
        return before + section + rest.partition(end)[2]
    return f"{text.rstrip()}\n\n{section}\n" if text.strip() else section + "\n"
