"""The engine in a few calls: files in, blocks, Markdown, LaTeX or JSON out. All of it is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import render as R
from .sources.detect import detect_format, support_status
from .sources.extract import extract, list_files, pdf_spans, register

__all__ = ["detect_format", "extract", "inspect", "list_files", "only_pages", "parse_text", "pdf_spans", "read_documents", "register", "to_json", "to_latex", "to_markdown", "without_geometry"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every file below a path; see sources.extract."""
    return extract(list_files(spark, path).select("path", "content"))


def parse_text(texts: DataFrame, name: str, text: str) -> DataFrame:
    """Blocks of texts in a column, as of plain-text files."""
    return extract(texts.select(F.concat(F.col(name).cast("string"), F.lit(".txt")).alias("path"), F.encode(text, "utf-8").alias("content")))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, status, size) without reading any content."""
    fmt = detect_format(F.col("path"))
    return list_files(spark, path).select("path", fmt.alias("format"), support_status(fmt).alias("status"), F.col("length").alias("size"))


def only_pages(blocks: DataFrame, pages: str) -> DataFrame:
    """Blocks of pages such as "45", "43-45" or "1,5,9-12"."""
    keep = F.lit(False)
    for part in pages.split(","):
        lo, _, hi = part.strip().partition("-")
        keep |= F.col("page").between(int(lo), int(hi or lo))
    return blocks.where(keep)


def without_geometry(blocks: DataFrame) -> DataFrame:
    return blocks.drop("bbox")


def rendered(blocks: DataFrame) -> DataFrame:
    """Blocks with tables as their Markdown."""
    table = R.pipe_table(F.col("headers"), F.col("rows"))
    shown = F.when(F.col("headers").isNotNull(), F.concat_ws("\n\n", F.when(F.col("text") != "", F.col("text")), table))
    return blocks.where("ok and kind is not null").withColumn("table", shown)


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(path, markdown)."""
    piece = F.coalesce(F.col("table"), R.markdown_text(F.col("kind"), F.col("text")))
    shown = rendered(blocks).where(~F.col("kind").isin(*R.FURNITURE))
    return R.in_order(["path"], shown, ["page", "block_index"], piece, "\n\n", "markdown")


def to_latex(blocks: DataFrame) -> DataFrame:
    """(path, latex)."""
    good = blocks.where("ok and kind is not null")
    piece = F.when(F.col("headers").isNotNull(), R.latex_table(F.col("headers"), F.col("rows"))).otherwise(R.latex_text(F.col("kind"), F.col("text")))
    body = R.in_order(["path"], good, ["page", "block_index"], piece, "\n\n", "body")
    head = "\\documentclass{article}\n\\usepackage{longtable}\n\\begin{document}\n\n"
    return body.select("path", F.concat(F.lit(head), F.col("body"), F.lit("\n\n\\end{document}\n")).alias("latex"))


def to_json(blocks: DataFrame) -> DataFrame:
    """(path, json): the nested document, absent values left out."""
    cols = [c for c in ("page", "block_index", "kind", "text", "bbox", "confidence", "headers", "rows") if c in blocks.columns]
    got = blocks.where("ok and kind is not null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("blocks"))
    return got.select("path", R.to_json(F.struct("path", "blocks")).alias("json"))
