"""Blocks to Markdown, LaTeX, HTML tables and JSON: Column expressions and one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FURNITURE = ("page_header", "header", "page_footer", "footer")
SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")


def heading_level(kind: Column) -> Column:
    """1 to 6 of heading_1 to heading_6; anything else is no heading."""
    return F.regexp_extract(kind, r"^heading_\+?0*([1-6])$", 1).try_cast("int")


def markdown_figure(alt: Column, caption: Column, ref: Column) -> Column:
    """An image, with its caption below unless that is the alternative text."""
    shown = F.coalesce(alt, caption, ref, F.lit("image"))
    image = F.concat(F.lit("!["), F.translate(T.sanitize_markdown(shown), "[]", ""), F.lit("]("), F.coalesce(ref, F.lit("#image")), F.lit(")"))
    below = T.sanitize_markdown(caption)
    return F.when((below != "") & (below != shown), F.concat(image, F.lit("\n\n"), below)).otherwise(image)


def latex_figure(alt: Column, caption: Column, ref: Column) -> Column:
    return F.concat(F.lit("[Image: "), T.escape_latex(F.coalesce(caption, alt, ref, F.lit("image"))), F.lit("]"))


def paragraphs_to_markdown(parts: Column) -> Column:
    """Paragraphs of one document that are still together: no block leaves its row."""
    return F.array_join(F.transform(parts, T.sanitize_markdown), "\n\n")


def markdown_text(kind: Column, text: Column) -> Column:
    level = heading_level(kind)
    items = F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), lambda s: F.concat(F.lit("- "), T.sanitize_markdown(F.trim(s))))
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), T.sanitize_markdown(text))).when(kind == "list", F.array_join(items, "\n")).otherwise(T.sanitize_markdown(text))


def latex_text(kind: Column, text: Column) -> Column:
    level = heading_level(kind)
    command = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.coalesce(level, F.lit(1)))
    return F.when(level.isNotNull(), F.concat(F.lit("\\"), command, F.lit("{"), T.escape_latex(text), F.lit("}"))).otherwise(T.escape_latex(text))


def in_order(key: list[str], blocks: DataFrame, order: list[str], piece: Column, between: str, name: str) -> DataFrame:
    """Pieces of each key joined in order."""
    got = blocks.select(*key, F.struct(*order, piece.alias("piece")).alias("p")).groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return got.select(*key, F.array_join(F.transform("ps", lambda p: p["piece"]), between).alias(name))


def to_markdown(blocks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One Markdown text a document; running headers and footers are left out."""
    shown = blocks.where(~F.col("kind").isin(*FURNITURE))
    return in_order(key, shown, order, markdown_text(F.col("kind"), F.col("text")), "\n\n", "markdown")


def to_latex(blocks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    body = in_order(key, blocks, order, latex_text(F.col("kind"), F.col("text")), "\n\n", "body")
    head = "\\documentclass{article}\n\\usepackage{longtable}\n\\begin{document}\n\n"
    return body.select(*key, F.concat(F.lit(head), F.col("body"), F.lit("\n\n\\end{document}\n")).alias("latex"))


def escape_html(text: Column) -> Column:
    for char, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(out))
    return text


def pipe_table(headers: Column, rows: Column) -> Column:
    """A Markdown table; columns as wide as their widest cell, three at least."""
    grid = F.concat(F.array(headers), rows)
    n = F.array_max(F.transform(grid, F.size))
    cell = lambda r, j: F.replace(F.coalesce(F.try_element_at(r, j), F.lit("")), F.lit("|"), F.lit("\\|"))
    wide = F.transform(F.sequence(F.lit(1), n), lambda j: F.greatest(F.lit(3), F.array_max(F.transform(grid, lambda r: F.length(cell(r, j))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(wide, lambda w, k: F.rpad(cell(r, k + 1), w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(wide, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def html_table(headers: Column, rows: Column) -> Column:
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), line(headers, "th"), F.array_join(F.transform(rows, lambda r: line(r, "td")), ""), F.lit("</table>"))


def latex_table(headers: Column, rows: Column) -> Column:
    """tabular, or longtable above 24 rows; right-aligned where at least half of the filled cells are numeric."""
    column = lambda j: F.filter(F.transform(rows, lambda r: F.trim(F.coalesce(F.try_element_at(r, j), F.lit("")))), lambda c: c != "")
    align = F.array_join(F.transform(F.sequence(F.lit(1), F.size(headers)), lambda j: F.when((F.size(column(j)) > 0) & (F.size(F.filter(column(j), T.is_numeric_value)) * 2 >= F.size(column(j))), "r").otherwise("l")), "")
    line = lambda r: F.concat(F.array_join(F.transform(r, T.escape_latex), " & "), F.lit(" \\\\"))
    name = F.when(F.size(rows) > 24, "longtable").otherwise("tabular")
    return F.concat(F.lit("\\begin{"), name, F.lit("}{"), align, F.lit("}\n\\hline\n"), line(headers), F.lit("\n\\hline\n"), F.array_join(F.transform(rows, line), "\n"), F.lit("\n\\hline\n\\end{"), name, F.lit("}"))


def to_json(document: Column) -> Column:
    """Pretty JSON; absent values are omitted."""
    return F.to_json(document, {"pretty": "true"})
