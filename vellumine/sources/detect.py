"""Formats by path: one CASE over a pattern, so that it runs beside a listing without reading content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {
    "text": ("txt", "text", "log"), "markdown": ("md", "markdown"), "latex": ("tex", "latex", "ltx"), "pdf": ("pdf",), "docx": ("docx",), "xlsx": ("xlsx",), "pptx": ("pptx",),
    "opendocument": ("odt", "ods", "odp"), "html": ("html", "htm", "xhtml", "hocr"), "xml": ("xml", "nxml", "alto", "page"), "email": ("eml",), "json": ("json", "jsonl", "ndjson"),
    "csv": ("csv", "tsv"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"), "archive": ("zip", "tar", "tgz"), "planned": ("doc", "xls", "ppt", "msg"),
}
#: Formats that show through a trailing .gz
TEXT_LIKE = ("text", "markdown", "latex", "html", "xml", "json", "csv")


def _by_extension(ext: Column, names) -> Column:
    got = F.when(F.lit(False), F.lit(""))
    for name in names:
        got = got.when(ext.isin(*FORMATS[name]), F.lit(name))
    return got


def detect_format(path: Column) -> Column:
    """Name of a path's format; null if unknown."""
    low = F.lower(path)
    ext = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)
    inner = F.regexp_extract(low, r"\.([a-z0-9]+)\.gz$", 1)
    return F.when(ext == "gz", F.coalesce(_by_extension(inner, TEXT_LIKE), F.lit("archive"))).otherwise(_by_extension(ext, FORMATS))


def support_status(fmt: Column) -> Column:
    return F.when(fmt.isNull(), F.lit("unknown")).when(fmt == "planned", F.lit("planned")).otherwise(F.lit("supported"))


def hidden_sidecar(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"(^|/)(\._[^/]*|\.DS_Store|__MACOSX/.*)$"))
