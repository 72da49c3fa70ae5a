"""Files to blocks. Each file gives at least one row: its blocks, or one row that says what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..workers import reachable
from . import containers, jsons, markup, tabular, xmls
from .blocks import SCHEMA, Block
from .detect import FORMATS, TEXT_LIKE, hidden_sidecar
from .pdf import pages_of, pdf

#: Rows that a batch holds at most, and bytes of contents that are Python objects together.
ROWS = 4096
BYTES = 16 << 20


def text_of(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: Format to decoder (path, content) -> blocks; register() adds to them.
DECODERS: dict[str, Callable[[str, bytes], list[Block]]] = {
    "text": lambda p, c: markup.plain(text_of(c)),
    "markdown": lambda p, c: markup.markdown(text_of(c)) or markup.paragraphs(text_of(c)),
    "latex": lambda p, c: markup.latex(text_of(c)) or markup.paragraphs(text_of(c)),
    "email": lambda p, c: markup.email(text_of(c)),
    "csv": lambda p, c: tabular.delimited(text_of(c), "\t" if ".tsv" in p.lower() else ","),
    "json": lambda p, c: jsons.decode(text_of(c)),
    "html": lambda p, c: xmls.html(text_of(c)),
    "xml": lambda p, c: xmls.xml(text_of(c)),
    "docx": lambda p, c: containers.docx(c),
    "xlsx": lambda p, c: containers.xlsx(c),
    "pptx": lambda p, c: containers.pptx(c),
    "opendocument": lambda p, c: containers.opendocument(c),
    "image": lambda p, c: containers.image(c),
    "pdf": lambda p, c: pdf(c),
    "archive": lambda p, c: containers.archive(c, member),
}


#: What register() has added: sent along with every extraction, since workers import their own copy.
ADDED: dict[str, tuple[Callable[[str, bytes], list[Block]], tuple[str, ...]]] = {}


def register(name: str, decoder: Callable[[str, bytes], list[Block]], *extensions: str) -> None:
    """Add a format, or put another decoder in the place of one. Holds for extractions made from now on."""
    ADDED[name] = (decoder, extensions)
    install({name: ADDED[name]})


def install(added: dict) -> None:
    for name, (decoder, extensions) in added.items():
        DECODERS[name] = decoder
        if extensions:
            FORMATS[name] = extensions


def format_of(path: str) -> str | None:
    """What detect_format() says of a path, for members of archives."""
    low = path.lower()
    ext = low.rpartition(".")[2]
    if ext == "gz":
        inner = low[:-3].rpartition(".")[2]
        return next((n for n in TEXT_LIKE if inner in FORMATS[n]), "archive")
    return next((n for n, e in FORMATS.items() if ext in e), None)


def member(path: str, content: bytes) -> list[Block]:
    kind = format_of(path)
    return DECODERS[kind](path, content) if kind in DECODERS and kind != "archive" else []


def decode(path: str, content: bytes, kind: str | None = None) -> tuple[str | None, list[Block]]:
    kind = kind or format_of(path)
    if kind is None:
        raise ValueError("unknown format")
    if kind not in DECODERS:
        raise ValueError("format is planned, not supported")
    if kind != "archive" and content[:2] == b"\x1f\x8b":
        content = containers.gunzip(content)
    return kind, DECODERS[kind](path, content)


def _record(path, kind, k, b: Block) -> dict:
    box = None if b.box is None else dict(zip(("x", "y", "width", "height"), map(float, b.box)))
    head, rows = (b.grid[0], b.grid[1:]) if b.grid else (None, None)
    return {"path": path, "ok": True, "error": None, "format": kind, "page": b.page, "block_index": k, "kind": b.kind, "text": b.text, "bbox": box, "confidence": float(b.confidence), "headers": head, "rows": rows}


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose contents have BYTES together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def each_file(files: DataFrame, schema: str, rows_of: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """What a function gives for each row of (path, content), whose other columns are ignored. A null or broken
    file gives a row with ok = false and the error."""
    arrow, added = to_arrow_schema(StructType.fromDDL(schema)), dict(ADDED)

    def run(batches):
        install(added)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if content is None or path is None:
                        raise ValueError("no content")
                    got = rows_of(path, content)
                except Exception as e:  # of this file alone
                    got = [{"path": path, "ok": False, "error": f"{type(e).__name__}: {e}"[:500]}]
                rows += got
                while len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows[:ROWS], schema=arrow)
                    rows = rows[ROWS:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return reachable(files).select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def blocks_of(path: str, content: bytes) -> list[dict]:
    kind, blocks = decode(path, content)
    return [_record(path, kind, k, b) for k, b in enumerate(blocks)] or [{"path": path, "ok": True, "format": kind}]


def extract(files: DataFrame) -> DataFrame:
    """Blocks of each row of (path, content); other columns are ignored. A file without any text gives one
    row without a block; a null or broken one, a row with ok = false and the error. Nothing else fails."""
    return each_file(files, SCHEMA, blocks_of)


SPANS = (
    "path string, ok boolean, error string, page int, width double, height double, rotation int, span_index int, text string, "
    "bbox struct<x:double,y:double,width:double,height:double>, size double, bold boolean"
)


def spans_of(path: str, content: bytes) -> list[dict]:
    out = []
    for p in pages_of(content):
        page = {"path": path, "ok": True, "error": None, "page": p.number, "width": p.width, "height": p.height, "rotation": p.rotation}
        box = lambda r: {"x": r.x, "y": r.y - 0.25 * r.size, "width": r.width, "height": r.size}
        out += [page | {"span_index": k, "text": r.text, "bbox": box(r), "size": r.size, "bold": r.bold} for k, r in enumerate(p.runs)] or [page]
    return out


def pdf_spans(files: DataFrame) -> DataFrame:
    """The text layer of PDF files (path, content): a row a span with its page's size, y up from the bottom of the
    page as shown, boxes from a quarter of the type size below the baseline. A page without text is a row without a
    span; a null or broken file, a row with ok = false."""
    return each_file(files, SPANS, spans_of)


def list_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files below a folder, without sidecars; Spark's scan leaves out files of no bytes. Content is read only
    if it is asked for."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).where(~hidden_sidecar(F.col("path")))
