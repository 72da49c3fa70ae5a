"""CSV and TSV sources: plain rows, OCR boxes and OCR word tables. Cells are split naively, never quoted."""

from __future__ import annotations

import re

from .blocks import Block, around, corners, squeeze

#: Columns of an OCR word table.
WORD_TABLE = "level page_num block_num par_num line_num word_num left top width height conf text".split()


def number(cell: str) -> float | None:
    try:
        value = float(cell)
    except ValueError:
        return None
    return value if value - value == 0 else None


def ocr_boxes(lines: list[str], sep: str) -> list[Block] | None:
    """Eight coordinates and a text a line, the text's own separators kept."""
    out = []
    for line in lines:
        cells = line.split(sep)
        points = [number(c) for c in cells[:8]]
        if len(cells) < 9 or None in points:
            return None
        text = squeeze((", " if sep == "," else sep).join(c.strip() for c in cells[8:]))
        if text:
            out.append(Block("ocr_line", text, box=corners(points)))
    return out or None


def word_table(lines: list[str], sep: str) -> list[Block] | None:
    """Words (level 5) of an OCR engine's table, joined by line; the mean of known confidences."""
    head = [c.strip() for c in lines[0].split(sep)]
    if any(c not in head for c in WORD_TABLE):
        return None
    groups: dict[tuple, list] = {}
    for line in lines[1:]:
        cells = line.split(sep)
        if len(cells) < len(head):
            continue
        row = dict(zip(head, cells))
        if row["level"].strip() == "5" and row["text"].strip():
            groups.setdefault(tuple(row[c] for c in ("page_num", "block_num", "par_num", "line_num")), []).append(row)
    out = []
    for key, words in groups.items():
        sure = [c / 100 if c > 1 else c for c in (number(w["conf"]) for w in words) if c is not None and c >= 0]
        boxes = []
        for w in words:
            x, y, width, height = (number(w[c]) or 0.0 for c in ("left", "top", "width", "height"))
            boxes.append((x, y, width, height))
        out.append(Block("ocr_line", squeeze(" ".join(w["text"] for w in words)), int(number(key[0]) or 1), around(boxes), sum(sure) / len(sure) if sure else 0.9))
    return out


def feature_table(lines: list[str], sep: str) -> list[Block] | None:
    """Features of a layout ground truth: kind, boxes as (page;[x0;y0;x1;y1]), and a text that may hold
    separators. A feature lies on the page of its first box, within the box around all of them."""
    head = [c.strip().lower() for c in lines[0].split(sep)]
    if sep != "\t" or any(c not in head for c in ("feature", "bounding boxes", "text")):
        return None
    kind, boxes, text = (head.index(c) for c in ("feature", "bounding boxes", "text"))
    out = []
    for line in lines[1:]:
        cells = line.split(sep)
        words = squeeze(" ".join(cells[text:]))
        if len(cells) <= max(kind, boxes, text) or not words:
            continue
        found = []
        for page, inside in re.findall(r"([0-9]+);\[([^\]]*)\]", cells[boxes]):
            values = [number(v) for v in inside.split(";")]
            if len(values) == 4 and None not in values and values[2] > values[0] and values[3] > values[1]:
                found.append((max(1, int(page)), corners(values)))
        out.append(Block(squeeze(cells[kind]) or "row", words, found[0][0] if found else 1, around(b for _, b in found)))
    return out or None


def delimited(text: str, sep: str) -> list[Block]:
    """Filled cells of each row joined by a space; the header is a row like any other."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return []
    for probe in (word_table, feature_table, ocr_boxes):
        if (got := probe(lines, sep)) is not None:
            return got
    rows = [" ".join(filter(None, (squeeze(c).strip("\"'") for c in line.split(sep)))) for line in lines]
    return [Block("row", r) for r in rows if r]
