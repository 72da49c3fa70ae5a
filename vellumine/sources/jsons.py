"""JSON sources: annotation dialects by their marks, else all text in preferred keys."""

from __future__ import annotations

import json
import re
from collections import defaultdict

from .blocks import Block, around, by_place, corners, paragraphs, squeeze

#: Keys that hold text, in the order they are looked for; keys that hold none.
TEXT_KEYS = "title abstract text content body paragraph sentence caption markdown latex html value".split()
SILENT_KEYS = {"id", "bbox", "box", "poly", "type", "url", "path", "file_name", "metadata"}
BOX_KEYS = "bbox box bounding_box boundingBox rect position poly".split()


def box_of(item: dict):
    for key in BOX_KEYS:
        v = item.get(key)
        if isinstance(v, list) and len(v) >= 4 and all(isinstance(x, (int, float)) for x in v):
            return corners(v)
        if isinstance(v, dict):
            if {"x", "y", "width", "height"} <= set(v):
                return (float(v["x"]), float(v["y"]), float(v["width"]), float(v["height"]))
            if {"x0", "y0", "x1", "y1"} <= set(v):
                return corners([v["x0"], v["y0"], v["x1"], v["y1"]])
            if {"left", "top", "right", "bottom"} <= set(v):
                return corners([v["left"], v["top"], v["right"], v["bottom"]])
    return None


def scalar(value) -> str:
    return squeeze(str(value)) if isinstance(value, (str, int, float)) and not isinstance(value, bool) else str(value).lower() if isinstance(value, bool) else ""


def html_grid(html: str) -> list[list[str]]:
    rows = re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html)
    return [[squeeze(re.sub(r"<[^>]*>", " ", c)) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in rows]


def coco(data) -> list[Block] | None:
    """Images joined to their annotations, these to their categories (default: layout)."""
    if not isinstance(data, dict) or not {"images", "annotations"} <= set(data):
        return None
    names = {str(c.get("id")): str(c.get("name", "layout")) for c in data.get("categories") or []}
    of = defaultdict(list)
    for a in data["annotations"]:
        of[str(a.get("image_id"))].append(a)
    out = []
    for page, image in enumerate(data["images"], 1):
        for a in of[str(image.get("id"))]:
            b = a.get("bbox") or []
            box = tuple(map(float, b[:4])) if len(b) >= 4 else None  # x, y, width, height
            out.append(Block(names.get(str(a.get("category_id")), "layout"), scalar(a.get("text", "")), page, box))
    return by_place(out)


def forms(data) -> list[Block] | None:
    if not isinstance(data, dict) or not isinstance(data.get("form"), list):
        return None
    return by_place([Block(str(f.get("label") or "field"), scalar(f.get("text", "")), box=box_of(f)) for f in data["form"] if scalar(f.get("text", ""))])


def layout_dets(data) -> list[Block] | None:
    """Pages with layout_dets: ignored ones left out, by their order (none: last)."""
    pages = data if isinstance(data, list) else [data]
    if not pages or not all(isinstance(p, dict) and "layout_dets" in p for p in pages):
        return None
    out = []
    for n, page in enumerate(pages, 1):
        dets = [d for d in page["layout_dets"] if not d.get("ignore")]
        for d in sorted(dets, key=lambda d: float("inf") if d.get("order") is None else d["order"]):
            kind = str(d.get("category_type", "text"))
            grid = html_grid(d["html"]) if kind == "table" and d.get("html") else []
            text = "" if grid else squeeze(str(d.get("text") or d.get("latex") or ""))
            if text or grid or kind in ("figure", "chart_mask"):
                out.append(Block("figure" if kind == "chart_mask" else kind, text, n, box_of(d), grid=grid))
    return out


def structure_tokens(data) -> list[Block] | None:
    """Table structure tokens zipped with cells: a row begins at <tr>, each cell's tag takes the next cell."""
    html = data.get("html") if isinstance(data, dict) else None
    if not isinstance(html, dict) or "structure" not in html:
        return None
    cells = iter(html.get("cell") or html.get("cells") or [])
    grid: list[list[str]] = []
    for token in html["structure"].get("tokens", []):
        if token == "<tr>":
            grid.append([])
        elif token.startswith("<td") and grid:
            cell = next(cells, {})
            grid[-1].append(squeeze(re.sub(r"<[^>]*>", "", "".join(cell.get("tokens", [])))))
    return [Block("table", grid=[r for r in grid if r])]


def words(data) -> list[Block] | None:
    items = data.get("words") if isinstance(data, dict) else None
    if not isinstance(items, list) or not all(isinstance(w, dict) for w in items):
        return None
    return by_place([Block("word", scalar(w.get("text", w.get("word", ""))), box=box_of(w)) for w in items])


def cell_grid(data) -> list[Block] | None:
    rows = data.get("cells") if isinstance(data, dict) else None
    if not isinstance(rows, list) or not rows or not all(isinstance(r, list) for r in rows):
        return None
    text = lambda c: scalar(c.get("text", "")) if isinstance(c, dict) else scalar(c)
    box = box_of({"bbox": data.get("table_bbox")}) or around([box_of(c) for r in rows for c in r if isinstance(c, dict)])
    return [Block("table", box=box, grid=[[text(c) for c in r] for r in rows])]


def generic(data, key: str = "text") -> list[Block]:
    """Texts under preferred keys in their order, else under all others, sorted; depth first."""
    if isinstance(data, dict):
        keys = [k for k in TEXT_KEYS if k in data]
        rest = sorted(k for k in data if k not in TEXT_KEYS and k not in SILENT_KEYS and isinstance(data[k], (dict, list)))
        if not keys and not rest:
            rest = sorted(k for k in data if k not in SILENT_KEYS)
        return [b for k in [*keys, *rest] for b in generic(data[k], k)]
    if isinstance(data, list):
        return [b for x in data for b in generic(x, key)]
    if isinstance(data, str):
        return [Block(key, p.text) for p in paragraphs(data)]
    return [Block(key, scalar(data))] if data is not None else []


DIALECTS = (layout_dets, forms, coco, structure_tokens, words, cell_grid)


def one(data) -> list[Block]:
    for probe in DIALECTS:
        if (got := probe(data)) is not None:
            return got
    return generic(data)


def decode(text: str) -> list[Block]:
    """A whole document, else one value a line: a page each, numbered by line."""
    try:
        return one(json.loads(text))
    except ValueError:
        pass
    out = []
    for n, line in enumerate(text.splitlines()):
        if line.strip():
            for b in one(json.loads(line)):
                b.page += n
                out.append(b)
    return out
