"""What every decoder returns: blocks in reading order, and the row schema they are stored in."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA = (
    "path string, ok boolean, error string, format string, page int, block_index int, kind string, text string, "
    "bbox struct<x:double,y:double,width:double,height:double>, confidence double, headers array<string>, rows array<array<string>>"
)
Box = tuple[float, float, float, float]  # x, y, width, height


@dataclass
class Block:
    kind: str
    text: str = ""
    page: int = 1
    box: Box | None = None
    confidence: float = 0.9
    grid: list[list[str]] = field(default_factory=list)  # header row first


def squeeze(text: str) -> str:
    return " ".join(text.split())


def paragraphs(text: str, page: int = 1, kind: str = "paragraph") -> list[Block]:
    """Runs of lines that aren't blank, joined by a space."""
    out, lines = [], []
    for line in [*text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), ""]:
        if line.strip():
            lines.append(line)
        elif lines:
            out.append(Block(kind, squeeze(" ".join(lines)), page))
            lines = []
    return out


def corners(values) -> Box | None:
    """The box around points given as x0, y0, x1, y1, ...; None unless it has an area."""
    xs, ys = [float(v) for v in values[0::2]], [float(v) for v in values[1::2]]
    if len(xs) < 2 or len(ys) < 2:
        return None
    x, y = min(xs), min(ys)
    w, h = max(xs) - x, max(ys) - y
    return (x, y, w, h) if w > 0 and h > 0 else None


def around(boxes) -> Box | None:
    boxes = [b for b in boxes if b]
    if not boxes:
        return None
    return corners([v for x, y, w, h in boxes for v in (x, y, x + w, y + h)])


def by_place(blocks: list[Block]) -> list[Block]:
    """Sorted by y, then x; blocks without a box stay behind, in their order."""
    return sorted(blocks, key=lambda b: (b.page, b.box is None, b.box[1] if b.box else 0, b.box[0] if b.box else 0))
