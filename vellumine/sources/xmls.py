"""HTML and XML sources: OCR dialects and object annotations by their tags, else visible text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from ..functions.text import BLOCK_TAGS, ENTITIES, HIDDEN_TAGS
from .blocks import Block, around, corners, paragraphs, squeeze

_HIDDEN = re.compile(r"(?is)" + "|".join(rf"<{t}[>/\s].*?</{t}>|<{t}[>/\s](?!.*?</{t}>).*" for t in HIDDEN_TAGS))
_BLOCK = re.compile(r"(?i)</?(" + "|".join(sorted(BLOCK_TAGS, key=len, reverse=True)) + r")(\s[^>]*)?/?>")


_ENTITY = re.compile("&#[xX]([0-9a-fA-F]{1,8});|&#([0-9]{1,10});|" + "|".join(name for name, _ in ENTITIES))


def decode_entities(text: str) -> str:
    """As functions.text.decode_entities: all numeric entities and six named ones, each once."""

    def one(m: re.Match) -> str:
        if not (m[1] or m[2]):
            return dict(ENTITIES)[m[0]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0xD800 or 0xE000 <= code < 0x110000 else m[0]

    return _ENTITY.sub(one, text)


def visible(source: str) -> list[Block]:
    """Block tags part paragraphs, other tags vanish."""
    text = re.sub(r"<[^>]*>", "", _BLOCK.sub("\n\n", re.sub(r"\s+", " ", _HIDDEN.sub("", source))))
    return paragraphs(decode_entities(text))


class _Hocr(HTMLParser):
    """Lines and words of the first page, with what their titles say."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.pages = [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        self.pages += "ocr_page" in kinds
        kind = "line" if {"ocr_line", "ocrx_line"} & set(kinds) else "word" if "ocrx_word" in kinds else ""
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.stack.append((tag, kind))
        if self.pages > 1 or not kind:
            return
        title = a.get("title") or ""
        box = re.search(r"bbox\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", title)
        sure = re.search(r"x_wconf\s+([\d.]+)", title)
        if kind == "line" or not any(k == "line" for _, k in self.stack):
            self.lines.append({"text": [], "box": corners(box.groups()) if box else None, "sure": []})
        if sure and self.lines:
            self.lines[-1]["sure"].append(float(sure[1]) / 100)

    def handle_endtag(self, tag):
        while self.stack:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if self.pages <= 1 and self.lines and any(k for _, k in self.stack):
            self.lines[-1]["text"].append(data)


def hocr(source: str) -> list[Block] | None:
    if "ocr_page" not in source:
        return None
    p = _Hocr()
    p.feed(source)
    out = [Block("ocr_line", squeeze("".join(x["text"])), box=x["box"], confidence=sum(x["sure"]) / len(x["sure"]) if x["sure"] else 0.9) for x in p.lines]
    return [b for b in out if b.text] or None


def html(source: str) -> list[Block]:
    return hocr(source) or visible(source)


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def named(e: ET.Element, *names: str):
    return [x for x in e.iter() if local(x) in names]


def parsed(source: str) -> ET.Element | None:
    """The root, or None; documents that declare entities are not parsed."""
    if re.search(r"(?i)<!ENTITY", source):
        return None
    try:
        return ET.fromstring(source.encode())
    except ET.ParseError:
        return None


def alto(root: ET.Element) -> list[Block]:
    page = next(iter(named(root, "Page")), root)
    out = []
    for line in named(page, "TextLine"):
        words = [w for w in named(line, "String") if (w.get("CONTENT") or "").strip()]
        box = lambda e: (float(e.get("HPOS")), float(e.get("VPOS")), float(e.get("WIDTH")), float(e.get("HEIGHT"))) if e.get("HPOS") and e.get("WIDTH") else None
        sure = [float(w.get("WC")) for w in words if w.get("WC")]
        if words:
            out.append(Block("ocr_line", squeeze(" ".join(w.get("CONTENT") for w in words)), box=box(line) or around([box(w) for w in words]), confidence=sum(sure) / len(sure) if sure else 0.9))
    return out


def page_xml(root: ET.Element) -> list[Block]:
    out = []
    for line in named(root, "TextLine"):
        words = [w for w in line if local(w) == "Word"] or [line]
        texts, sure, boxes = [], [], []
        for w in words:
            found = [u.text for t in w if local(t) == "TextEquiv" for u in named(t, "Unicode") if u.text]
            texts += found[-1:]
            sure += [float(t.get("conf")) for t in w if local(t) == "TextEquiv" and t.get("conf")]
            boxes += [points(c) for c in w if local(c) == "Coords"]
        own = next((points(c) for c in line if local(c) == "Coords"), None)
        if texts:
            out.append(Block("ocr_line", squeeze(" ".join(texts)), box=own or around(boxes), confidence=sum(sure) / len(sure) if sure else 0.9))
    return out


def points(coords: ET.Element):
    return corners(re.findall(r"-?\d+(?:\.\d+)?", coords.get("points") or ""))


def objects(root: ET.Element) -> list[Block]:
    """Named objects with corner boxes."""
    out = []
    for o in named(root, "object"):
        get = lambda tag: next((x.text for x in named(o, tag) if x.text), None)
        edges = [get(t) for t in ("xmin", "ymin", "xmax", "ymax")]
        if get("name") and None not in edges:
            out.append(Block(squeeze(get("name")), squeeze(get("name")), box=corners(edges)))
    return out


def xml(source: str) -> list[Block]:
    root = parsed(source)
    if root is not None:
        for probe, mark in ((page_xml, "PcGts"), (alto, "alto"), (objects, "annotation")):
            if local(root).lower() == mark.lower() and (got := probe(root)):
                return got
    return hocr(source) or visible(source)
