"""Office files, archives and images. Archives hand their members back to the decoder of their format."""

from __future__ import annotations

import gzip
import io
import re
import struct
import tarfile
import zipfile
import xml.etree.ElementTree as ET

from .blocks import Block, squeeze
from .xmls import local, named, parsed

#: Bytes that a member may expand to; larger ones are an error of that file.
MOST = 256 << 20


def members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if sum(i.file_size for i in infos) > MOST:
            raise ValueError("archive expands beyond the limit")
        return {i.filename: z.read(i) for i in infos}


def gunzip(content: bytes) -> bytes:
    with gzip.open(io.BytesIO(content)) as f:
        out = f.read(MOST + 1)
    if len(out) > MOST:
        raise ValueError("file expands beyond the limit")
    return out


def _root(files: dict[str, bytes], name: str) -> ET.Element:
    root = parsed(files[name].decode("utf-8", "replace")) if name in files else None
    if root is None:
        raise ValueError(f"{name} is missing or no XML")
    return root


def _texts(e: ET.Element, *names: str) -> str:
    return squeeze("".join(x.text or "" for x in named(e, *names)))


def docx(content: bytes) -> list[Block]:
    return [Block("paragraph", t) for p in named(_root(members(content), "word/document.xml"), "p") if (t := _texts(p, "t"))]


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name.rpartition("/")[2]) or 0)


def pptx(content: bytes) -> list[Block]:
    files = members(content)
    slides = sorted((n for n in files if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    return [Block("paragraph", t, k) for k, n in enumerate(slides, 1) for p in named(_root(files, n), "p") if (t := _texts(p, "t"))]


def xlsx(content: bytes) -> list[Block]:
    """A row's cells in their columns, joined by a space; sheets by number, strings by index or inline."""
    files = members(content)
    shared = [_texts(s, "t") for s in named(_root(files, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in files else []
    out = []
    for k, name in enumerate(sorted((n for n in files if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number), 1):
        for row in named(_root(files, name), "row"):
            cells = []
            for c in (x for x in row if local(x) == "c"):
                v = next((x.text or "" for x in c if local(x) == "v"), "")
                cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else _texts(c, "t") if c.get("t") == "inlineStr" else v)
            if any(cells):
                out.append(Block("row", squeeze(" ".join(cells)), k))
    return out


def opendocument(content: bytes) -> list[Block]:
    """Table rows if there are any, else paragraphs and headings."""
    root = _root(members(content), "content.xml")
    whole = lambda e: squeeze("".join(e.itertext()))
    rows = [" ".join(filter(None, (whole(c) for c in named(r, "table-cell")))) for r in named(root, "table-row")]
    return [Block("row", r) for r in rows if r] or [Block("paragraph", t) for p in named(root, "p", "h") if (t := whole(p))]


def archive(content: bytes, decode) -> list[Block]:
    """Members that have a decoder, a page each; JSON first, then XML, then text. A lone gzip: its payload."""
    if content[:2] == b"\x1f\x8b":
        content = gunzip(content)
    if content[:2] == b"PK":
        files = list(members(content).items())
    elif tarfile.is_tarfile(io.BytesIO(content)):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            infos = [m for m in t.getmembers() if m.isfile()]
            if sum(m.size for m in infos) > MOST:
                raise ValueError("archive expands beyond the limit")
            files = [(m.name, t.extractfile(m).read()) for m in infos]
    elif b"\0" in content:
        raise ValueError("no archive, and no text")
    else:
        files = [("payload.txt", content)]
    rank = lambda n: 0 if re.search(r"\.jsonl?$", n) else 1 if re.search(r"\.n?xml$", n) else 2
    out, page = [], 0
    for name, body in sorted(files, key=lambda f: rank(f[0].lower())):
        if blocks := decode(name, body):
            for b in blocks:
                b.page += page
            page = max(b.page for b in blocks)
            out += blocks
    return out


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from a file's head."""
    b = content
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b[:4] == b"GIF8" and len(b) >= 10:
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return abs(w), abs(h)
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                at += 1
                continue
            code = b[at + 1]
            if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return w, h
            at += 1 if code == 0xFF else 2 if code == 1 or 0xD0 <= code <= 0xD8 else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    if b[:4] in (b"II*\0", b"MM\0*") and len(b) >= 8:
        e = "<" if b[:1] == b"I" else ">"
        (at,) = struct.unpack_from(e + "I", b, 4)
        found = {}
        for k in range(struct.unpack_from(e + "H", b, at)[0] if at + 2 <= len(b) else 0):
            if at + 14 + 12 * k > len(b):
                break
            tag, kind = struct.unpack_from(e + "HH", b, at + 2 + 12 * k)
            if tag in (256, 257):
                found[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), b, at + 10 + 12 * k)[0]
        if len(found) == 2:
            return found[256], found[257]
    if b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8X" and len(b) >= 30:
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    return None


def image(content: bytes) -> list[Block]:
    size = image_size(content)
    if size is None:
        raise ValueError("image dimensions not found")
    return [Block("figure", box=(0.0, 0.0, float(size[0]), float(size[1])))]
