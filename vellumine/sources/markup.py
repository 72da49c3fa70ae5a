"""Plain text, Markdown, LaTeX, token-label and e-mail sources to blocks."""

from __future__ import annotations

import re

from .blocks import Block, around, paragraphs, squeeze

# The labels of the token-label format.
TOKEN_LABELS = "abstract author caption date equation figure footer list paragraph reference section table title".split()


def token_labels(text: str) -> list[Block] | None:
    """Ten tab-separated cells a line: token, x0, y0, x1, y1, three colours, font, label. Consecutive
    tokens of one label on one line are a block. None unless every line is of this kind."""
    rows = []
    for line in filter(str.strip, text.splitlines()):
        cells = line.split("\t")
        try:
            x0, y0, x1, y1 = map(float, cells[1:5])
        except ValueError:
            return None
        if len(cells) < 10 or cells[9].strip() not in TOKEN_LABELS or x1 <= x0 or y1 <= y0:
            return None
        rows.append((cells[9].strip(), cells[0], (x0, y0, x1 - x0, y1 - y0)))
    out: list[Block] = []
    for label, word, box in rows:
        last = out[-1] if out else None
        if last and last.kind == label and abs(box[1] - last.box[1]) <= max(last.box[3], 3):
            last.text, last.box = f"{last.text} {word}", around([last.box, box])
        else:
            out.append(Block(label, word, box=box))
    return out or None


LIST_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s+(.*)")
HEADING = re.compile(r"\s*(#{1,6})\s+(.*?)\s*#*\s*$")
RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def pipe_cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [squeeze(c.replace("\\|", "|")).strip("`") for c in re.split(r"(?<!\\)\|", line)]


def markdown(text: str) -> list[Block] | None:
    """Headings, pipe tables, lists and paragraphs; None if nothing of Markdown is in it."""
    lines, out, held, k, seen = text.splitlines(), [], [], 0, False

    def flush():
        if held:
            out.append(Block("paragraph", squeeze(" ".join(held))))
            held.clear()

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            flush()
        elif m := HEADING.match(line):
            flush()
            seen = True
            out.append(Block(f"heading_{len(m[1])}", squeeze(m[2])))
        elif "|" in line and k + 1 < len(lines) and "|" in lines[k + 1] and RULE.match(lines[k + 1]):
            flush()
            seen, grid, k = True, [pipe_cells(line)], k + 2
            while k < len(lines) and "|" in lines[k]:
                grid.append(pipe_cells(lines[k]))
                k += 1
            out.append(Block("table", grid=grid))
            continue
        elif m := LIST_ITEM.match(line):
            flush()
            seen, items = True, []
            while k < len(lines) and (m := LIST_ITEM.match(lines[k])):
                items.append(squeeze(m[1]))
                k += 1
            out.append(Block("list", "\n".join(items)))
            continue
        else:
            held.append(line)
        k += 1
    flush()
    return out if seen else None


SECTION_LEVELS = {"title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
STRUCTURE = re.compile(r"\\(title|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*\{|\\begin\{(abstract|itemize|enumerate|table\*?|tabular\*?|longtable)\}")


def braced(text: str, at: int) -> tuple[str, int]:
    """(inside, place after) of the group whose opening brace stands at `at`; the rest if unclosed."""
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 1
        elif text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth -= 1
            if not depth:
                return text[at + 1 : k], k + 1
        k += 1
    return text[at + 1 :], len(text)


def latex_inline(text: str) -> str:
    """Commands unwrapped, references and labels dropped, ties as blanks."""
    text = re.sub(r"\\(?:ref|eqref|cite[a-z]*|label|pageref)\*?(?:\[[^\]]*\])?\{[^}]*\}", "", text)
    text = re.sub(r"\\href\{[^}]*\}", "", text)
    text = re.sub(r"\\multicolumn\{[^}]*\}\{[^}]*\}", "", text)
    text = text.replace("\\\\", " ")
    text = re.sub(r"\\([%&$#_{}])", lambda m: chr(0xE000 + ord(m[1])), text)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"[{}$]", "", text).replace("~", " ")
    return squeeze(re.sub("[\ue000-\ue0ff]", lambda m: chr(ord(m[0]) - 0xE000), text))


def latex_grid(body: str) -> list[list[str]]:
    body = re.sub(r"\\(hline|toprule|midrule|bottomrule|cline\{[^}]*\}|cmidrule(\([^)]*\))?\{[^}]*\})", "", body)
    rows = [[latex_inline(c) for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\(?:\[[^\]]*\])?", body)]
    return [r for r in rows if any(r)]


def latex(text: str) -> list[Block] | None:
    """Title, sections, abstract, lists, tables and paragraphs; None if it has no LaTeX structure."""
    text = re.sub(r"(?m)(?<!\\)%.*$", "", text)
    if not STRUCTURE.search(text) and "\\begin{document}" not in text:
        return None
    out: list[Block] = []

    def prose(part: str):
        part = re.sub(r"\\(documentclass|usepackage|author|date|maketitle|begin|end|centering|bibliography[a-z]*)\b(\[[^\]]*\])?(\{[^}]*\})*", "", part)
        out.extend(Block("paragraph", t, confidence=0.85) for p in paragraphs(part) if (t := latex_inline(p.text)))

    at = 0
    while m := STRUCTURE.search(text, at):
        prose(text[at : m.start()])
        if m[1]:
            inside, at = braced(text, m.end() - 1)
            out.append(Block(f"heading_{SECTION_LEVELS[m[1]]}", latex_inline(inside), confidence=0.85))
            continue
        close = text.find(f"\\end{{{m[2]}}}", m.end())
        body = text[m.end() : close if close >= 0 else len(text)]
        at = close + len(m[2]) + 6 if close >= 0 else len(text)
        if m[2] == "abstract":
            out.append(Block("abstract", latex_inline(body), confidence=0.85))
        elif m[2] in ("itemize", "enumerate"):
            items = [latex_inline(x) for x in re.split(r"\\item\b(?:\[[^\]]*\])?", body)[1:]]
            out.append(Block("list", "\n".join(filter(None, items)), confidence=0.85))
        else:
            caption = ""
            if c := re.search(r"\\caption\s*(?=\{)", body):
                caption, end = braced(body, c.end())
                body = body[: c.start()] + body[end:]
            if inner := re.search(r"\\begin\{(tabular\*?|longtable)\}(.*?)\\end\{\1\}", body, re.S):
                body = inner[2]
            body = braced(body.lstrip(), 0)[0] and body.lstrip()[braced(body.lstrip(), 0)[1] :] if body.lstrip().startswith("{") else body
            out.append(Block("table", latex_inline(caption), confidence=0.85, grid=latex_grid(body)))
    prose(text[at:])
    return out


def plain(text: str) -> list[Block]:
    """Token labels, LaTeX, Markdown, whichever it is; else paragraphs."""
    for probe in (token_labels, latex, markdown):
        if (got := probe(text)) is not None:
            return got
    return paragraphs(text)


def email(text: str) -> list[Block]:
    """Subject, folded lines joined, as a heading; the body after the first empty line as paragraphs."""
    head, _, body = text.replace("\r\n", "\n").replace("\r", "\n").partition("\n\n")
    subject = re.search(r"(?im)^subject:[ \t]*(.*(?:\n[ \t]+.*)*)", head)
    first = [Block("heading_1", squeeze(subject[1]))] if subject and subject[1].strip() else []
    return first + paragraphs(body)
