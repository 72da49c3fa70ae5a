"""Token ids of whole texts by the public `tokenizers` files, with a bounded per-worker memory of pieces.

A text is cut where the pre-tokenizer cuts it whatever stands around: before a single space or line
feed that is followed by something other than white space, and after such a line feed.  Pieces are
encoded by the library once and remembered, so the ids equal those of the whole text.  Texts that hold
an added token of the file, such as <|endoftext|>, are encoded by the library whole.  Arrow cuts the
texts and finds their distinct pieces; Python sees only these, and numpy puts the ids together again.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import column_bytes, steps

#: Pieces that a worker remembers before it starts afresh, and bytes of text cut together.
MEMORY = 600_000
TEXT_BYTES = 6 << 20
#: Forms encoded together, with something between them that is one token of its own.
TOGETHER = 256
#: White space at an end, two of it in a row, or any but space and line feed: such texts are cut one by one.
ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
OTHER_SPACE = re.compile(r"[^\S \n]")
STOPS = (".", ",")
_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """lower: the file's normalizer drops white space, so pieces need no leading space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.drops_space = bool(self.tok.normalizer)
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.between = " | " if self.drops_space else "\n"
        self.mark = self.tok.encode(self.between, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        if self.drops_space:  # white space only ends matches there
            return text.replace("\n", " ").split(" ")
        parts = text.split(" ")
        if len(parts) == 1 and "\n" not in text:
            return parts
        out, space = [], ""
        for p in parts:
            # an empty part, or one that begins with white space, belongs to a run of white space
            if not p or p[0].isspace() or (out and p[0] in "\x1c\x1d\x1e\x1f\x85"):
                if out:
                    out[-1] += space + p
                else:
                    out.append(space + p)
            elif out and out[-1][-1:].isspace() and out[-1].strip() == "" and len(out) == 1 and not space:
                out[-1] += p
            else:
                out.append(space + p)
            space = " "
        return [q for p in out for q in (_lines(p) if "\n" in p else (p,))]

    def learn(self, forms: list[str]) -> None:
        """Encode forms. Simple ones go together and are told apart by the token between them."""
        known, alone = self.known, []
        groups = [forms[i : i + TOGETHER] for i in range(0, len(forms), TOGETHER)]
        joined = [self.between.join(g) for g in groups]
        simple = [self.simple(x, len(g)) for x, g in zip(joined, groups, strict=True)]
        alone = [f for g, ok in zip(groups, simple, strict=True) if not ok for f in g]
        groups, joined = [g for g, ok in zip(groups, simple, strict=True) if ok], [x for x, ok in zip(joined, simple, strict=True) if ok]
        for k in range(0, len(groups), 16):
            for group, e in zip(groups[k : k + 16], self.tok.encode_batch_fast(joined[k : k + 16], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(ids == self.mark[0]) * 4
                if len(at) != len(group) - 1:
                    alone += group
                    continue
                raw = ids.tobytes()
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)], strict=True))
        for i in range(0, len(alone), 4096):
            part = alone[i : i + 4096]
            for f, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[f] = np.array(e.ids, np.uint32).tobytes()

    def simple(self, joined: str, n: int) -> bool:
        """Whether n forms hold no white space (but for one space in front, where it matters) nor the mark."""
        if len(self.mark) != 1:
            return False
        if self.drops_space:
            return joined.count("|") == n - 1 and len(joined.split()) == 2 * n - 1
        odd = "  " in joined or " \n" in joined or joined[-1:] == " " or OTHER_SPACE.search(joined)
        return not odd and joined.count("\n") == n - 1 and len(joined.split()) == n

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as 32-bit integers. A full stop or comma after a letter (one that is one
        letter however it is normalized) is a token of its own in either file's pattern, and ASCII
        capitals are no matter where the normalizer lowers them: so pieces have fewer forms."""
        known = self.known
        found = [known.get(p) for p in pieces]
        new = [k for k, x in enumerate(found) if x is None]
        if not new:
            return found
        own = forms = [pieces[k] for k in new]
        if self.drops_space:
            # what only lowering makes an added token is none
            lower = [p.lower() if p.isascii() else p for p in forms]
            every = "\n".join(lower)
            if any(x in every for x in self.added):
                lower = [p if any(x in q for x in self.added) else q for p, q in zip(forms, lower, strict=True)]
            forms = lower
        ends = [p[-1:] if p[-1:] in STOPS and p[-2:-1].isalpha() and p[-2] < "\u0130" else "" for p in forms]
        forms = [p[:-1] if e else p for p, e in zip(forms, ends, strict=True)]
        self.learn([f for f in dict.fromkeys([*forms, ".", ","]) if f not in known])
        for k, p, f, e in zip(new, own, forms, ends, strict=True):
            found[k] = known[p] = known[f] + known[e] if e else known[f]
        return found

    def encode_step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        held = np.zeros(n, bool)
        for content in self.added:
            held |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not held.any():
            return self.encode_cut(texts)
        ids, at = self.encode_cut(pc.if_else(pa.array(held), "", texts))
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for k in np.flatnonzero(held).tolist():
            parts[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def encode_cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without added tokens."""
        n = len(texts)
        odd = np.zeros(n, bool) if self.drops_space else pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " " if self.drops_space else " \n"), " ")
        parts = np.ones(n, np.int64)
        parts[~odd] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        coded = cut.flatten().dictionary_encode()
        values = coded.dictionary
        index = np.zeros(int(parts.sum()), np.int64)
        at = np.repeat(~odd, parts)
        index[at] = coded.indices.to_numpy(zero_copy_only=False)
        if self.drops_space:
            found = self.ids_of(values.to_pylist())
        else:
            after = pc.starts_with(values, "\n")
            found = self.ids_of(pc.if_else(after, pc.utf8_slice_codeunits(values, 1), pc.binary_join_element_wise("", values, " ")).to_pylist())
            line = self.ids_of(["\n"])[0]
            for k in np.flatnonzero(after.to_numpy(zero_copy_only=False)).tolist():
                found[k] = line + found[k]
            begins = (np.cumsum(parts) - parts)[~odd]  # no space before the first
            firsts = values.take(pa.array(index[begins])).to_pylist()
            index[begins] = len(found) + np.arange(len(begins))
            found += self.ids_of(firsts)
            whole = [self.pieces(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            index[~at] = len(found) + np.arange(len(whole))
            found += [b"".join(self.ids_of(ps)) for ps in whole]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), np.uint32)
        each = sizes[index]
        ends = np.r_[0, np.cumsum(each)]
        shift = (np.cumsum(sizes) - sizes)[index] - ends[:-1]
        return flat[np.repeat(shift, each) + np.arange(ends[-1])], ends[np.r_[0, np.cumsum(parts)]]

    def encode_column(self, texts: pa.Array):
        """For each step of a string column: (first row, last row, ids one after another, offsets)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        _, offsets = column_bytes(texts)
        for i, j in steps(offsets, TEXT_BYTES):
            if len(self.known) > MEMORY:
                self.known.clear()
            yield i, j, *self.encode_step(texts.slice(i, j - i))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids[a:b] for _, _, ids, at in self.encode_column(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]


def _lines(piece: str) -> list[str]:
    """Cut around single line feeds between characters that aren't white space."""
    parts = piece.split("\n")
    if len(parts) == 1:
        return parts
    out = [parts[0]]
    for a, b in zip(parts, parts[1:]):
        if a and b and not a[-1].isspace() and not b[0].isspace():
            out += ["\n", b]
        else:
            out[-1] += "\n" + b
    return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Encoder(path)
    return _loaded[path]
