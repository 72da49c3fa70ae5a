"""Text of the glyph names that a PDF font's encoding lists."""

from __future__ import annotations

import re
import unicodedata

# Glyph names of characters that no rule below derives.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ",
    "oslash": "ø", "Oslash": "Ø", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "lslash": "ł", "Lslash": "Ł", "dotlessi": "ı",
    "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”",
    "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›",
    "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®",
    "trademark": "™", "degree": "°", "periodcentered": "·", "exclamdown": "¡", "questiondown": "¿", "ordfeminine": "ª", "ordmasculine": "º",
    "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "florin": "ƒ", "perthousand": "‰",
    "minus": "−", "plusminus": "±", "multiply": "×", "divide": "÷", "fraction": "⁄", "onehalf": "½", "onequarter": "¼", "threequarters": "¾",
    "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "approxequal": "≈", "equivalence": "≡", "infinity": "∞", "radical": "√",
    "summation": "∑", "product": "∏", "integral": "∫", "partialdiff": "∂", "logicalnot": "¬", "element": "∈",
    "arrowleft": "←", "arrowright": "→", "arrowup": "↑", "arrowdown": "↓",
}

# Glyph names of accents and their combining characters.
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆",
    "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌",
    "cedilla": "̧", "ogonek": "̨",
}


def glyph_text(name: str) -> str | None:
    """What a glyph is called in text; None for names that say nothing (g12, cid:7). A variant (a.sc) is its
    base, a joined name (f_f_i) its parts; an accented letter is composed, a Greek one looked up."""
    name = name.partition(".")[0] or name
    if len(name) == 1:
        return name
    if name in NAMED:
        return NAMED[name]
    if "_" in name:
        parts = [glyph_text(p) if p else None for p in name.split("_")]
        return None if None in parts else "".join(parts)
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(map(chr, codes)) if all(c < 0x110000 and not 0xD800 <= c < 0xE000 for c in codes) else None
    if name[1:] in ACCENTS:
        got = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return got if len(got) == 1 else None
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    except KeyError:
        return None
