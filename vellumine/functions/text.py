"""String functions as Columns: everything here stays inside the JVM and its generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (without U+001C-1F), spelled for Java's and RE2's syntax alike.
WS = r"\t-\r \x{85}\p{Z}"
# The tags that part blocks.
BLOCK_TAGS = (
    "address", "article", "article-title", "aside", "abstract", "back", "blockquote", "body", "br", "caption", "div", "footer", "front", "h1", "h2", "h3", "h4", "h5", "h6", "header", "item", "li",
    "list", "main", "mixed-citation", "p", "ref", "sec", "section", "table-wrap", "tr",
)
HIDDEN_TAGS = ("script", "style", "title", "head")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for a blank text."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def hidden_ranges() -> str:
    """Pattern of elements whose content is no text; an unclosed one runs to the end."""
    return "(?is)" + "|".join(f"<{t}[>/ \\t\\n\\r].*?</{t}>" for t in HIDDEN_TAGS)


def unclosed_ranges() -> str:
    return "(?is)" + "|".join(f"<{t}[>/ \\t\\n\\r].*" for t in HIDDEN_TAGS)


def block_tags() -> str:
    return "(?i)< ?/* ?(" + "|".join(sorted(BLOCK_TAGS, key=len, reverse=True)) + ")(/| [^>]*)?>"


def decode_numeric(text: Column) -> Column:
    """Numeric entities, decimal and hexadecimal; an ampersand comes out as its name, to be decoded last."""

    def piece(p: Column) -> Column:
        hexa, dec = F.regexp_extract(p, "^[xX]([0-9a-fA-F]{1,8});", 1), F.regexp_extract(p, "^([0-9]{1,10});", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).when(dec != "", dec.cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.substr(p, F.locate(";", p) + 1, F.length(p))
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(code == 38, F.concat(F.lit("&amp;"), rest)).when(known, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), p))

    parts = F.split(text, "&#")
    decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(text, F.lit("&#")), F.concat(parts[0], F.array_join(decoded, ""))).otherwise(text)


def decode_entities(text: Column) -> Column:
    """All numeric entities and six named ones, each once: the ampersand comes last."""
    text = decode_numeric(text)
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Visible text: block tags part paragraphs, other tags vanish, blanks collapse."""
    text = F.regexp_replace(F.regexp_replace(html, hidden_ranges(), ""), unclosed_ranges(), "")
    text = F.regexp_replace(text, f"[{WS}]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, block_tags(), "\n"), "<[^>]*>", "")
    return tidy_lines(decode_entities(text))


def tidy_lines(text: Column) -> Column:
    """Single blanks within lines, one empty line between paragraphs, nothing at the ends."""
    text = F.regexp_replace(text, r"[\t\x{0B}\f\r \x{85}\p{Z}]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?(\n ?)+", "\n\n"), "^\n\n|\n\n$|^ | $", "")


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, their lines trimmed and joined by a space."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(text, r"\n[\t\x{0B}\f \x{85}\p{Z}]*\n")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")


def sanitize_markdown(text: Column) -> Column:
    """No control characters, single blanks within each line."""
    return F.regexp_replace(F.regexp_replace(strip_controls(text), r"[\t \p{Zs}]+", " "), "(?m)^ | $", "")


# LaTeX specials, and what stands for characters that are not ASCII.
_LATEX = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))
_PLAIN = (
    ("\u00a0", " "), ("\u2013", "-"), ("\u2212", "-"), ("\u2014", "---"), ("\u2018", "'"), ("\u2019", "'"), ("\u201a", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u201e", '"'),
    ("\u2022", "*"), ("\u2026", "..."), ("\u00d7", "x"), ("\u00f7", "/"), ("\u2264", "<="), ("\u2265", ">="), ("\u2260", "!="), ("\u00b1", "+/-"),
)


def escape_latex(text: Column) -> Column:
    """Specials escaped (braces first, so that those of the commands stay); control characters that are
    white space become a space, others vanish; what is not ASCII becomes its plain form or '?'."""
    text = F.regexp_replace(F.regexp_replace(text, r"[\t\x{0B}\f\r\x{85}]", " "), r"[\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]", "")
    text = F.replace(F.replace(text, F.lit("{"), F.lit("\x01")), F.lit("}"), F.lit("\x02"))
    for char, out in _LATEX:
        text = F.replace(text, F.lit(char), F.lit(out))
    text = F.replace(F.replace(text, F.lit("\x01"), F.lit("\\{")), F.lit("\x02"), F.lit("\\}"))
    for char, out in _PLAIN:
        text = F.replace(text, F.lit(char), F.lit(out))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def xml_unescape(text: Column) -> Column:
    """Five entities once each; an escaped ampersand never starts another entity."""
    return decode_entities(text)


def strip_latex_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")


def margin_key(text: Column) -> Column:
    """Lower case, digits as '#', single blanks: what repeats in running headers."""
    return collapse(F.regexp_replace(F.lower(text), "[0-9]+", "#"))


def text_health(text: Column, least: int = 25, longest: int = 18, worst: float = 0.04) -> Column:
    """1 for spaced text, 0 where words are glued: share of over-long alphabetic tokens against `worst`."""
    words = F.filter(tokens(text), lambda t: F.regexp_like(t, F.lit(r"\p{L}")))
    n = F.size(words)
    long = F.size(F.filter(words, lambda t: F.length(t) > longest))
    return F.when(n < least, F.lit(1.0)).otherwise(1.0 - F.least(F.lit(1.0), long / F.greatest(n, F.lit(1)) / F.lit(worst)))


def letter_spaced(cell: Column) -> Column:
    """Four tokens or more, 60 % of them single characters."""
    t = tokens(cell)
    return (F.size(t) >= 4) & (F.size(F.filter(t, lambda x: F.length(x) == 1)) * 10 >= F.size(t) * 6)


def table_density(text: Column) -> Column:
    """Lines with three columns or more (two blanks between) of which two are numeric."""
    line = lambda s: F.filter(F.split(F.trim(s), " {2,}"), lambda c: c != "")
    numeric = lambda c: F.regexp_like(c, F.lit(r"^[0-9$(),.%+ -]+$")) & F.regexp_like(c, F.lit("[0-9]"))
    return F.size(F.filter(F.split(text, "\n"), lambda s: (F.size(line(s)) >= 3) & (F.size(F.filter(line(s), numeric)) >= 2)))


def norm_text(text: Column) -> Column:
    """Without Markdown delimiters, lower case, single blanks."""
    return collapse(F.lower(F.regexp_replace(text, r"[#*_`|>~-]", " ")))


def accuracy_tokens(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\x02"), F.lit("fi")), F.lit("\x03"), F.lit("fl"))
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def is_numeric_value(text: Column) -> Column:
    t = F.trim(text)
    return F.regexp_like(t, F.lit(r"^[0-9$(),.%+ –—-]+$")) & F.regexp_like(t, F.lit("[0-9]"))


def normalize_math(text: Column) -> Column:
    return F.regexp_replace(text, r"\\left|\\right|[$`{} ]", "")


def normalize_glyphs(text: Column) -> Column:
    """Ligatures, smart quotes and dashes to plain characters."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, "‘’“”–—", "''\"\"--")


def context_window(text: Column, needle: Column, radius: int = 240) -> Column:
    """Text around the first match of a needle; from the start if there is none."""
    at = F.instr(text, needle)
    first = F.greatest(F.lit(1), at - radius)
    return F.substr(text, first, F.when(at > 0, at - first + F.length(needle) + radius).otherwise(F.lit(2 * radius)))


# LaTeX commands and the characters that a page shows for them, replaced in this order.
MATH_SIGNS = (
    ("\\Gamma", "Γ"), ("\\Theta", "Θ"), ("\\Lambda", "Λ"), ("\\Pi", "Π"), ("\\Sigma", "Σ"), ("\\Phi", "Φ"), ("\\Omega", "Ω"), ("\\alpha", "α"), ("\\beta", "β"), ("\\gamma", "γ"), ("\\delta", "δ"),
    ("\\epsilon", "ε"), ("\\lambda", "λ"), ("\\theta", "θ"), ("\\rho", "ρ"), ("\\tau", "τ"), ("\\phi", "φ"), ("\\omega", "ω"), ("\\infty", "∞"), ("\\in", "∈"), ("\\cup", "∪"), ("\\cap", "∩"),
    ("\\subseteq", "⊆"), ("\\supseteq", "⊇"), ("\\leq", "≤"), ("\\geq", "≥"), ("\\neq", "≠"), ("\\times", "×"), ("\\pm", "±"), ("\\to", "→"), ("\\mapsto", "↦"), ("\\cdots", "..."), ("\\ldots", "..."),
)


def math_alias(text: Column) -> Column:
    """A formula as it is searched for in plain text; null if that is the text itself."""
    got = text
    for command, sign in MATH_SIGNS:
        got = F.replace(got, F.lit(command), F.lit(sign))
    got = F.translate(F.regexp_replace(got, r"([_^])\{([^{}]+)\}", "$1$2"), "{}", "")
    return F.when(got != text, got)
