"""Text functions: Column expressions where SQL can say it, plain Python otherwise."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = frozenset(WHITE_SPACE)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the LIKE of the store folds case."""
    return F.translate(c, UPPER, LOWER)


def trim_unicode(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalized_category(c: Column) -> Column:
    """A null or blank category is `uncategorized`."""
    return F.coalesce(F.nullif(trim_unicode(c), F.lit("")), F.lit("uncategorized"))


def glob_to_like(c: Column) -> Column:
    """A glob as a LIKE pattern with escape character `\\`: `*` and `**` match anything, `?` one character."""
    for mark in ("\\", "%", "_"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    c = F.regexp_replace(c, r"\*+", "%")
    return F.replace(c, F.lit("?"), F.lit("_"))


def query_tokens(c: Column) -> Column:
    """Search terms of a query: split at white space, keep letters, digits and `_ - .`, drop empty ones."""
    parts = F.transform(F.split(c, f"[{WHITE_SPACE}]+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_.\-]", ""))
    return F.filter(parts, lambda t: t != "")


def match_expression(c: Column) -> Column:
    """The terms as quoted prefix terms joined by OR."""
    return F.array_join(F.transform(query_tokens(c), lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " OR ")


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits; underscores, hyphens and dots separate."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def trigrams(c: Column) -> Column:
    """Distinct three-character substrings; a shorter text is its own."""
    n = F.length(c)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    return F.array_distinct(some)


def document_prefix(model: Column, text: Column) -> Column:
    return F.when(F.lower(model).contains("nomic-embed"), F.concat(F.lit("search_document: "), text)).otherwise(text)


def query_prefix(model: Column, text: Column) -> Column:
    return F.when(F.lower(model).contains("nomic-embed"), F.concat(F.lit("search_query: "), text)).otherwise(text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^/]\.([^./]+)$", 1))


def model_dims(spec: Column) -> Column:
    """`model:dims` split at the last colon: struct of model and dims (null if that isn't a number)."""
    return F.struct(F.regexp_extract(spec, r"^(.*):([^:]*)$", 1).alias("model"), F.try_to_number(F.nullif(F.substring_index(spec, ":", -1), F.lit("")), F.lit("999999999")).cast("int").alias("dims"))


def scrub_latency(c: Column) -> Column:
    """Blank the timings in a report's text, so repeated runs compare equal."""
    return F.regexp_replace(c, r"\d+(?:\.\d+)?\s*ms", "<ms>")


def chunk_text(text: str | None, size: int, overlap: int) -> list[tuple[int, str, int, int]]:
    """(ordinal, text, start, end) of overlapping windows of `size` code points.

    A window ends after its last white space if that keeps at least size // 2
    code points; chunks are trimmed, blank ones are dropped without using an
    ordinal, and the next window starts `overlap` before the end, or at the end
    if it would not advance.
    """
    text = text or ""
    n, out, start = len(text), [], 0
    if size <= 0:
        return out
    overlap = min(overlap, size - 1)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = next((i for i in range(end - 1, start - 1, -1) if text[i] in _SPACES), None)
            if cut is not None and cut + 1 - start >= size // 2:
                end = cut + 1
        a, b = start, end
        while a < b and text[a] in _SPACES:
            a += 1
        while b > a and text[b - 1] in _SPACES:
            b -= 1
        if a < b:
            out.append((len(out), text[a:b], a, b))
        if end >= n:
            break
        start = end - overlap if end - overlap > start else end
    return out


class _Text(HTMLParser):
    """Visible text with a line for each block element."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    HIDDEN = frozenset("script style head template noscript".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str, width: int = 100) -> str:
    """Text of a page: white space collapsed within lines, lines wrapped at `width`."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines: list[str] = []
    for line in "".join(parser.parts).split("\n"):
        row = ""
        for word in line.split():
            if row and len(row) + 1 + len(word) > width:
                lines.append(row)
                row = word
            else:
                row = f"{row} {word}" if row else word
        if row:
            lines.append(row)
    return "\n".join(lines)


# The suffixes of Porter's steps 2, 3 and 4, and what replaces them.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"


def suffix_rules(step: str) -> list[tuple[str, str]]:
    """(suffix, replacement), longest suffix first."""
    return sorted(((x.partition(":")[0], x.partition(":")[2]) for x in step.split()), key=lambda r: -len(r[0]))


_RULES = [suffix_rules(STEP_2), suffix_rules(STEP_3), suffix_rules(STEP_4)]
_ENDINGS = [tuple(old for old, _ in r) for r in _RULES]
_LETTERS = str.maketrans({x: "v" if x in "aeiou" else x if x == "y" else "c" for x in LOWER})


def _shape(w: str) -> str:
    """Letters as c and v; a y is a vowel after a consonant."""
    s = w.translate(_LETTERS)
    if "y" not in s:
        return s
    out = ""
    for ch in s:
        out += ch if ch != "y" else "v" if out and out[-1] == "c" else "c"
    return out


def porter_stem(word: str) -> str:
    """Porter's algorithm of 1980 for a lower-case ASCII word; other words are returned as they are."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word

    def measure(w: str) -> int:
        """Runs of vowels that consonants follow."""
        return _shape(w).count("vc")

    def short_end(w: str) -> bool:
        return _shape(w).endswith("cvc") and w[-1] not in "wxy"

    def replace(w: str, step: int, least: int) -> str:
        if not w.endswith(_ENDINGS[step]):
            return w
        old, new = next(r for r in _RULES[step] if w.endswith(r[0]))
        stem = w[: len(w) - len(old)]
        return stem + new if measure(stem) > least else w

    w = word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for old in ("ed", "ing"):
            if w.endswith(old) and "v" in _shape(w[: -len(old)]):
                w = w[: -len(old)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = replace(replace(w, 0, 0), 1, 0)
    if w.endswith("ion") and not any(w.endswith(x) for x in STEP_4.split()):
        w = w[:-3] if measure(w[:-3]) > 1 and w[-4:-3] in ("s", "t") else w
    else:
        w = replace(w, 2, 1)
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def index_words(c: Column) -> Column:
    """Lower-cased runs of letters, digits and marks: what the full-text index makes terms of."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+"), 0)


def spaced_words(c: Column, other: str = r"[^\p{L}\p{N}\p{M}]+") -> Column:
    """The words of index_words as one string with spaces between and perhaps around them, which costs less to send to Python than an array."""
    return F.regexp_replace(F.lower(c), other, " ")


@lru_cache(maxsize=1 << 18)
def index_term(word: str) -> str:
    """The index's term for a lower-cased word: diacritics removed, stemmed; empty for marks alone."""
    if word.isascii():
        return porter_stem(word)
    return porter_stem("".join(ch for ch in unicodedata.normalize("NFD", word) if not unicodedata.combining(ch)))


@lru_cache(maxsize=2)
def _marks(most: int) -> re.Pattern:
    """Every combining character up to a code point."""
    return re.compile("[" + "".join(re.escape(chr(i)) for i in range(most + 1) if unicodedata.combining(chr(i))) + "]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def index_words_of(text: str) -> list[str]:
    """Words of the full-text index: diacritics removed, lower-cased, split at other than letters and digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = _marks(sys.maxunicode if _BEYOND.search(text) else 0xFFFF).sub("", text)  # sets within 16 bits are searched much faster
    return re.findall(r"[^\W_]+", text.lower())


def index_terms(text: str) -> list[str]:
    """The stems of index_words_of."""
    return [porter_stem(w) for w in index_words_of(text)]


def html_cell(c: Column) -> Column:
    """The column form of html_escape."""
    for mark, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(safe))
    return c


def markdown_cells(c: Column) -> Column:
    """The column form of markdown_cell."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_escape(s: str) -> str:
    return escape(s, quote=True)


def markdown_cell(s: str) -> str:
    return s.replace("|", "\\|").replace("\n", " ")
