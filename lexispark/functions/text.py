"""Text expressions: cleaning, normalization, tokens, windows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression class that Java and RE2 read alike.
SPACE = "[ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _accent_pairs() -> tuple[str, str]:
    """Letters with accents of the Latin and Greek blocks, and their plain letters."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1F00, 0x2000)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(cp):
            src.append(chr(cp))
            dst.append(plain)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_pairs()


def clean_text(c: Column) -> Column:
    """White space runs to one space first, then characters outside the kept set deleted, then trimmed; null stays null."""
    once = F.regexp_replace(c, SPACE + "+", " ")
    return F.trim(F.regexp_replace(once, "[^a-zA-Z0-9\\x{370}-\\x{3ff}\\x{1f00}-\\x{1fff} \\-.,%/()\\[\\]:]", ""))


def strip_accents(c: Column) -> Column:
    """Letters without their accents; combining marks are deleted."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "\\p{Mn}", "")


def normalize_text(c: Column, fold_sigma: bool = False) -> Column:
    """Lower case, no accents, all but Latin and Greek letters and digits to single spaces; null stays null.

    fold_sigma writes final sigma as sigma, so that capitals match.
    """
    low = strip_accents(F.lower(c))
    if fold_sigma:
        low = F.translate(low, "ς", "σ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "΄", ""), "[^a-zA-Zα-ωΑ-Ω0-9]+", " "))


def tokenize(norm: Column) -> Column:
    """Tokens of a normalized text; none for an empty one."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: the optimizer would else write a costly expression out at each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` tokens, joined by a space."""
    return let(tokens, lambda t: _ngrams(t, longest))


def _ngrams(tokens: Column, longest: int) -> Column:
    parts = [F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")) for n in range(1, longest + 1)]
    return F.concat(*[F.when(F.size(tokens) >= n, p).otherwise(F.array().cast("array<string>")) for n, p in zip(range(1, longest + 1), parts)])


def context_window(text: Column, start: Column, end: Column, width: int = 200) -> Column:
    """The text from `width` codepoints before a half-open span to `width` after it."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, first + 1, F.least(F.char_length(text), end + width) - first)


def chunk_starts(n: Column, window: int, stride: int) -> Column:
    """Starts of sliding windows over n tokens; the last window is the first one that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(stride))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
