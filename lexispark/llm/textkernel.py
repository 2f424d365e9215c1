"""Batch kernels over text: whole Arrow batches become numpy arrays of code points, words and word hashes.

A *word* is an unbroken run of letters or digits, compared without regard to case, accents, final
sigma, width and compatibility forms, ignorable characters and look-alike letters. All of that is one
lookup table from code point to class, so a batch costs a few array passes and no Python per character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

SEP, DEL, EXPAND = 0, 1, 2
TABLE_SIZE = 0x20000
#: Characters of text that one pass holds; about 60 bytes of arrays per character.
CHUNK_CHARS = 600_000

# Letters of other scripts that look like a Latin or Greek one, in either case,
# each with the class it shares (lower case after folding).
LOOKALIKES = {
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x",
    "v": "n", "u": "y", "γ": "y", "ω": "w",
    "а": "a", "в": "b", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s",
}

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(ch: str, lookalikes: bool = True) -> str:
    """The letters or digits that a character counts as; '' if it is ignored, ' ' if it separates words."""
    cat = unicodedata.category(ch)
    if cat in ("Cf", "Mn", "Me"):
        return ""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
    s = "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Me", "Cf")).replace("ς", "σ")
    if not s or not s.isalnum():
        return " "
    return "".join(LOOKALIKES.get(c, c) for c in s) if lookalikes else s


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point below TABLE_SIZE: SEP, DEL, EXPAND (several letters) or the folded letter."""
    t = np.zeros(TABLE_SIZE, np.uint32)
    for cp in range(TABLE_SIZE):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF:  # no case, no accents: the character is its class
            t[cp] = cp
            continue
        s = fold(chr(cp))
        t[cp] = DEL if s == "" else SEP if s == " " else ord(s) if len(s) == 1 else EXPAND
    return t


def codepoints(texts: Sequence[str]) -> np.ndarray:
    """The texts' code points with a NUL after each text."""
    return np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


class Words:
    """The words of a batch of texts: hash[i] of word i, rec[i] its text, and for each text first[t]..first[t+1]."""

    __slots__ = ("first", "hash", "n", "rec")

    def __init__(self, texts: Sequence[str], digits_alike: bool = False) -> None:
        self.n = len(texts)
        table = class_table()
        cps = codepoints(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1)
        cls = table[np.minimum(cps, TABLE_SIZE - 1)]
        high = cps >= TABLE_SIZE
        if high.any():
            some, at = np.unique(cps[high], return_inverse=True)
            folded = [fold(chr(c)) for c in some]
            cls[high] = np.array([DEL if f == "" else SEP if f == " " else ord(f) if len(f) == 1 else EXPAND for f in folded], np.uint32)[at]
        if (cls == EXPAND).any():
            which = np.unique(np.searchsorted(ends, np.flatnonzero(cls == EXPAND), side="right"))
            texts = list(texts)
            for i in which:
                texts[i] = "".join(f if len(f := fold(c)) > 1 else c for c in texts[i])
            self.__init__(texts, digits_alike)
            return
        if digits_alike:
            cls[(cls >= 48) & (cls <= 57)] = 48
        keep = cls != DEL
        if not keep.all():
            kept = np.cumsum(keep)
            ends = kept[ends - 1]
            cls = cls[keep]
        letter = cls > EXPAND
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        at = np.flatnonzero(start)
        pos = np.flatnonzero(letter)
        if not len(at):
            self.hash, self.rec, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
            return
        begin = np.searchsorted(pos, at)  # index of each word's first letter among the letters
        length = np.diff(np.append(begin, len(pos)))
        within = np.arange(len(pos)) - np.repeat(begin, length)
        power = np.ones(int(length.max()) + 1, np.uint64)
        with np.errstate(over="ignore"):
            power[1:] = MIX1
            power = np.multiply.accumulate(power)
            value = mix(cls[pos].astype(np.uint64) * MIX2 + np.uint64(1)) * power[within]
            self.hash = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
        self.rec = np.searchsorted(ends, at, side="right")
        self.first = np.searchsorted(self.rec, np.arange(self.n + 1))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of k words inside one text: hash, text, position of the first word in the batch."""
    h, rec = words.hash, words.rec
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        z = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            z = z * MIX1 + h[j : len(z) + j]
        z = mix(z)
    at = np.flatnonzero(rec[: len(z)] == rec[k - 1 :])
    return z[at], rec[at], at


def chunks(texts: Sequence[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about `size` characters each; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


# A hyphen at a line's end between letters: the word goes on in the next line.
BREAK = re.compile(r"(?<=\w)[-‐‑­][ \t  ]*\r?\n\s*(?=\w)")


def rejoin(text: str) -> str:
    """Text with words that a hyphen divides at a line end made whole."""
    return BREAK.sub("", text)
