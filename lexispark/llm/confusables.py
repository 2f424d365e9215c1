"""One consistent form for text that looks the same but differs in its characters.

Plan. One Arrow pass counts letter pairs inside words of one script over the whole collection (the counts are at most one for
each pair of letters of three alphabets). A second pass flags each string with a table lookup per character; only flagged strings go on:
compatibility forms are replaced, accents composed, ignorable characters deleted, other blanks made spaces, and each word that
mixes scripts is spelled anew along the best path (Viterbi) through the lattice of its letters' look-alikes, scored by the letter pairs
of one script. Whole strings that are a dictionary term in letters of another script are found through a look-alike key.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import spread
from .textkernel import CHUNK_CHARS, TABLE_SIZE, chunks, codepoints, fold

WIDTH, MARK, IGNORABLE, BLANK, LATIN, GREEK, CYRILLIC, LETTER, MU = (1 << i for i in range(9))
SCRIPTS = LATIN | GREEK | CYRILLIC
NAMES = {LATIN: "LATIN", GREEK: "GREEK", CYRILLIC: "CYRILLIC"}

# Letters that look alike, Latin, Greek, Cyrillic; a dot where a script has none.
ALIKE = """
A Α А|B Β В|E Ε Е|Z Ζ .|H Η Н|I Ι І|K Κ К|M Μ М|N Ν .|O Ο О|P Ρ Р|T Τ Т|Y Υ У|X Χ Х|C . С|S . Ѕ|J . Ј
a α а|e ε е|i ι і|k κ к|o ο о|p ρ р|t τ т|u υ .|y γ у|v ν .|x χ х|w ω .|n η п|c . с|s . ѕ|j . ј|b β .|h . һ|m . м
. υ у|. υ ц|á ά .|ó ό .|í ί .|é έ .|ú ύ .|. π п|. Γ Г|. Π П|. Φ Ф|. φ ф
"""  # fmt: skip
#: Characters that no reader sees, beyond the format category.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ᠎" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Kinds of compatibility form that look like the plain character; superscripts, fractions and the like don't.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>")


@lru_cache(maxsize=1)
def alike() -> dict[str, tuple[str, ...]]:
    """The letters of other scripts that look like a letter."""
    out: dict[str, set[str]] = {}
    for group in ALIKE.replace("\n", "|").split("|"):
        letters = [c for c in group.split() if c != "."]
        for c in letters:
            out.setdefault(c, set()).update(x for x in letters if x != c)
    return {c: tuple(sorted(x)) for c, x in out.items()}


def script(ch: str) -> int:
    """LATIN, GREEK or CYRILLIC for their letters, else 0."""
    if ch.isascii():
        return LATIN if ch.isalpha() else 0
    name = unicodedata.name(ch, "")
    return next((s for s, n in NAMES.items() if name.startswith(n) and ch.isalpha()), 0)


def replaced(ch: str) -> str:
    """The plain form of a width or compatibility character that looks the same, else the character."""
    once = unicodedata.normalize("NFC", ch)
    if once != ch and not unicodedata.combining(ch):
        return once
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in SAME_LOOK:
        plain = unicodedata.normalize("NFKC", ch)
        if plain.isalnum() or tag in ("<wide>", "<narrow>", "<font>"):
            return plain
    return ch


def flag(ch: str) -> int:
    """The flags of a character."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch in UNSEEN or 0xE0000 <= ord(ch) <= 0xE01EF:
        return IGNORABLE
    if cat in ("Mn", "Me"):
        return MARK | LETTER
    if cat in ("Zs", "Zl", "Zp") and ch != " ":
        return BLANK
    if cat[0] in "LN":
        return LETTER | script(ch) | (WIDTH if replaced(ch) != ch else 0) | (MU if ch in "μµ" else 0)
    return WIDTH if replaced(ch) != ch else 0


@lru_cache(maxsize=1)
def flag_table() -> np.ndarray:
    t = np.zeros(TABLE_SIZE, np.uint16)
    for cp in range(TABLE_SIZE):
        t[cp] = LETTER if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 else flag(chr(cp))
    return t


def flags(texts: list[str]) -> np.ndarray:
    """For each text the flags of its characters; LETTER only where a word of it mixes scripts."""
    cps = codepoints(texts)
    f = flag_table()[np.minimum(cps, TABLE_SIZE - 1)]
    if (high := cps >= TABLE_SIZE).any():
        some, at = np.unique(cps[high], return_inverse=True)
        f[high] = np.array([flag(chr(c)) for c in some], np.uint16)[at]
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(length) - length
    out = np.bitwise_or.reduceat(f & np.uint16(WIDTH | MARK | IGNORABLE | BLANK), begin) if len(texts) else np.zeros(0, np.uint16)
    letter = f & LETTER > 0
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    at, pos = np.flatnonzero(start), np.flatnonzero(letter)
    if len(at):
        first = np.searchsorted(pos, at)
        s = f[pos] & np.uint16(SCRIPTS)
        mixed = _several(np.bitwise_or.reduceat(s, first))
        if mixed.any():
            # a unit: Greek mu before Latin letters only
            unit = s.copy()
            unit[first] = np.where(f[at] & MU > 0, LATIN, unit[first])
            mixed &= _several(np.bitwise_or.reduceat(unit, first))
            out[np.searchsorted(begin, at[mixed], side="right") - 1] |= LETTER
    return out


def _several(s: np.ndarray) -> np.ndarray:
    return s & (s - 1) > 0


class Speller:
    """Viterbi over look-alike lattices under letter-pair scores of one script at a time.

    pairs: (letter, letter) -> count, folded letters, '' at a word's ends.
    """

    #: Scores of leaving a letter for a look-alike, and of a change of script.
    CHANGE, SWITCH = -0.5, -25.0

    def __init__(self, pairs: dict[tuple[str, str], int], terms: Iterable[str] = ()) -> None:
        self.pairs = pairs
        self.totals: dict[str, int] = {}
        for (a, _), n in pairs.items():
            self.totals[a] = self.totals.get(a, 0) + n
        self.terms: dict[str, str] = {}
        self.keys: dict[str, str] = {}
        for t in sorted(terms):
            plain = self.plain(t)
            self.terms[self.key(plain, False)] = plain
            self.keys.setdefault(self.key(plain, True), plain)
        self.cache: dict[str, str] = {}

    @staticmethod
    def key(s: str, lookalikes: bool) -> str:
        return " ".join("".join(" " if c.isspace() else f if (f := fold(c, lookalikes)) != " " else c for c in s).split())

    @staticmethod
    def plain(s: str) -> str:
        """Compatibility forms replaced, ignorable characters deleted, blanks made spaces, accents composed."""
        s = "".join(" " if k & BLANK else replaced(c) for c in s if not (k := int(flag_table()[min(ord(c), TABLE_SIZE - 1)])) & IGNORABLE)
        return unicodedata.normalize("NFC", s)

    def score(self, a: str, b: str) -> float:
        sa, sb = script(a) if a else 0, script(b) if b else 0
        if sa and sb and sa != sb:
            return self.SWITCH
        fa, fb = fold(a, False) if a else "", fold(b, False) if b else ""
        return math.log((self.pairs.get((fa, fb), 0) + 0.1) / (self.totals.get(fa, 0) + 10))

    def respell(self, word: str) -> str:
        """The best spelling of a word in look-alike letters."""
        if word in self.cache:
            return self.cache[word]
        own = [script(c) for c in word]
        major = max((LATIN, GREEK, CYRILLIC), key=lambda s: (own.count(s), s == GREEK))
        best: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for c in word:
            options = [(c, 0.0)] + [(x, self.CHANGE) for x in alike().get(c, ())]
            # letters of the word's main script stay unless the path needs a look-alike
            nxt: dict[str, tuple[float, str]] = {}
            for x, cost in options:
                cost += 0.5 * (script(x) == major)
                nxt[x] = max((s + cost + self.score(a, x), w + x) for a, (s, w) in best.items())
            best = nxt
        out = max((s + self.score(a, ""), w) for a, (s, w) in best.items())[1]
        if len(self.cache) < 100_000:
            self.cache[word] = out
        return out

    def canonical(self, text: str, flag: int) -> str:
        """The consistent form of a flagged text."""
        s = self.plain(text)
        if flag & LETTER or flag & (WIDTH | MARK | IGNORABLE):
            out, word = [], ""
            for c in s + "\0":
                if c.isalnum() or unicodedata.combining(c):
                    word += c
                    continue
                if word:
                    seen = {script(x) for x in word} - {0}
                    mixed = len(seen) > 1 and not (word[0] in "μµ" and {script(x) for x in word[1:]} - {0} == {LATIN})
                    out.append(self.respell(word) if mixed else word)
                    word = ""
                out.append(c)
            s = "".join(out)[:-1]
        return s

    def term(self, s: str) -> str | None:
        """The dictionary term that a string is in letters of another script; None if there is none or the string is a term itself."""
        own = self.key(s, False)
        if own in self.terms:
            return None
        found = self.keys.get(self.key(s, True))
        if not found:
            return None
        t, mine = self.key(found, False), own
        if len(t) != len(mine) or all(script(a) == script(b) for a, b in zip(t, mine)):
            return None
        return found.upper() if s.isupper() else found


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """Letter pairs inside words of one script, '' at their ends: a, b, n. At most one row for each pair of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(TABLE_SIZE, np.uint16)
        names = [""]
        for cp in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1F00, 0x2000)):
            if script(chr(cp)) and len(f := fold(chr(cp), False)) == 1 and script(f):
                if f not in names:
                    names.append(f)
                letters[cp] = names.index(f)
        sc = np.array([script(c) if c else 0 for c in names])
        total = np.zeros(len(names) ** 2, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for i, j in chunks(texts):
                c = codepoints(texts[i:j])
                x = letters[np.minimum(c, TABLE_SIZE - 1)].astype(np.int64)
                p, q = x[:-1], x[1:]
                same = (p > 0) | (q > 0)
                same &= (p == 0) | (q == 0) | (sc[p] == sc[q])
                total += np.bincount((p * len(names) + q)[same], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a": [names[k // len(names)] for k in at], "b": [names[k % len(names)] for k in at], "n": total[at]})

    return df.select(text).mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def speller(corpus: DataFrame, text: str, terms: list[str]) -> Speller:
    """A speller with the letter pairs of the whole corpus."""
    return Speller({(r["a"], r["b"]): r["n"] for r in pair_counts(corpus, text).collect()}, terms)


def canonical_forms(df: DataFrame, key: str, text: str, model: Speller, terms: bool = False) -> DataFrame:
    """The strings that have another consistent form: key, kinds (flags that were set), canonical.

    Null keys, null and empty strings take no part; a key given more than once counts once. Other columns are ignored. With `terms`, a whole string that is a
    dictionary term in letters of another script changes to that term.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[str, str | None] = {}
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in chunks(texts, CHUNK_CHARS):
                part = texts[i:j]
                f = flags(part)
                out: list[tuple[int, int, str]] = []
                for k in range(len(part)) if terms else np.flatnonzero(f):
                    s, flag = part[k], int(f[k])
                    c = m.canonical(s, flag) if flag else s
                    if terms:
                        if c not in memo:
                            if len(memo) > 200_000:
                                memo.clear()
                            memo[c] = m.term(c)
                        c = memo[c] or c
                    if c != s:
                        out.append((keys[i + k], flag, c))
                if out:
                    x = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), pa.array(x[2])], names=["key", "kinds", "canonical"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text <> ''")
    return rows.mapInArrow(run, "key bigint, kinds int, canonical string").dropDuplicates(["key"])


def terms_of(dictionary: DataFrame, most: int = 1_000_000) -> list[str]:
    """The dictionary's distinct terms; an error beyond `most`, for they go to every executor."""
    rows = dictionary.select(F.trim("term").alias("t")).where("t <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} dictionary terms")
    return [r["t"] for r in rows]


def found(records: DataFrame, mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """field_name, row_key of the texts and mentions that have another consistent form."""
    records, mentions = spread(records.select("record_id", "text")), spread(mentions.select("mention_id", "mention"))
    model = speller(records, "text", terms_of(dictionary))
    a = canonical_forms(records, "record_id", "text", model).select(F.lit("text").alias("field_name"), F.col("key").alias("row_key"))
    b = canonical_forms(mentions, "mention_id", "mention", model, terms=True).select(F.lit("mention").alias("field_name"), F.col("key").alias("row_key"))
    return a.unionByName(b)


def normalised(df: DataFrame, key: str, text: str, model: Speller, terms: bool = False) -> DataFrame:
    """All rows with the consistent form beside the text: key, text, canonical."""
    forms = canonical_forms(df, key, text, model, terms).select(F.col("key").alias(key), "canonical")
    return df.select(key, text).join(forms, key, "left").withColumn("canonical", F.coalesce("canonical", text))
