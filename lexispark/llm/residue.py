"""Template residue, filler text, error pages and script notices.

Plan. One Arrow pass cuts each document into segments (lines and sentences), gives trusted labels to segments that show residue beyond doubt,
and a 64-bit SimHash and the set of its words to every other segment, numbers masked. Then labels of whole-segment residue spread: of the n words of a labelled segment any
n - 0.8 n + 1 hold one that stands in each segment of that likeness, so segments meet labelled ones in these words, the rarest ones (no pair is lost), are verified by
Hamming distance and by the share of common words, and become labelled themselves, until no connected segment is left. Only the labelled side of a round is broadcast, after its rows are counted.
Placeholders and messages inside real sentences are trusted labels too but don't spread: the sentence around them is ordinary.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import checked_broadcast, spread, stage
from .textkernel import MIX1, Words, chunks, mix

PLACEHOLDER, ERROR, SCRIPT, FILLER = 1, 2, 3, 4
SEGMENTS = "doc_id bigint, segment bigint, simhash bigint, words array<bigint>, label int, whole boolean"
CUT = re.compile(r"[\n\r\t]+|(?<=[.!?;])\s+")

# Forms that unfilled fields and unresolved values take, in the text as it stands.
NAME = r"[^\W\d][\w.]*"
FIELD = "patient|full name|first name|last name|surname|name|date|time|age|sex|birth|address|phone|diagnosis|doctor|physician|ward|department|signature|hospital|insert|enter|όνομα|ονομα|ονοματεπώνυμο|επώνυμο|ημερομηνία|ημερομηνια|ώρα|ηλικία|ηλικια|φύλο|διεύθυνση|τηλέφωνο|διάγνωση|διαγνωση|ιατρός|ιατρος|κλινική|κλινικη|τμήμα|υπογραφή|νοσοκομείο"
PLACEHOLDER_FORMS = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^{}\n]{1,60}%\}", r"\$\{[^{}\n]{1,60}\}", rf"\{{(?:{NAME}|\d{{1,2}})\}}",
    r"<%=?[^<>\n]{1,60}%>", rf"<<\s*{NAME}\s*>>", rf"\[\[\s*{NAME}\s*\]\]", rf"&lt;\s*{NAME}\s*&gt;",
    r"[<\[(](?:insert|enter|fill in|your|εισάγετε|εισαγετε|συμπληρώστε|συμπληρωστε|συμπληρώνεται:?|συμπληρωνεται:?)\s[^<>\[\]()\n]{1,60}[>\])]",
    r"[<\[(](?:to be (?:completed|filled in|added|confirmed)|please (?:fill in|complete)|προς συμπλήρωση|να συμπληρωθεί)[^<>\[\]()\n]{0,40}[>\])]",
    r"\{\{[#/^>!]?[^{}\n]{1,60}\}\}", rf"%%{NAME}%%", rf"@@{NAME}@@", rf"%{NAME}%", rf"\${NAME}\$", rf"#{NAME}#", r"(?<!\w)__[^\W_][\w.]*?__(?!\w)",
    r"«(?:[^\W\d]+_[\w.]+|(?-i:[Α-ΩΆΈΉΊΌΎΏA-Z]{2,}(?:[_ ][Α-ΩΆΈΉΊΌΎΏA-Z]+)*)|ηλικία|κλινική|διάγνωση|θεράπων|όνομα|δόση|age|ward|attending|med\.list)»",
    r"\bXX+/XX+/XX+\b", r"#(?:REF!|VALUE!|N/A|Ν/Δ|NAME\?|DIV/0!|NUM!|NULL!)", r"\bNaN\b", r"\bundefined\b", r"\[object \w+\]", r"\b(?:TODO|TBD|FIXME)\b",
    r"\bnull\b(?!\s+(?:result|hypothesis|finding|reading|value of|mutation|allele|cell|line|point))", r"(?<![%\w])%[sd]\b", r"_{6,}", r"\.{6,}", r"\?{5,}",
)
#: Begins as LONE says, and its words are everywhere: no trigger of its own.
FIELD_FORM = rf"[\[<](?:the\s|your\s|το\s|την?\s)?(?:{FIELD})(?:[ _](?:of\s)?{NAME}){{0,2}}[\]>]"
PLACEHOLDERS = "|".join((*PLACEHOLDER_FORMS, FIELD_FORM))
# Messages and notices, in folded text (lower case, no accents).
# What a message is about and what it says of it: the two near each other at the beginning of a segment.
THING = "page|site|website|server|database|service|session|login|connection|file|document|record|resource|request|report|application|program|gateway|content|operation|link|upload|download"
STATE = "can ?not be found|could not be (?:found|located|opened|loaded|generated|completed|displayed|processed|reached|saved)|not found|does not exist|doesn t exist|no longer exists|not available|unavailable|timed out|timeout|time-out|has expired|access denied|not responding|failed to load|is offline|is down\\b|out of service|you (?:requested|are looking for|were looking for)|responded with"
POLITE = "(?:we are |we re )?(?:sorry|oops|error|warning)[,:.! ]*(?:but )?"
MESSAGES = {
    ERROR: (
        rf"^(?:{POLITE})?(?:(?:the|this|that|your|a|an|our) )?(?:\w+ )?(?:{THING})\b(?! ?\d).{{0,30}}(?:{STATE})", r"^[45]\d\d (?:forbidden|not found|bad gateway|gateway time|internal server|service unavail|too many req|unauthori[sz]ed|bad request)", r"\b(?:can t|cannot|could not|couldn t|unable to) (?:find|load|open|display|reach|connect to) (?:the|this|that|your) (?:page|site|server|file|database|website|application)",
        r"^(?:access (?:is |was )?denied|permission denied|connection (?:refused|reset|lost|to the server)|internal (?:server )?error|segmentation fault|stack trace|core dumped|bad request|failed to (?:load|open|connect|fetch|parse))", r"you (?:are not authori[sz]ed|do not have (?:permission|access)|don t have (?:permission|access)|have been logged out)",
        r"(?:unexpected|internal|unknown) error (?:has )?(?:occur|happen)", r"\b[a-z.]*[a-z](?:exception|error)\b ?[:(]", r"core dumped", r"^error ?: ", r"please (?:log|sign) in again", r"contact (?:the|your) (?:system )?administrator",
        r"^(?:η |ο |το |αυτη η )?(?:ιστο)?(?:σελιδα|υπηρεσια|εφαρμογη|διακομιστησ|αρχειο|εγγραφο|συνεδρια|περιεχομενο)\b(?! ?\d).{0,30}(?:δεν (?:βρεθηκε|υπαρχει|ειναι διαθεσιμ|ανταποκριν|μπορεσε|ηταν δυνατ)|μη διαθεσιμ|εληξε|εκτοσ λειτουργιασ)", r"(?:συνδεση|επικοινωνια|συνδεσησ) με τ\w+ (?:διακομιστη|βαση|εξυπηρετητη)", r"δεν εχετε (?:το )?(?:δικαιωμα|προσβαση|αδεια)",
        r"(?:παρουσιαστηκε|προεκυψε|συνεβη) (?:\w+ )?(?:εσωτερικο |απροσμενο |αγνωστο )?σφαλμα", r"^σφαλμα (?:διακομιστη|συστηματοσ|συνδεσησ|εφαρμογησ|βασησ|φορτωσησ)", r"συνδεθειτε (?:ξανα|παλι)",
        r"^(?:http )?(?:error|http)\s*[45]\d\d\s*[-–—:]", r"^(?:http\s*)?[45]\d\d\s*[-–—:]\s*(?:forbidden|not found|bad gateway|gateway timeout|internal|service|too many|unauthori[sz]ed)",
        r"\b(?:fatal error|unhandled exception|uncaught exception)\s*:", r"^exception in thread\b", r"traceback \(most recent call", r"^(?:κωδικοσ )?σφαλμα(?:τοσ)?\s*\d{3}\s*[-–—:]",
        r"requested page could not be (?:located|found)", r"upstream server sent no", r"this page is gone", r"could not load this (?:record|page)", r"access to this resource is denied",
        r"your session has expired", r"^log in again", r"^go back and retry", r"η συνεδρια σασ εληξε", r"αποτυχια συνδεσησ με τη βαση", r"συνδεθειτε ξανα για να συνεχισετε",
        r"^δοκιμαστε ξανα αργοτερα", r"^try again later", r"η σελιδα που ζητησατε", r"σελιδα δεν υπαρχει πια", r"δεν ηταν δυνατη η φορτωση", r"η προσβαση σε αυτ\w+ \w+ δεν επιτρεπεται", r"^trace id \d+", r"^reference no\. ?\d*$",
        r"^(?:επιστροφη στην αρχικη|return to (?:the )?home)", r"(?:service|server|site) is (?:temporarily )?unavailable", r"ο διακομιστησ δεν αποκρινεται", r"^(?:oops|ουπσ|ωχ)\b", r"κατι πηγε στραβα", r"something went wrong", r"δεν βρηκαμε αυτο που", r"could not find what you", r"το αιτημα (?:σασ )?απορριφθηκε", r"request was (?:rejected|refused|denied)", r"^ιχνοσ: ?\d+", r"^(?:αρχικη|home) \| (?:help|βοηθεια)\b", r"υπηρεσια ειναι προσωρινα εκτοσ",
    ),
    SCRIPT: (
        r"(?:allow|unblock|permit|turn on|switch on|enable) (?:java ?script|script)", r"(?:java ?script|scripts?|scripting) (?:must|needs? to|has to|have to) be", r"(?:java ?script|scripts?|scripting) (?:is|are) (?:blocked|switched off|off|not (?:enabled|supported|allowed))", r"χρειαζεται (?:την? )?(?:java ?script|σεναρια|scripts)", r"δεν (?:εκτελει|επιτρεπει) (?:σεναρια|scripts|java ?script)",
        r"(?:enable|enabling|turn on|activate) (?:java ?script|script(?:s|ing)?)\b", r"(?:requires?|needs) (?:java ?script|script(?:s|ing)?)\b", r"without (?:java ?script|scripts?) (?:enabled|turned on)", r"(?:does not|doesn t|won t) work properly without",
        r"δεν λειτουργει χωρισ ενεργα", r"(?:java ?script|scripts?) (?:and cookies )?(?:is|are|has been)? ?(?:turned off|disabled)", r"has scripts and cookies turned off", r"απαιτει(?:ται)? (?:java ?script|υποστηριξη δεσμησ|εκτελεση σεναριων|ενεργοποι)",
        r"ενεργοποιηστε (?:την? )?(?:υποστηριξη|java ?script|εκτελεση|τα? σεναρι|τα scripts)", r"δεν υποστηριζει (?:σεναρια|java ?script|scripts)", r"browser blocks it", r"το περιεχομενο δεν εμφανιζεται", r"content cannot be shown", r"(?:φυλλομετρητησ|περιηγητησ) (?:σασ )?(?:δεν|εχει|μπλοκαρει|αποκλειει)",
    ),
    FILLER: (
        r"(?:insert|type|enter|write|add|put) (?:your |the |some )?(?:text|comments?|findings|notes?|content|description) here", r"^(?:your )?text here", r"(?:εισαγετε|πληκτρολογηστε|προσθεστε|γραψτε) (?:το )?(?:κειμενο|εδω)", r"^εδω (?:γραψτε|εισαγετε|συμπληρωστε|πληκτρολογηστε)", r"κειμενο προσ συμπληρωση", r"^δειγμα κειμενου", r"text for layout",
        r"lorem ipsum", r"γραψτε εδω", r"εδω μπαινει το κειμενο", r"υποδειγμα παραγραφου", r"χωρισ περιεχομενο", r"dummy (?:content|text)", r"\bgoes here\b", r"^body copy", r"^heading\.?$", r"^(?:κειμενο|τιτλοσ) ενοτητασ",
        r"placeholder (?:text|paragraph)", r"sample (?:text|paragraph)\b", r"(?:replace|αντικαταστηστε) (?:this|το|it) (?:text|πριν|before)",
    ),
}
LATIN_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat culpa officia deserunt mollit anim laborum".split())
class _Fold(dict):
    """What each character is in folded text."""

    def __missing__(self, c: int) -> str:
        d = unicodedata.normalize("NFD", chr(c))
        self[c] = out = "".join(x for x in d if unicodedata.category(x) != "Mn").replace("ς", "σ")
        return out


_FOLD = _Fold()


def folded(s: str) -> str:
    """Lower case, no accents, one form of sigma."""
    return s.lower().translate(_FOLD)


def required(pattern: list) -> set[str]:
    """Literals of which every match of a parsed pattern holds one; none if only single characters are certain."""
    best: set[str] = set()
    run = ""

    def offer(x: set[str]) -> None:
        nonlocal best
        if x and min(map(len, x)) > 1 and (min(map(len, x)), -len(x)) > (min(map(len, best), default=0), -len(best)):
            best = x

    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        tail = ""
        if name == "MAX_REPEAT" and arg[0] and all(str(o) == "LITERAL" for o, _ in arg[2]):
            tail = "".join(chr(c) for _, c in arg[2]) * arg[0]
            run += tail
        offer({run})
        run = tail
        if name == "SUBPATTERN":
            offer(required(arg[3]))
        elif name == "MAX_REPEAT" and arg[0]:
            offer(required(arg[2]))
        elif name == "BRANCH":
            each = [required(x) for x in arg[1]]
            offer(set().union(*each) if all(each) else set())
    offer({run})
    return best


@lru_cache(maxsize=1)
def _rules() -> tuple[re.Pattern, dict[int, re.Pattern], ahocorasick.Automaton]:
    a = ahocorasick.Automaton()
    for p in (*PLACEHOLDER_FORMS, *itertools.chain(*MESSAGES.values())):
        for t in required(list(_parser.parse(p))):
            a.add_word(folded(t), t)
    a.make_automaton()
    return re.compile(PLACEHOLDERS, re.IGNORECASE), {k: re.compile("|".join(v)) for k, v in MESSAGES.items()}, a


#: The forms that have only single characters for certain.
LONE = re.compile(r"[{<\[%$#«][^\W\d]|\{\d")
LATIN = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(LATIN_FILLER))})(?![^\W\d_])")


#: Least share of a segment that a message has to take up for the segment's label to spread.
WHOLE = 0.4


def label(segment: str) -> tuple[int, bool]:
    """The trusted label of a segment, 0 if there is none, and whether the segment is nothing else, so that its label may spread."""
    placeholders, messages, _ = _rules()
    for m in placeholders.finditer(segment):
        # the words that are values only in this spelling
        if m.group().lower() in ("nan", "null", "undefined", "todo", "tbd", "fixme") and m.group() not in ("NaN", "null", "undefined", "TODO", "TBD", "FIXME"):
            continue
        return PLACEHOLDER, False
    f = folded(segment)
    for kind, p in messages.items():
        if m := p.search(f):
            return kind, len(m.group()) >= WHOLE * len(f.strip())
    words = re.findall(r"[^\W\d_]+", f)
    n = sum(w in LATIN_FILLER for w in words)
    return (FILLER, n >= 0.9 * len(words)) if n >= max(3, 0.6 * len(words)) else (0, False)


def suspicious(text: str) -> bool:
    """Whether any trusted form may be in the text."""
    f = folded(text)
    return next(_rules()[2].iter(f), None) is not None or LONE.search(text) is not None or next(itertools.islice(LATIN.finditer(f), 2, None), None) is not None


def repeated(h: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """First words of runs of one word four times over, numbers aside."""
    if len(h) < 4:
        return np.zeros(0, np.int64)
    same = (h[:-3] == h[1:-2]) & (h[:-3] == h[2:-1]) & (h[:-3] == h[3:]) & (rec[:-3] == rec[3:])
    at = np.flatnonzero(same)
    return at[~np.isin(h[at], Words(["0" * k for k in range(1, 20)]).hash)] if len(at) else at


def simhash(h: np.ndarray, rec: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of each text from its words and neighbouring pairs."""
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * MIX1 + h[1:])[rec[:-1] == rec[1:]] if len(h) > 1 else h[:0]
    owner = np.concatenate([rec, rec[:-1][rec[:-1] == rec[1:]]]) if len(h) > 1 else rec
    x = np.concatenate([h, pair])
    order = np.argsort(owner, kind="stable")
    x, owner = x[order], owner[order]
    out = np.zeros(n, np.uint64)
    if not len(x):
        return out
    some = np.unique(owner)
    begin = np.searchsorted(owner, some)
    half = np.diff(np.append(begin, len(x))) / 2
    bits = np.zeros(len(some), np.uint64)
    for b in range(64):
        one = np.add.reduceat(((x >> np.uint64(b)) & np.uint64(1)).astype(np.int32), begin)
        bits |= (one > half).astype(np.uint64) << np.uint64(b)
    out[some] = bits
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j in chunks(texts):
            owner: list[int] = []
            parts: list[str] = []
            labels: list[tuple[int, bool]] = []
            for doc, text in zip(ids[i:j], texts[i:j]):
                own = [s for s in CUT.split(text) if s]
                parts += own
                owner += [doc] * len(own)
                labels += [label(s) if suspicious(s) else (0, False) for s in own] if suspicious(text) else [(0, False)] * len(own)
            if not parts:
                continue
            w = Words(parts, digits_alike=True)
            n = len(parts)
            for k in np.unique(w.rec[repeated(w.hash, w.rec)]):
                if not labels[k][0]:
                    labels[k] = (FILLER, len(np.unique(w.hash[w.first[k] : w.first[k + 1]])) <= 2)
            sim = simhash(w.hash, w.rec, n)
            order = np.lexsort((w.hash, w.rec))
            h, r = w.hash[order], w.rec[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[new], r[new]
            key = np.zeros(n, np.uint64)
            if len(h):
                some = np.unique(r)
                with np.errstate(over="ignore"):
                    key[some] = np.add.reduceat(mix(h), np.searchsorted(r, some))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32)), pa.array(h.view(np.int64) >> 24))
            out = pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(key.view(np.int64)), pa.array(sim.view(np.int64)), lists, pa.array([k for k, _ in labels], pa.int32()), pa.array([b for _, b in labels])], names=["doc_id", "segment", "simhash", "words", "label", "whole"])
            keep = np.array([k for k, _ in labels]) > 0
            keep |= np.diff(np.searchsorted(r, np.arange(n + 1))) > 0
            yield out.filter(pa.array(keep))


def _prefix(frontier: DataFrame, often: DataFrame, similarity: float) -> DataFrame:
    """word, s, w, l: for each labelled segment its rarest words, of which every segment as alike as `similarity` has one."""
    each = frontier.select("segment", F.explode("words").alias("word")).join(often, "word", "left").groupBy("segment").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("a"))
    # a millionth less, lest rounding shorten a prefix
    most = F.size("a") - F.ceil(F.size("a") * F.lit(similarity) - 1e-6).cast("int") + 1
    first = each.select("segment", F.explode(F.slice("a", 1, F.least(F.size("a"), most))).alias("x")).select("segment", "x.word")
    return first.join(frontier.select("segment", F.col("simhash").alias("s"), F.col("words").alias("w"), F.col("label").alias("l")), "segment").drop("segment")


def residue(documents: DataFrame, similarity: float = 0.8, distance: int = 16) -> DataFrame:
    """doc_id, label, spread of the documents that hold residue (the least label: 1 placeholder, 2 error, 3 script notice, 4 filler; spread: only by likeness).

    documents: doc_id, text; other columns are ignored. Null ids and null or empty texts take no part; rows given more than once count once.
    similarity: least share of common words (numbers alike) for a label to spread between segments; distance: most differing bits.
    """
    rows = documents.select("doc_id", "text").where("doc_id is not null and text <> ''")
    seg = stage(spread(rows).mapInArrow(_segments, SEGMENTS), "residue-segments")
    found = seg.where("label > 0").select("doc_id", "label", F.lit(False).alias("spread"))
    rest = seg.where("label = 0")
    known = seg.where("whole").groupBy("segment").agg(F.first("simhash").alias("simhash"), F.first("words").alias("words"), F.min("label").alias("label"))
    frontier = known = stage(known, "residue-known")
    once = stage(rest.groupBy("segment").agg(F.first("simhash").alias("simhash"), F.first("words").alias("words")), "residue-once")
    often = stage(once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "residue-words")
    while True:
        near = stage(_prefix(frontier, often, similarity), "residue-near")
        hit = once.select("*", F.explode("words").alias("word")).join(checked_broadcast(near), "word")
        alike = (F.size("words") >= similarity * F.size("w") - 1e-6) & (F.size("w") >= similarity * F.size("words") - 1e-6)
        hit = hit.where(alike & (F.bit_count(F.col("simhash").bitwiseXOR(F.col("s"))) <= distance)).where(F.size(F.array_intersect("words", "w")) >= similarity * F.size(F.array_union("words", "w")))
        fresh = hit.groupBy("segment").agg(F.first("simhash").alias("simhash"), F.first("words").alias("words"), F.min("l").alias("label"))
        fresh = stage(fresh.join(known.select("segment"), "segment", "left_anti"), "residue-fresh")
        if fresh.isEmpty():
            break
        known, frontier = known.unionByName(fresh), fresh
    alike_ones = rest.select("doc_id", "segment").join(checked_broadcast(known.select("segment", F.col("label"))), "segment").select("doc_id", "label", F.lit(True).alias("spread"))
    return found.unionByName(alike_ones).groupBy("doc_id").agg(F.min("label").alias("label"), F.bool_and("spread").alias("spread"))


def without_residue(documents: DataFrame, **params: float) -> DataFrame:
    """The documents that hold none; rows with null ids or without text stay."""
    return documents.join(residue(documents, **params).select("doc_id"), "doc_id", "left_anti")
