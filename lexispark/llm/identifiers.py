"""Personal information inside free text, by bootstrapped contextual extraction.

Plan. One Arrow pass over the texts finds instances: stretches with the shape of an e-mail address, a telephone or identity number, a street address or a
personal name, each with the words on its left and right, and writes them down once. A few instances are seeds: their shape alone settles their kind. Contexts
of seeds become patterns; a graph of patterns and instances is scored in rounds in Spark: a pattern's confidence is the share of its instances
that are known, an instance's the best of its patterns, with counts that are added up before they are shuffled. Patterns of high confidence discover further instances, whose
surface joins the known ones. The result is every instance of an accepted kind; placeholders are put in by a second pass over the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..plans.staging import checked_broadcast, spread, stage

INSTANCES = "record_id bigint, kind string, found_value string, begin int, seed boolean, tokens array<string>, patterns array<string>"
#: Least share of known instances for a pattern of a kind to be accepted.
CONFIDENCE = {"email": 0.05, "id_number": 0.3, "phone": 0.06, "address": 0.2, "name": 0.6}

# Words that stand before identity numbers, streets and towns, in the languages of the texts.
ID_LABEL = r"(?:Α\.?\s?Μ\.?\s?Κ\.?\s?Α\.?|A\.?M\.?K\.?A\.?|αριθμός μητρώου κοινωνικής ασφάλισης|αρ\.? μητρώου(?: κοινωνικής ασφάλισης)?|Α\.?\s?Φ\.?\s?Μ\.?|A\.?F\.?M\.?|αριθμός φορολογικού μητρώου|φορολογικό μητρώο|Α\.?\s?Δ\.?\s?Τ\.?|A\.?D\.?T\.?|αρ(?:\.|ιθμός) ταυτότητας|δελτίο ταυτότητας|ταυτότητα|αρ(?:\.|ιθμός) διαβατηρίου|διαβατήριο|passport(?: (?:no\.?|number))?|Α\.?Τ\.|national insurance(?: (?:no\.?|number))?|identity card(?: no\.?)?|id card(?: no\.?)?|social security(?: (?:no\.?|number))?|tax (?:id|no\.?|number))"
#: Letters, with the marks and invisible characters that may stand in a word.
LETTERS = r"A-Za-zÀ-ɏͰ-Ͽἀ-῿\u0400-\u04ff\u0300-\u036f\u200b-\u200d\u2060\ufeff\u00ad"
UPPER = r"A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏΪΫ\u0400-\u042f"
#: White space within a line.
S = r"[^\S\r\n]"
STREET = r"(?:[Οο]δός|[Οο]δού|ΟΔΟΣ|[Οο]δ\.|[Λλ]εωφ(?:όρος|\.)|ΛΕΩΦ(?:ΟΡΟΣ|\.)|[Ππ]λατεία|ΠΛΑΤΕΙΑ|[Ππ]λ\.|[Ππ]άροδος|ΠΑΡΟΔΟΣ)"
WORD = rf"[{UPPER}](?:['’][{UPPER}])?[{LETTERS}]+"
PLACE = rf"(?:(?:Άνω|Κάτω|Νέο|Νέα|Νέος|Παλιό|Παλαιό|Παλαιά|Παλιά|Μέσα|Έξω|Πέρα|Άγιος|Αγία|Άγιοι|ΑΝΩ|ΚΑΤΩ|ΝΕΟ|ΝΕΑ|ΠΑΛΙΟ|ΠΑΛΑΙΟ|ΠΑΛΑΙΑ|ΠΕΡΑ|ΑΓΙΟΣ|ΑΓΙΑ){S})?{WORD}(?:{S}{WORD})?"
CODE = rf"(?:(?:[ΤT]\.?{S}?[ΚK]\.?{S}?)?\d{{3}}{S}?\d{{2}})(?!\d)"
NUMBER = rf"(?:(?:αρ(?:ιθ)?\.?|αριθμός|no\.?){S}?)?\d{{1,3}}(?:{S}?[Α-ΩA-Z])?(?![\w/.:-]\w|\w)"
TAIL = rf"(?:,?{S}(?:{CODE},?{S}{PLACE}|{PLACE}(?:,?{S}{CODE})?|{CODE}))"
CROSSING = rf"(?:{S}?&{S}?(?:{STREET}{S}?)?{WORD}(?:{S}{WORD})?(?:{S}{NUMBER})?)"
ADDRESS = re.compile(rf"(?<![\w-])(?:{STREET}{S}?{WORD}(?:{S}{WORD}){{0,2}}{S}{NUMBER}{CROSSING}?{TAIL}?|{WORD}(?:{S}{WORD}){{0,2}}{S}{NUMBER}(?:{CROSSING}{TAIL}?|{TAIL}))")
#: The same in English: number, street, town, postcode.
ROAD = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Square|Drive|Terrace|Gardens|Crescent)"
ENGLISH = re.compile(rf"(?<![\w./-])\d{{1,4}}[A-Za-z]?{S}(?:{WORD}{S}){{1,3}}{ROAD}(?!\w)(?:,{S}{WORD}(?:{S}{WORD})?)?(?:,?{S}[A-Z]{{1,2}}\d[\dA-Z]?(?:{S}\d[A-Z]{{2}})?)?(?!\w)")
ROADS = re.compile(rf"[a-z]{S}{ROAD}(?!\w)")
#: What every address has: a street's word, or a short number before a comma, a crossing, a postcode or a capital.
HINT = re.compile(rf"[Οο]δός|[Οο]δού|ΟΔΟΣ|[Οο]δ\.|εωφ|ΛΕΩΦ|λατεία|ΠΛΑΤΕΙΑ|άροδος|ΠΑΡΟΔΟΣ|(?<=[{LETTERS}]{S})\d{{1,3}}{S}?[Α-ΩA-Z]?(?:,{S}(?:\d{{3}}{S}?\d\d|[{UPPER}])|{S}(?:\d{{3}}{S}?\d\d|[{UPPER}])|{S}?&)")
EMAIL = re.compile(
    rf"[\w.+-]+\s?@\s?[\w-]+(?:\.[\w-]+)+|[\w.+-]+\s?[(\[]\s?(?:a|at|παπάκι|παπακι)\s?[)\]]\s?[\w-]+(?:(?:\.|\s?[(\[]\s?(?:dot|τελεία|τελεια)\s?[)\]]\s?)[\w-]+)+|[\w.+-]+ (?:at|παπάκι) [\w-]+(?:\.[\w-]+)*(?:(?: (?:dot|τελεία) |\.)[\w-]+)+",
    re.IGNORECASE,
)
#: What makes an address by itself; other spellings of the sign are judged by their contexts.
AT = re.compile(r"@|[(\[]\s?(?:at|παπάκι|παπακι)\s?[)\]]", re.IGNORECASE)
#: Numbers in other groups: abroad behind a prefix, or at home ten digits that begin as lines and mobiles do.
PHONE_GROUPS = re.compile(r"(?<![\w.,/+(-])(?:(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]\d{2,5}){2,5}|[26]\d{1,3}(?:[ .-]\d{2,4}){2,4})(?![\w]|[.,/-]\d)")
PHONE = re.compile(r"(?<![\w.,/+(-])(?<!\d:)(?:(?:\+|00)\s?\d{2}[\s.\-/]?)?(?:\(\d{3,4}\)|\d{3,4})[\s.\-/]?\d{3}[\s.\-/]?\d{3,4}(?![\w]|[.,/-]\d)")
#: What may stand between a label and its number: whose it is, the office, a sign.
OWNER = r"(?:\s?/\s?[^\W\d]{2,4}\.?)?(?:\s(?:του|της|of|του/της)(?:\s(?:the|κ\.))?)?(?:\s(?:ασθεν\w+|πατρ\w+|μητρ\w+|συζύγ\w+|τέκν\w+|συνοδ\w+|patient|spouse|mother|father))?\s?[:=#–-]?\s?"
ID_SHAPE = rf"(?:\d{{6}}[\s-]?\d{{5}}|\d{{3}}[\s.-]\d{{3}}[\s.-]\d{{3}}|\d{{6,12}}|[{UPPER}]{{1,2}}[\s-]?\d{{5,8}})(?!\w)"
ID_NUMBER = re.compile(rf"(?<!\w)({ID_LABEL}){OWNER}({ID_SHAPE})", re.IGNORECASE)
#: The same shapes without a label: their contexts decide.
ID_OPEN = re.compile(rf"(?<![\w.,/+-])(?:\d{{6}}[ -]?\d{{5}}|\d{{9}}|[{UPPER}]{{1,2}}[ -]?\d{{6,7}})(?![\w]|[.,/-]\d)")
#: A name: two or three capitalised words of which one may be initials, either order.
INITIAL = rf"[{UPPER}]\.(?:[ -]?[{UPPER}]\.)?"
FULL = rf"{WORD}(?:-{WORD})?"
#: Neighbouring candidates may share a word; their contexts decide.
NAME = re.compile(rf"(?<![\w@.&/-])(?=((?!(?:Dr|Mr|Mrs|Ms|Prof|Δρ)\b)(?:{INITIAL}{S}?{FULL}|{FULL}{S}{INITIAL}{S}?{FULL}(?=[,;)\r\n]|\.(?:\s|$)|$)|{FULL},?{S}(?:{INITIAL}|{FULL})(?![\w@]))))[{UPPER}]")
#: What settles by itself that a person follows.
TITLE = re.compile(r"(?:^|[^\w])(?:κ\.|κα|κος|[Κκ]ύριο[ςυν]?|[Κκ]υρίου|[Κκ]υρία[ςν]?|Δρ\.?|Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Miss|Prof\.?|Ονοματεπώνυμο:|Full name:)\s$")
#: Heads of signs, scales and syndromes: the name after them is no person's.
EPONYM = frozenset("σημειο δοκιμασια κλιμακα συνδρομο νοσοσ sign test scale syndrome disease".split())
SINGLE = re.compile(rf"(?<!\w)(?:κ\.|κα|[Κκ]ύριο[ςυν]?|[Κκ]υρίου|[Κκ]υρία[ςν]?|Δρ\.|Dr\.?|Mr\.?|Mrs\.?|Miss)\s({FULL})")


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in s if unicodedata.category(c) != "Mn").replace("ς", "σ")


def context(text: str, begin: int, end: int) -> tuple[str, str]:
    """The two words before and the word after a stretch, folded, numbers alike; '^' at the ends of a sentence or line."""
    left = re.split(r"[\n\r]|(?<=[^\W\d_]{3}[.!?])\s", text[max(0, begin - 40) : begin])[-1]
    right = re.split(r"[\n\r]", text[end : end + 24])[0]
    lw = re.findall(r"[^\W\d_]+|\d+|[:/(@.]", left)
    rw = re.findall(r"[^\W\d_]+|\d+|[.,/)@]", right)
    fold = lambda ws: " ".join("0" if w.isdigit() else _plain(w) for w in ws)
    return fold(lw[-2:]) or "^", fold(rw[:1]) or "^"


def tokens(kind: str, value: str) -> list[str]:
    """What an instance shares with other instances of its kind: its words, or its digits."""
    if kind in ("name", "address"):
        return sorted({w for w in map(_plain, re.findall(r"[^\W\d_]{3,}", value))})
    return ["".join(c for c in _plain(value) if c.isalnum())]


def patterns(left: str, right: str) -> list[str]:
    """Lexical patterns of a context: two words on the left, one, and one on either side."""
    last = left.split(" ")[-1]
    return [f"{left} _", f"{last} _ {right}"] if last == left else [f"{left} _", f"{last} _ {right}", f"{last} _"]


def instances(text: str) -> list[tuple[str, int, int, bool]]:
    """Stretches of a text that have the shape of a kind: kind, begin, end, seed."""
    out: list[tuple[str, int, int, bool]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def take(kind: str, a: int, b: int, seed: bool) -> None:
        if free(a, b):
            taken.append((a, b))
            out.append((kind, a, b, seed))

    low = text.lower()
    if "@" in text or "παπάκι" in low or "(at)" in low or "[at]" in low or "(a)" in low or "[a]" in low or " dot " in low or "τελεία" in low:
        for m in EMAIL.finditer(text):
            b = m.start() + len(m.group().rstrip(".-"))
            take("email", m.start(), b, AT.search(m.group()) is not None)
    digits = LONG.search(text) is not None
    if digits:
        for m in ID_NUMBER.finditer(text):
            value = m.group(2)
            n = sum(c.isdigit() for c in value)
            if 6 <= n <= 12:
                take("id_number", m.start(2), m.start(2) + len(value.rstrip(" -")), True)
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 10 <= n <= 14:
                take("phone", m.start(), m.end(), m.group().startswith(("+", "00")))
        for m in PHONE_GROUPS.finditer(text):
            n, abroad = sum(c.isdigit() for c in m.group()), m.group().startswith(("+", "00"))
            if 9 <= n <= 15 if abroad else n == 10:
                take("phone", m.start(), m.end(), abroad)
        for m in ID_OPEN.finditer(text):
            take("id_number", m.start(), m.end(), False)
    if HINT.search(text):
        for m in ADDRESS.finditer(text):
            take("address", m.start(), m.end(), re.match(STREET, m.group()) is not None)
    if ROADS.search(text):
        for m in ENGLISH.finditer(text):
            take("address", m.start(), m.end(), True)
    names = [(*m.span(1), TITLE.search(text[max(0, m.start() - 20) : m.start()]) is not None) for m in NAME.finditer(text)]
    for a, b, seed in names:
        if seed:
            take("name", a, b, True)
    out += [("name", a, b, False) for a, b, seed in names if not seed and free(a, b) and EPONYM.isdisjoint(_plain(text[a:b]).split())]
    if "κ." in text or "Δρ" in text or "Dr" in text or "κα " in text or "Mr" in text or "ύρι" in text or "υρί" in text or "Miss" in text:
        for m in SINGLE.finditer(text):
            take("name", m.start(1), m.end(1), True)
    return out


LONG = re.compile(r"\d[\d\s.()/-]{4,}\d")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
    names = ["record_id", "kind", "found_value", "begin", "seed", "tokens", "patterns"]
    for b in batches:
        rows: list[tuple] = []
        for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for kind, begin, end, seed in instances(text):
                value = text[begin:end]
                rows.append((rid, kind, value, begin, seed, tokens(kind, value), patterns(*context(text, begin, end))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class Extraction:
    """Bootstrapped extraction over records (record_id, text; other columns are ignored).

    Null ids and null or empty texts take no part; a record given more than once counts once for its result. confidence: least share of known
    instances of an accepted pattern, by kind; support: fewest known instances; rounds end when no new pattern is accepted.
    """

    def __init__(self, records: DataFrame, confidence: dict[str, float] | None = None, support: int = 2) -> None:
        self.records = records.select("record_id", "text").where("record_id is not null and text <> ''")
        self.confidence = CONFIDENCE | (confidence or {})
        self.support = support

    def least(self) -> Column:
        out = F.lit(1.0)
        for k, v in self.confidence.items():
            out = F.when(F.col("kind") == k, v).otherwise(out)
        return out

    def accepted(self) -> DataFrame:
        """record_id, kind, found_value, begin of the accepted instances."""
        every = stage(spread(self.records).mapInArrow(_rows, INSTANCES), "identifiers-instances")
        sure = every.where("seed")
        open_kinds = every
        links = open_kinds.select("kind", F.explode("tokens").alias("token"), "seed")
        # token nodes: how often in seeds, how often at all
        known = links.groupBy("kind", "token").agg(F.sum(F.col("seed").cast("int")).alias("k"), F.count("*").alias("n")).where("k > 0 and k >= 0.1 * n").select("kind", "token")
        known = stage(known, "identifiers-known")
        good, size = None, 0
        while True:
            ids = open_kinds.select("record_id", "kind", "begin", "seed", "patterns", F.explode_outer("tokens").alias("token"))
            marked = ids.join(checked_broadcast(known.withColumn("hit", F.lit(1))), ["kind", "token"], "left").groupBy("record_id", "kind", "begin").agg(F.first("patterns").alias("patterns"), F.max(F.greatest(F.col("seed").cast("int"), F.coalesce("hit", F.lit(0)))).alias("hit"))
            scored = marked.select("kind", "hit", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
            good = stage(scored.where((F.col("k") >= self.support) & (F.col("k") >= self.least() * F.col("n"))).select("kind", "pattern"), "identifiers-patterns")
            now = good.count()
            if now <= size:
                break
            size = now
            inside = self._inside(open_kinds, good)
            a = inside.select("kind", F.explode("tokens").alias("token")).groupBy("kind", "token").agg(F.count("*").alias("k"))
            b = links.groupBy("kind", "token").agg(F.count("*").alias("n"))
            fresh = a.join(b, ["kind", "token"]).where("k >= 0.8 * n").select("kind", "token")
            known = stage(known.union(fresh).distinct(), "identifiers-known")
        # a word that introduces names in an accepted pattern is no part of one
        heads = good.where("kind = 'name'").select("kind", F.regexp_extract("pattern", r"(\S+) _", 1).alias("head")).where("char_length(head) > 2").distinct()
        new = self._inside(open_kinds.where(~F.col("seed")), good).withColumn("head", F.element_at(F.split(normalize_text(F.col("found_value"), fold_sigma=True), " "), 1))
        new = new.join(checked_broadcast(heads), ["kind", "head"], "left_anti")
        cols = ["record_id", "kind", "found_value", "begin"]
        return sure.select(*cols).unionByName(new.select(*cols)).dropDuplicates(["record_id", "kind", "begin"])

    @staticmethod
    def _inside(rows: DataFrame, good: DataFrame) -> DataFrame:
        """Instances with an accepted pattern: each pattern of a row is looked up, no row is multiplied for good."""
        hit = rows.withColumn("pattern", F.explode("patterns")).join(checked_broadcast(good), ["kind", "pattern"], "left_semi")
        return hit.dropDuplicates(["record_id", "kind", "begin"]).drop("pattern")


def found(records: DataFrame, **params: object) -> DataFrame:
    """record_id, kind, found_value, each once."""
    return Extraction(records, **params).accepted().select("record_id", "kind", "found_value").distinct()


def redacted(records: DataFrame, **params: object) -> DataFrame:
    """record_id, text with each stretch replaced by a placeholder such as [NAME] and everything else unchanged."""
    x = Extraction(records, **params)
    spans = x.accepted().groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("begin", F.char_length("found_value").alias("n"), "kind"))).alias("spans"))
    # pieces between the stretches, left to right
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc.done, F.substring(F.col("text"), acc.at + 1, s.begin - acc.at), F.lit("["), F.upper(s.kind), F.lit("]")).alias("done"), (s.begin + s.n).alias("at"))
    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc.done, F.substring(F.col("text"), acc.at + 1, F.char_length("text"))))
    rows = records.where("record_id is not null").select("record_id", "text").dropDuplicates(["record_id"])
    return rows.join(spans, "record_id", "left").select("record_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole).alias("text"))
