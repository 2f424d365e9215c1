"""Term dictionaries: loading, mining, matching against texts, rule closure and filters.

A dictionary is (term, codes array<string>) with normalized terms. Texts are frames with an id and a text column; null and empty texts match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import let, ngrams, normalize_text, tokenize
from ..plans.staging import checked_broadcast, stage


def load(raw: DataFrame, term: str = "term", codes: str = "codes_pipe_sep", blacklist: list[str] | None = None) -> DataFrame:
    """term, codes: normalized terms, blank and blacklisted ones dropped, codes of equal terms united."""
    t = normalize_text(F.col(term), fold_sigma=True)
    rows = raw.select(t.alias("term"), F.explode(F.split(codes, "\\|")).alias("code")).select("term", F.trim("code").alias("code")).where("term <> '' and code <> ''")
    if blacklist:
        rows = rows.where(~F.col("term").isin(blacklist))
    return rows.groupBy("term").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def load_last_wins(raw: DataFrame, order: str, term: str = "term", codes: str = "codes_pipe_sep") -> DataFrame:
    """term, codes: of rows whose terms are equal after normalization the one with the greatest `order` wins."""
    t = raw.select(normalize_text(F.col(term), fold_sigma=True).alias("term"), F.col(codes).alias("c"), F.col(order).alias("o")).where("term <> ''")
    return t.groupBy("term").agg(F.max_by("c", "o").alias("c")).select("term", F.array_sort(F.array_distinct(F.split("c", "\\|"))).alias("codes"))


def by_code(dictionary: DataFrame) -> DataFrame:
    """The inverse: code, its terms joined, sorted."""
    return dictionary.select(F.explode("codes").alias("code"), "term").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


#: Terms that one automaton holds, about 100 bytes each; larger dictionaries are joined.
AUTOMATON_TERMS = 1_000_000


def match(texts: DataFrame, dictionary: DataFrame, key: str = "record_id", text: str = "text", whole_words: bool = True) -> DataFrame:
    """key, term, codes: every term that stands in the normalized text, as whole tokens or anywhere, each once for a text.

    Texts are normalized in the JVM and stream past one automaton of all terms. A dictionary of more than AUTOMATON_TERMS terms isn't sent to
    the executors: whole terms then meet the texts' n-grams in a join; terms inside words have no such way, which is an error.
    """
    rows = dictionary.select("term", "codes").limit(AUTOMATON_TERMS + 1).collect()
    if len(rows) > AUTOMATON_TERMS:
        if not whole_words:
            raise ValueError(f"more than {AUTOMATON_TERMS} terms")
        return match_by_join(texts, dictionary, key, text)
    terms = texts.sparkSession.sparkContext.broadcast({r["term"]: list(r["codes"]) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in terms.value:
            a.add_word(f" {t} " if whole_words else t, t)
        a.make_automaton()
        for b in batches:
            found = [(k, t) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in (sorted({t for _, t in a.iter(f" {s} " if whole_words else s)}) if terms.value else ())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found]), pa.array([terms.value[t] for _, t in found], pa.list_(pa.string()))], names=["key", "term", "codes"])

    norm = texts.select(F.col(key).cast("bigint").alias("key"), normalize_text(F.col(text), fold_sigma=True).alias("t")).where("t <> ''")
    return norm.mapInArrow(run, "key bigint, term string, codes array<string>").withColumnRenamed("key", key)


def match_by_join(texts: DataFrame, dictionary: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """The same for whole terms by joining the distinct n-grams of each text, up to the longest term, with the dictionary."""
    longest = dictionary.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    grams = texts.select(key, F.explode(F.array_distinct(ngrams(tokenize(normalize_text(F.col(text), fold_sigma=True)), longest))).alias("term"))
    return grams.join(checked_broadcast(dictionary), "term").select(key, "term", "codes")


def match_substring(texts: DataFrame, dictionary: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """key, term, codes: every term that stands anywhere in the normalized text, also inside words."""
    return match(texts, dictionary, key, text, whole_words=False)


def predict(texts: DataFrame, dictionary: DataFrame, key: str = "record_id", text: str = "text", whole_words: bool = True) -> DataFrame:
    """key, codes: sorted distinct codes of the terms in each text; texts without a match are absent."""
    m = match(texts, dictionary, key, text, whole_words).select(key, F.explode("codes").alias("code"))
    return m.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def mine(mentions: DataFrame, shortest: int = 4, least: int = 1, share: float = 0.2, blacklist: list[str] | None = None) -> DataFrame:
    """term, codes mined from mentions (mention, code): terms of enough letters and mentions, codes with at least a share of the term's mentions."""
    t = mentions.select(normalize_text(F.col("mention"), fold_sigma=True).alias("term"), "code").where(f"char_length(term) >= {shortest} and code is not null")
    if blacklist:
        t = t.where(~F.col("term").isin(blacklist))
    n = t.groupBy("term", "code").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("term"))
    kept = n.withColumn("total", total).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))
    return kept.groupBy("term").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def split_section(norm: str, headers: list[str], stops: list[str]) -> tuple[str, str]:
    """SQL for (segment, rest): from the earliest header to the first stop marker after it, and the text without that."""
    at = "least(" + ", ".join(f"if(locate('{h}', {norm}) = 0, 1000000000, locate('{h}', {norm}))" for h in [*headers, headers[0]]) + ")"
    after = f"substring({norm}, {at})"
    end = "least(" + ", ".join(f"if(locate('{s}', {after}) = 0, 1000000000, locate('{s}', {after}) - 1)" for s in [*stops, stops[0]]) + ")"
    segment = f"if({at} = 1000000000, '', substring({after}, 1, {end}))"
    rest = f"if({at} = 1000000000, {norm}, concat(substring({norm}, 1, {at} - 1), substring({after}, {end} + 1)))"
    return segment, rest


def section_filter(texts: DataFrame, dictionary: DataFrame, headers: list[str], stops: list[str], code: str, key: str = "record_id", text: str = "text") -> DataFrame:
    """key, codes: without codes that match only inside the section, with `code` added where there is such a section. Headers and stops are normalized."""
    norm = texts.select(key, normalize_text(F.col(text), fold_sigma=True).alias("norm"))
    segment, rest = split_section("n", headers, stops)
    parts = norm.select(key, F.expr(f"element_at(transform(array(norm), n -> struct({segment} as segment, {rest} as rest)), 1)").alias("x")).select(key, "x.segment", "x.rest")
    own = predict(parts, dictionary, key, "rest")
    flagged = parts.where("segment <> ''").select(key, F.array(F.lit(code)).alias("extra"))
    none = F.array().cast("array<string>")
    return own.join(flagged, key, "full_outer").select(key, F.array_sort(F.array_union(F.coalesce("codes", none), F.coalesce("extra", none))).alias("codes"))


def negation_filter(texts: DataFrame, pairs: list[tuple[str, str, list[str]]], window: int = 4, key: str = "record_id", text: str = "text", codes: str = "codes") -> DataFrame:
    """key, codes: codes of a (negator, disease, codes) triple removed where the first tokens containing the two are at most window + 1 apart."""

    def kept(tokens: Column) -> Column:
        out = F.col(codes)
        for negator, disease, drop in pairs:
            at = lambda s: F.array_position(F.transform(tokens, lambda x: F.contains(x, F.lit(s))), True)
            near = (at(negator) > 0) & (at(disease) > 0) & (F.abs(at(negator) - at(disease)) <= window + 1)
            out = F.when(near, F.array_except(out, F.array(*map(F.lit, drop)))).otherwise(out)
        return out

    return texts.select(key, let(tokenize(normalize_text(F.col(text), fold_sigma=True)), kept).alias(codes))


def common_length(needle: str, text: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(needle)) - 1
    v = full
    for c in text:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(needle) - v.bit_count()


def windows(m: int, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of a text's windows of m characters, and of its beginnings and ends so long that all of them in common would reach the threshold."""
    least = int(np.ceil(threshold * m / (200.0 - threshold) - 1e-9)) if threshold < 200 else m
    short = np.arange(max(1, least), m)
    full = np.arange(n - m + 1)
    return np.concatenate((full, np.zeros(len(short), np.int64), n - short)), np.concatenate((full + m, short, np.full(len(short), n)))


def partial_ratio(a: str, b: str, threshold: float = 0.0, counts: tuple[dict[str, int], np.ndarray] | None = None) -> float:
    """Greatest likeness of the shorter string with a window of its length in the longer one, or with a beginning or end of it: 200 * common / (both lengths).

    0 if that is below the threshold. Only windows that have enough characters in common with it, in whatever order, are compared; none at the threshold is lost.
    counts: characters of b and how many of each stand before each place.
    """
    if len(a) > len(b):
        a, b, counts = b, a, None
    if not a:
        return 100.0 if not b else 0.0
    known, before = counts or character_counts(b)
    lo, hi = windows(len(a), len(b), threshold)
    bag = np.zeros(len(lo), np.int64)
    for c in set(a) & known.keys():
        row = before[known[c]]
        bag += np.minimum(row[hi] - row[lo], a.count(c))
    best = 0.0
    bound = 200.0 * bag / (len(a) + hi - lo)
    for i in np.flatnonzero(bound >= threshold - 1e-9)[np.argsort(-bound[bound >= threshold - 1e-9], kind="stable")].tolist():
        if bound[i] <= best:
            break
        best = max(best, 200.0 * common_length(a, b[lo[i] : hi[i]]) / (len(a) + hi[i] - lo[i]))
    return best if best >= threshold - 1e-9 else 0.0


def character_counts(text: str) -> tuple[dict[str, int], np.ndarray]:
    """The characters of a text, and for each how many of it stand before each place."""
    known = {c: i for i, c in enumerate(dict.fromkeys(text))}
    codes = np.fromiter(map(known.__getitem__, text), np.int64, len(text))
    before = np.zeros((len(known), len(text) + 1), np.int32)
    before[codes, np.arange(1, len(text) + 1)] = 1
    return known, np.cumsum(before, axis=1, dtype=np.int32)


def fuzzy_fallback(texts: DataFrame, descriptions: DataFrame, threshold: float = 85.0, key: str = "record_id", text: str = "text", covered: DataFrame | None = None, shortest: int = 4, most: int = 10_000) -> DataFrame:
    """key, code: codes whose description (code, description) has at least this partial ratio with the text.

    covered: codes that the dictionary has terms for; only others are looked for. Descriptions of fewer than `shortest` characters are left out. Whole texts are compared, and
    no match is lost: windows that lack the characters for the threshold are left out by running counts, the others are compared.
    """
    wanted = descriptions.select("code", normalize_text(F.col("description"), fold_sigma=True).alias("d")).where(f"char_length(d) >= {shortest}").distinct()
    if covered is not None:
        wanted = wanted.join(covered.select("code").distinct(), "code", "left_anti")
    rows = wanted.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} descriptions")
    shared = texts.sparkSession.sparkContext.broadcast([(r["code"], r["d"]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = character_counts(s)
                out += [(k, c) for c in sorted({code for code, d in shared.value if partial_ratio(d, s, threshold, counts)})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out])], names=["key", "code"])

    norm = texts.select(F.col(key).cast("bigint").alias("key"), normalize_text(F.col(text), fold_sigma=True).alias("t")).where("t <> ''")
    return norm.mapInArrow(run, "key bigint, code string").distinct().withColumnRenamed("key", key)


def candidates(dictionary: DataFrame, descriptions: DataFrame, labels: DataFrame | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """term, codes: the dictionary's terms and the normalized descriptions (code, description) as terms, limited to the codes of a label space, without blacklisted terms."""
    rows = dictionary.select("term", F.explode("codes").alias("code")).unionByName(descriptions.select(normalize_text(F.col("description"), fold_sigma=True).alias("term"), "code")).where("term <> '' and code is not null")
    if labels is not None:
        rows = rows.join(labels.select("code").distinct(), "code", "left_semi")
    if blacklist:
        rows = rows.where(~F.col("term").isin(blacklist))
    return rows.groupBy("term").agg(F.array_sort(F.collect_set("code")).alias("codes"))


@dataclass(frozen=True)
class Chain:
    """What a prediction goes through behind the match, each part in its turn and only if it is given.

    boosts: (patterns, codes added); rules: (if any, then add); section: (headers, stops, code added); negations: (negator, disease, codes) with a window; fuzzy: threshold.
    """

    whole_words: bool = True
    boosts: tuple[tuple[list[str], list[str]], ...] = ()
    rules: tuple[tuple[list[str], list[str]], ...] = ()
    section: tuple[list[str], list[str], str] | None = None
    negations: tuple[tuple[str, str, list[str]], ...] = ()
    window: int = 4
    fuzzy: float | None = None


def cut_section(norm: str, headers: list[str], stops: list[str]) -> tuple[str, str]:
    """(segment, rest) as split_section has them, of one text."""
    at = min((norm.find(h) for h in headers if h in norm), default=-1)
    if at < 0:
        return "", norm
    after = norm[at:]
    end = min((after.find(s) for s in stops if s in after), default=len(after))
    return after[:end], norm[:at] + after[end:]


def _chained(chain: Chain, norm: str, codes: set[str], inside: set[str] | None, outside: set[str] | None) -> set[str]:
    """The codes of one text behind boosts, rules, section and negations. inside, outside: codes of its section and of what is around it, None without a section."""
    now = set(codes)
    for patterns, add in chain.boosts:
        if any(p in norm for p in patterns):
            now.update(add)
    for any_of, add in chain.rules:
        if not now.isdisjoint(any_of):
            now.update(add)
    if inside is not None:
        now = now - (inside - outside) | {chain.section[2]}
    for negator, disease, drop in chain.negations:
        if negator in norm and disease in norm and not now.isdisjoint(drop):
            tokens = norm.split(" ")
            at = [next((i for i, t in enumerate(tokens) if x in t), None) for x in (negator, disease)]
            if None not in at and abs(at[0] - at[1]) <= chain.window + 1:
                now.difference_update(drop)
    return now


def predict_chain(texts: DataFrame, dictionary: DataFrame, chain: Chain, key: str = "record_id", text: str = "text", descriptions: DataFrame | None = None) -> DataFrame:
    """key, codes (sorted; texts without a code are absent): match, boosts, rules, section filter, negation filter, fuzzy fallback, in that order.

    The section filter takes away codes whose terms match only inside the section; codes that boosts and rules added stay, as do those with a match outside.
    Each text is normalized once and goes through the whole chain in one pass; only where the dictionary is larger than AUTOMATON_TERMS what its parts match is joined to it. Keys are given once.
    """
    rows = dictionary.select("term", "codes").limit(AUTOMATON_TERMS + 1).collect()
    norm = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), normalize_text(F.col(text), fold_sigma=True).alias("norm"))
    headers, stops = chain.section[:2] if chain.section else ([], [])
    if len(rows) > AUTOMATON_TERMS:
        norm = _matched_parts(norm, dictionary, headers, stops, chain.whole_words)
        terms = None
    else:
        terms = texts.sparkSession.sparkContext.broadcast({r["term"]: list(r["codes"]) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a, pad = ahocorasick.Automaton(), " " if chain.whole_words else ""
        for t, codes in terms.value.items() if terms is not None else ():
            a.add_word(f"{pad}{t}{pad}", codes)
        a.make_automaton()
        find = lambda x: {c for _, codes in a.iter(f"{pad}{x}{pad}") for c in codes} if len(a) else set()
        for b in batches:
            out = []
            for k, s, *matched in zip(*(c.to_pylist() for c in b.columns)):
                if not s:
                    continue
                if terms is None:
                    codes, *parts = (None if m is None else set(m) for m in matched)
                else:
                    segment, rest = cut_section(s, headers, stops)
                    codes, parts = find(s), [find(" ".join(x.split())) for x in (segment, rest)] if segment else [None, None]
                if now := _chained(chain, s, codes, *parts):
                    out.append((k, list(now)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.list_(pa.string()))], names=["key", "codes"])

    out = norm.mapInArrow(run, "key bigint, codes array<string>").select(F.col("key").alias(key), F.explode("codes").alias("code"))
    if chain.fuzzy is not None and descriptions is not None:
        covered = dictionary.select(F.explode("codes").alias("code"))
        out = out.unionByName(fuzzy_fallback(texts, descriptions, chain.fuzzy, key, text, covered))
    return out.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def _matched_parts(norm: DataFrame, dictionary: DataFrame, headers: list[str], stops: list[str], whole_words: bool) -> DataFrame:
    """key, norm, codes, inside, outside of texts (key, norm): what a dictionary too large for an automaton matches in each, in its section and around it; the latter null without a section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [cut_section(s or "", headers, stops) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in zip(*cut))] if cut else [b.column(0), b.column(1), *[pa.array([], pa.string())] * 2], names=["key", "norm", "segment", "rest"])

    parts = stage(norm.mapInArrow(run, "key bigint, norm string, segment string, rest string"), "chain-parts")
    none = F.array().cast("array<string>")
    found = lambda x, name: predict(parts.where("segment <> ''") if x != "norm" else parts, dictionary, "key", x, whole_words).withColumnRenamed("codes", name)
    j = parts.join(found("norm", "codes"), "key", "left").join(found("segment", "inside"), "key", "left").join(found("rest", "outside"), "key", "left")
    within = lambda c: F.when(F.col("segment") != "", F.coalesce(c, none))
    return j.select("key", "norm", F.coalesce("codes", none).alias("codes"), within("inside").alias("inside"), within("outside").alias("outside"))


def coverage(gold: DataFrame, predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: documents, documents with a prediction, labels, labels predicted, both ratios to four digits."""
    docs = gold.select("record_id").distinct()
    n = docs.join(predicted.where(F.size("codes") > 0).select("record_id").distinct().withColumn("p", F.lit(1)), "record_id", "left").agg(F.count("*").alias("documents"), F.count("p").alias("predicted"))
    c = labels.select("code").distinct().join(predicted.select(F.explode("codes").alias("code")).distinct().withColumn("p", F.lit(1)), "code", "left").agg(F.count("*").alias("labels"), F.count("p").alias("labels_predicted"))
    return n.join(F.broadcast(c)).select("*", F.round(L.ratio(F.col("predicted"), F.col("documents")), 4).alias("document_coverage"), F.round(L.ratio(F.col("labels_predicted"), F.col("labels")), 4).alias("label_coverage"))


def coverage_codes(predicted: DataFrame, labels: DataFrame, top: int = 20) -> DataFrame:
    """kind (predicted, missing), code, documents: the codes predicted most often, ties by code, and the labels that no document has."""
    n = predicted.select("record_id", F.explode("codes").alias("code")).distinct().groupBy("code").agg(F.count("*").alias("documents"))
    first = n.orderBy(F.desc("documents"), "code").limit(top).select(F.lit("predicted").alias("kind"), "code", "documents")
    missing = labels.select("code").distinct().join(n, "code", "left_anti").select(F.lit("missing").alias("kind"), "code", F.lit(0).cast("bigint").alias("documents"))
    return first.unionByName(missing)
