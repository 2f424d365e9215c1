"""Mentions as half-open codepoint spans: parsing, dictionary extraction, merging, linking, BIO labels, CRF decoding, span metrics.

Mentions: (mention_id, record_id, span_start, span_end, code, mention, confidence, source). Null and invalid spans are dropped by parse(); identical spans stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import let, normalize_text


def parse(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Mentions whose span lies in their text, with a null mention replaced by its slice. texts: record_id, text."""
    j = mentions.join(texts.select("record_id", "text"), "record_id")
    ok = "span_start >= 0 and span_end > span_start and span_end <= char_length(text)"
    own = F.coalesce("mention", F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")))
    return j.where(ok).withColumn("mention", own).drop("text")


def validation(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: documents, mentions, codes, invalid spans."""
    j = texts.select("record_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).join(mentions, "record_id", "left")
    bad = (F.col("span_start") < 0) | (F.col("span_end") <= F.col("span_start")) | (F.col("span_end") > F.col("n"))
    return j.agg(F.countDistinct("record_id").alias("documents"), F.count("mention_id").alias("mentions"), F.countDistinct("code").alias("codes"), F.count_if(bad).alias("invalid"))


class _Plain(dict):
    """What each character is in normalized text: letters without accents, digits, or a space."""

    def __missing__(self, ch: str) -> str:
        plain = [c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c) != "Mn"]
        self[ch] = out = "".join("σ" if c == "ς" else c if "a" <= c <= "z" or "0" <= c <= "9" or "α" <= c <= "ω" else " " for c in plain)
        return out


_PLAIN = _Plain()


def char_map(text: str) -> tuple[str, list[int]]:
    """A text normalized character by character, and for each of its characters the index of the original one."""
    parts = [_PLAIN[c] for c in text]
    whole = "".join(parts)
    at = range(len(text)) if len(whole) == len(text) else [i for i, p in enumerate(parts) for _ in p]
    # one space stays of each run, none at the ends
    keep = [m.span() for m in WORD_OR_SPACE.finditer(whole.rstrip(" "), len(whole) - len(whole.lstrip(" ")))]
    return "".join(whole[a : a + 1] if whole[a] == " " else whole[a:b] for a, b in keep), [at[k] for a, b in keep for k in (range(a, a + 1) if whole[a] == " " else range(a, b))]


WORD_OR_SPACE = re.compile(" +|[^ ]+")


def dictionary_spans(text: str, automaton, words_only: bool = True) -> list[tuple[int, int, str]]:
    """Spans of all terms in a text by original offsets, overlapping ones too: (start, end, term), each span once, by start and falling length."""
    norm, at = char_map(text)
    found: dict[tuple[int, int], str] = {}
    if norm:
        for end, term in automaton.iter(norm):
            start = end - len(term) + 1
            if words_only and ((start and norm[start - 1] != " ") or (end + 1 < len(norm) and norm[end + 1] != " ")):
                continue
            found.setdefault((at[start], at[end] + 1), term)
    return sorted(((a, b, t) for (a, b), t in found.items()), key=lambda x: (x[0], -x[1]))


def extract(texts: DataFrame, dictionary: DataFrame, shortest: int = 3, most: int = 1_000_000) -> DataFrame:
    """record_id, span_start, span_end, term of all dictionary terms of enough letters, as whole words. dictionary: normalized term."""
    terms = [r[0] for r in dictionary.select("term").where(f"char_length(term) >= {shortest}").distinct().limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} terms")
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in shared.value:
            a.add_word(t, t)
        a.make_automaton()
        for b in batches:
            rows = [(k, *s) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in (dictionary_spans(text, a) if shared.value else ())]
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int32()), pa.array(x[3])], names=["record_id", "span_start", "span_end", "term"])

    rows = texts.select(F.col("record_id").cast("bigint").alias("record_id"), "text").where("record_id is not null and text <> ''")
    return rows.mapInArrow(run, "record_id bigint, span_start int, span_end int, term string")


def merge_containment(model: Column, extra: Column) -> Column:
    """Fold of further spans into a list: one inside a present span is left out, else it drops the present spans that it contains.

    Both are arrays of struct<span_start, span_end, ...> of one type; the order of `extra` counts.
    """

    def step(acc: Column, m: Column) -> Column:
        inside = F.exists(acc, lambda a: (a.span_start <= m.span_start) & (a.span_end >= m.span_end))
        rest = F.filter(acc, lambda a: ~((m.span_start <= a.span_start) & (m.span_end >= a.span_end)))
        return F.when(inside, acc).otherwise(F.concat(rest, F.array(m)))

    return F.aggregate(extra, model, step)


def merged(model: DataFrame, extra: DataFrame) -> DataFrame:
    """record_id, span_start, span_end after the fold, extra spans in order of start and falling end."""
    s = F.struct(F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"))
    a = model.groupBy("record_id").agg(F.array_sort(F.collect_set(s)).alias("a"))
    order = F.struct("span_start", (-F.col("span_end")).alias("k"), s.alias("s"))
    b = extra.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x.s).alias("b"))
    none = F.array().cast("array<struct<span_start:int,span_end:int>>")
    j = a.join(b, "record_id", "full_outer").select("record_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return j.select("record_id", F.explode(merge_containment(F.col("a"), F.col("b"))).alias("s")).select("record_id", "s.span_start", "s.span_end")


def with_dictionary(gold: DataFrame, extra: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Gold spans and, with code DICT and a fixed confidence, the dictionary's spans that no gold span equals."""
    cols = ["record_id", "span_start", "span_end"]
    new = extra.select(*cols).distinct().join(gold.select(*cols).distinct(), cols, "left_anti")
    return gold.select(*cols, "code", "confidence").unionByName(new.select(*cols, F.lit("DICT").alias("code"), F.lit(confidence).alias("confidence")))


def uncontained(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct spans that no other span of their record contains, equal ones included. A record's spans are compared in one sorted pass, without pairs."""
    a = spans.select("record_id", "span_start", "span_end").distinct().withColumn("own", F.lit(1))
    b = others.select("record_id", "span_start", "span_end").distinct().withColumn("own", F.lit(0))
    w = W.partitionBy("record_id").orderBy("span_start", F.desc("span_end"), "own").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("own") == 0, F.col("span_end"))).over(w)
    return a.unionByName(b).withColumn("reach", reach).where("own = 1 and (reach is null or reach < span_end)").select("record_id", "span_start", "span_end")


def prior(mentions: DataFrame) -> DataFrame:
    """key, code, n: how often each normalized mention has each code."""
    k = normalize_text(F.col("mention"), fold_sigma=True)
    return mentions.where("code is not null").select(k.alias("key"), "code").where("key <> ''").groupBy("key", "code").agg(F.count("*").alias("n"))


def link(mentions: DataFrame, priors: DataFrame, dictionary: DataFrame, similarity: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """mention_id, code, score: the candidate of the best alpha * prior + (1 - alpha) * similarity.

    Candidates are the prior's codes by falling count and code, then the dictionary's (term, codes) by code; the first best wins. Without any count the prior is
    uniform; similarity (mention_id, code, similarity) is -1 where it is missing.
    """
    m = mentions.select("mention_id", normalize_text(F.col("mention"), fold_sigma=True).alias("key")).where("key <> ''")
    total = F.sum("n").over(W.partitionBy("key"))
    p = priors.select("key", "code", F.col("n").alias("c"), (F.col("n") / total).alias("prior"))
    d = dictionary.select(F.col("term").alias("key"), F.explode("codes").alias("code")).join(p.select("key", "code"), ["key", "code"], "left_anti").select("key", "code", F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("prior"))
    c = p.unionByName(d)
    n = F.count("*").over(W.partitionBy("key"))
    top = F.max("c").over(W.partitionBy("key"))
    c = c.withColumn("prior", F.when(top == 0, 1.0 / n).otherwise(F.col("prior")))
    j = m.join(c, "key")
    s = F.lit(-1.0)
    if similarity is not None:
        j = j.join(similarity, ["mention_id", "code"], "left")
        s = F.coalesce("similarity", s)
    score = F.round(alpha * F.col("prior") + (1 - alpha) * s, 9)
    w = W.partitionBy("mention_id").orderBy(F.desc("score"), F.desc("c"), "code")
    return j.withColumn("score", score).withColumn("k", F.row_number().over(w)).where("k = 1").select("mention_id", "code", "score")


def context_similarity(candidates: DataFrame, windows: DataFrame, codes: DataFrame) -> DataFrame:
    """mention_id, code, similarity of each candidate: the cosine of its context's and its code's vector, -1 where either is missing or zero.

    candidates: mention_id, code; windows: mention_id, embedding of the text around the mention; codes: code, embedding of its description. Vectors come from any model, one row each.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    unit = lambda df, key, name: df.select(key, F.col("embedding").cast("array<double>").alias("v")).select(key, F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias(name))
    j = candidates.select("mention_id", "code").join(unit(windows, "mention_id", "w"), "mention_id", "left").join(unit(codes, "code", "c"), "code", "left")
    score = dot(F.col("w"), F.col("c"))
    return j.select("mention_id", "code", F.when(score.isNull() | F.isnan(score), -1.0).otherwise(score).alias("similarity"))


def record_codes(linked: DataFrame) -> DataFrame:
    """record_id, codes in the order in which they first appear. linked: record_id, span_start, mention_id, code."""
    s = F.array_sort(F.collect_list(F.struct("span_start", "mention_id", "code")))
    return linked.groupBy("record_id").agg(F.array_distinct(F.transform(s, lambda x: x.code)).alias("codes"))


def span_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, F1 over exact (record_id, span_start, span_end) sets."""
    k = ["record_id", "span_start", "span_end"]
    a, b = pred.select(*k).distinct().withColumn("a", F.lit(1)), gold.select(*k).distinct().withColumn("b", F.lit(1))
    s = a.join(b, k, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return s.select("tp", "fp", "fn", L.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), L.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), L.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def token_offsets(text: Column) -> Column:
    """array<struct<ix, start, end>> of the tokens between single spaces, tabs and line breaks; codepoint offsets."""
    parts = F.split(text, "[ \\t\\n\\r]", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda acc, p: F.struct((acc.at + F.char_length(p) + 1).alias("at"), F.when(p == "", acc.out).otherwise(F.concat(acc.out, F.array(F.struct(acc.at.alias("s"), (acc.at + F.char_length(p)).alias("e"))))).alias("out"))
    return F.transform(F.aggregate(parts, start, step, lambda acc: acc.out), lambda x, i: F.struct(i.alias("ix"), x.s.alias("start"), x.e.alias("end")))


def bio(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """record_id, token_ix, label: the first token inside a span is B, further ones I, others O; of overlapping spans the one of least start and greatest end counts.

    A token belongs to a span if it lies wholly inside.
    """
    # a record's spans come to its tokens as one array, the first one around a token is its own: no row for a pair of token and span
    span = F.struct("span_start", (-F.col("span_end")).alias("k"))
    s = spans.select("record_id", "span_start", "span_end").distinct().groupBy("record_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    j = texts.where("text <> ''").select("record_id", token_offsets(F.col("text")).alias("tokens")).join(s, "record_id", "left")
    own = F.transform("tokens", lambda t: F.get(F.filter("spans", lambda x: (x.span_start <= t.start) & (-x.k >= t.end)), F.lit(0)))
    before = lambda o, i: F.when(i > 0, F.get(o, i - 1))
    labels = let(own, lambda o: F.transform(o, lambda x, i: F.when(x.isNull(), "O").when(before(o, i).isNull() | (before(o, i) != x), "B").otherwise("I")))
    return j.select("record_id", F.posexplode(labels).alias("token_ix", "label"))


def decode(labels: DataFrame) -> DataFrame:
    """record_id, first_token, last_token, confidence of the entities of BIO labels: B opens, an I after O opens too, O closes. labels: record_id, token_ix, label, p."""
    w = W.partitionBy("record_id").orderBy("token_ix")
    opens = (F.col("label") == "B") | ((F.col("label") == "I") & (F.coalesce(F.lag("label").over(w), F.lit("O")) == "O"))
    run = F.sum(opens.cast("int")).over(w)
    x = labels.withColumn("run", run).where("label <> 'O'")
    return x.groupBy("record_id", "run").agg(F.min("token_ix").alias("first_token"), F.max("token_ix").alias("last_token"), F.avg("p").alias("confidence")).drop("run")


def token_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of token counts inside and outside entities. Both: record_id, token_ix, label."""
    j = gold.select("record_id", "token_ix", F.col("label").alias("g")).join(pred.select("record_id", "token_ix", F.col("label").alias("p")), ["record_id", "token_ix"])
    s = j.agg(F.count_if((F.col("g") != "O") & (F.col("p") != "O")).alias("tp"), F.count_if((F.col("g") == "O") & (F.col("p") != "O")).alias("fp"), F.count_if((F.col("g") != "O") & (F.col("p") == "O")).alias("fn"))
    return s.withColumn("f1", L.f1(F.col("tp"), F.col("fp"), F.col("fn")))


def entity_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, F1 of entities of BIO labels in the strict sense: an entity opens with B only, goes on with I, and counts if both its ends agree."""

    def entities(labels: DataFrame) -> DataFrame:
        w = W.partitionBy("record_id").orderBy("token_ix")
        x = labels.withColumn("run", F.sum((F.col("label") != "I").cast("int")).over(w))
        e = x.groupBy("record_id", "run").agg(F.min("token_ix").alias("span_start"), F.max("token_ix").alias("span_end"), F.min_by("label", "token_ix").alias("first"))
        return e.where("first = 'B'").select("record_id", "span_start", "span_end")

    return span_scores(entities(pred), entities(gold))


def pipeline(texts: DataFrame, model: DataFrame, dictionary: DataFrame, priors: DataFrame, similarity: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions (record_id, span_start, span_end, mention, code) and codes (record_id, codes) of texts: model spans, fused with the dictionary's by containment, linked.

    model: record_id, span_start, span_end of whatever tagger; texts: record_id, text.
    """
    fused = merged(model, extract(texts, dictionary).select("record_id", "span_start", "span_end"))
    cut = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    # spans are told apart by a hash of their place
    named = fused.join(texts.select("record_id", "text"), "record_id").select("record_id", "span_start", "span_end", cut.alias("mention"), F.xxhash64("record_id", "span_start", "span_end").alias("mention_id"))
    linked = named.join(link(named, priors, dictionary, similarity).select("mention_id", "code"), "mention_id", "left")
    return linked.select("record_id", "span_start", "span_end", "mention", "code"), record_codes(linked.where("code is not null"))


TAGS = ("O", "B", "I")


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, allowed: np.ndarray | None = None) -> list[int]:
    """The best path through tag scores (tokens x tags); `allowed` masks tags of partially labelled tokens."""
    x = np.where(allowed, emissions, -1e9) if allowed is not None else emissions
    if not len(x):
        return []
    best = start + x[0]
    back = []
    for e in x[1:]:
        s = best[:, None] + transitions
        back.append(s.argmax(0))
        best = s.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def log_partition(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, allowed: np.ndarray | None = None) -> float:
    """Log of the sum over all paths of the exponent of their scores."""
    x = np.where(allowed, emissions, -1e9) if allowed is not None else emissions
    if not len(x):
        return 0.0
    a = start + x[0]
    for e in x[1:]:
        s = a[:, None] + transitions
        m = s.max(0)
        a = m + np.log(np.exp(s - m).sum(0)) + e
    m = a.max()
    return float(m + np.log(np.exp(a - m).sum()))


#: O -> I is forbidden, as at the start.
TRANSITIONS = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
START = np.array([0.0, 0.0, -1e4])


def decode_crf(emissions: DataFrame) -> DataFrame:
    """record_id, token_ix, label of the best path. emissions: record_id, token_ix, o, b, i (scores)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("token_ix")
        path = viterbi(part[["o", "b", "i"]].to_numpy(), TRANSITIONS, START)
        return pd.DataFrame({"record_id": part["record_id"], "token_ix": part["token_ix"], "label": [TAGS[p] for p in path]})

    return emissions.groupBy("record_id").applyInPandas(run, "record_id bigint, token_ix int, label string")
