"""Ranked retrieval of code documents: BM25, TF-IDF, dense vectors, rank fusion, cuts and threshold learning.

Corpus: (code, corpus_ix int, tokens array<string>); queries: (record_id, tokens); hits: (record_id, code, corpus_ix, score, rank).
Queries without a known token have no hits. Ties go to the lower corpus index unless said otherwise. The corpus is one row for each code
of a label space: its postings are broadcast after their rows are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokenize
from ..plans.staging import checked_broadcast, lookup, stage


def code_documents(descriptions: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """code, corpus_ix, norm, tokens: code and description, with mined phrases (code, phrases array) appended.

    descriptions: label_ix, code, description (null allowed).
    """
    d = descriptions
    extra = F.lit("")
    if phrases is not None:
        d = d.join(phrases, "code", "left")
        extra = F.coalesce(F.array_join("phrases", " "), F.lit(""))
    norm = normalize_text(F.concat_ws(" ", "code", F.coalesce("description", F.lit("")), extra), fold_sigma=True)
    return d.select("code", F.col("label_ix").alias("corpus_ix"), norm.alias("norm")).withColumn("tokens", tokenize(F.col("norm")))


def mention_phrases(mentions: DataFrame, most: int = 50, least: int = 2, shortest: int = 4) -> DataFrame:
    """code, phrases: the most frequent normalized mentions of each code, ties by text; only the first `most` are looked at, then rare ones dropped."""
    n = mentions.select("code", normalize_text(F.col("mention"), fold_sigma=True).alias("phrase")).where(f"char_length(phrase) >= {shortest} and code is not null").groupBy("code", "phrase").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("n"), "phrase"))).where(f"k <= {most} and n >= {least}")
    return top.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "phrase"))), lambda s: s.phrase).alias("phrases"))


def _top(scores: DataFrame, k: int, tie: Column | str = "corpus_ix") -> DataFrame:
    """The k best hits of each query; scores are compared rounded to nine digits, so that their last bits decide nothing."""
    w = W.partitionBy("record_id").orderBy(F.desc(F.round("score", 9)), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _named(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    return hits.join(checked_broadcast(corpus.select("corpus_ix", "code")), "corpus_ix").select("record_id", "code", "corpus_ix", "score", "rank")


def query_terms(queries: DataFrame) -> DataFrame:
    """record_id, token, qtf: tokens with their multiplicity."""
    return queries.select("record_id", F.explode("tokens").alias("token")).groupBy("record_id", "token").agg(F.count("*").alias("qtf"))


#: Postings of a corpus that go to the executors whole, 20 bytes each; a corpus of more is joined.
POSTINGS = 2_000_000
HITS = "record_id bigint, corpus_ix int, score double"


def _ranked(postings: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, higher: bool) -> DataFrame:
    """Hits by the sum of qtf * w over common tokens, each query's sum divided by the length of its vector qtf * q if there is a q.

    postings: token, corpus_ix, w, q (null for none). A label space's postings are few: then each Arrow batch is one sparse product, with the best k taken in place, and no
    pair of query and document leaves its task. higher: ties go to the higher corpus index.
    """
    postings = stage(postings, "retrieval-postings")
    if postings.count() > POSTINGS:
        q = query_terms(queries).join(postings, "token")
        s = q.groupBy("record_id", "corpus_ix").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))
        length = query_terms(queries).join(postings.select("token", "q").distinct(), "token").groupBy("record_id").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("q"), 2))).alias("length"))
        s = s.join(length, "record_id").withColumn("score", F.col("score") / F.coalesce("length", F.lit(1.0))).drop("length").where("score > 0")
        return _named(_top(s, k, F.desc("corpus_ix") if higher else "corpus_ix"), corpus)
    rows = postings.orderBy("token", "corpus_ix").collect()
    vocabulary = list(dict.fromkeys(r["token"] for r in rows))
    ixs = sorted({r["corpus_ix"] for r in rows})
    place = {x: i for i, x in enumerate(ixs)}
    at = {t: i for i, t in enumerate(vocabulary)}
    first = np.searchsorted(np.array([at[r["token"]] for r in rows], np.int64), np.arange(len(vocabulary) + 1))
    shared = queries.sparkSession.sparkContext.broadcast((vocabulary, np.array(ixs, np.int32), first, np.array([place[r["corpus_ix"]] for r in rows], np.int64), np.array([r["w"] for r in rows], np.float64), np.array([np.nan if rows[i]["q"] is None else rows[i]["q"] for i in first[:-1]], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ixs, first, to, w, q = shared.value
        known = pa.array(vocabulary, pa.string())
        for whole in batches:
            # a block of scores of at most some eight million cells
            for begin in range(0, len(whole), step := max(1, 8_000_000 // max(1, len(ixs)))):
                b = whole.slice(begin, step)
                lists = b.column(1)
                token = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1))
                rec = np.repeat(np.arange(len(b)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                rec, token = rec[token >= 0], token[token >= 0].astype(np.int64)
                if not len(rec):
                    continue
                pair, qtf = np.unique(rec * len(vocabulary) + token, return_counts=True)
                rec, token = pair // len(vocabulary), pair % len(vocabulary)
                n = first[token + 1] - first[token]
                post = np.repeat(first[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                score = np.bincount(np.repeat(rec, n) * len(ixs) + to[post], np.repeat(qtf, n) * w[post], len(b) * len(ixs)).reshape(len(b), len(ixs))
                length = np.sqrt(np.bincount(rec, (qtf * q[token]) ** 2, len(b)))
                score /= np.where(np.isnan(length) | (length == 0), 1.0, length)[:, None]
                key = np.round(score, 9)
                order = np.lexsort((np.broadcast_to(-ixs if higher else ixs, key.shape), -key), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                i, j = np.nonzero(best > 0)
                ids = np.asarray(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ixs[order[i, j]], pa.int32()), pa.array(best[i, j]), pa.array((j + 1).astype(np.int32))], names=["record_id", "corpus_ix", "score", "rank"])

    hits = queries.select(F.col("record_id").cast("bigint").alias("record_id"), "tokens").where("record_id is not null").mapInArrow(run, HITS + ", rank int")
    return _named(hits, corpus)


def bm25_postings(corpus: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """token, corpus_ix, w with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    stats = corpus.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    tf = corpus.select("corpus_ix", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).groupBy("corpus_ix", "dl", "token").agg(F.count("*").alias("f"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "token").join(F.broadcast(stats)).select("token", "corpus_ix", weight.alias("w"), F.lit(None).cast("double").alias("q"))


def tfidf_postings(corpus: DataFrame) -> DataFrame:
    """token, corpus_ix, w, q: raw tf x (ln((1 + n) / (1 + df)) + 1) of unit length, times the idf q that the query's side has as well."""
    n = corpus.agg(F.count("*").alias("n"))
    tf = corpus.select("corpus_ix", F.explode("tokens").alias("token")).groupBy("corpus_ix", "token").agg(F.count("*").alias("f"))
    idf = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("q"))
    w = tf.join(idf, "token").select("corpus_ix", "token", "q", (F.col("f") * F.col("q")).alias("w"))
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("corpus_ix")))
    return w.select("token", "corpus_ix", (unit * F.col("q")).alias("w"), "q")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Hits by BM25; query tokens count with multiplicity."""
    return _ranked(bm25_postings(corpus, k1, b), corpus, queries, k, higher=False)


def tfidf(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits by cosine of tf-idf vectors, both sides of unit length; ties go to the higher index, zeros are left out."""
    return _ranked(tfidf_postings(corpus), corpus, queries, k, higher=True)


def retrieve(kind: str, corpus: DataFrame, queries: DataFrame, k: int, channel: int = 20) -> DataFrame:
    """Hits of a retriever by name: bm25, tfidf or hybrid (rank fusion of the two, `channel` hits each)."""
    if kind == "hybrid":
        queries = stage(queries, "retrieval-queries")
        return rrf(bm25(corpus, queries, channel), tfidf(corpus, queries, channel), k)
    if kind not in ("bm25", "tfidf"):
        raise ValueError(f"unknown retriever {kind}")
    return {"bm25": bm25, "tfidf": tfidf}[kind](corpus, queries, k)


def _nearest(s: np.ndarray, v: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row with their ids, ties to the lower id; sorted are only the columns that may be among them, some rows at a time."""
    out_s, out_v = np.empty((len(s), k)), np.empty((len(s), k), np.int64)
    for i in range(0, len(s), rows):
        a, b = s[i : i + rows], v[i : i + rows]
        if a.shape[1] > 4 * k:
            least = np.partition(a, a.shape[1] - k, axis=1)[:, -k]
            # ties at the border all stay
            width = int((a >= least[:, None]).sum(1).max())
            keep = np.argpartition(-a, min(width, a.shape[1]) - 1, axis=1)[:, :width]
            a, b = np.take_along_axis(a, keep, 1), np.take_along_axis(b, keep, 1)
        order = np.lexsort((b, -a), axis=1)[:, :k]
        out_s[i : i + rows], out_v[i : i + rows] = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
    return out_s, out_v


def dense(corpus: DataFrame, queries: DataFrame, k: int, block_rows: int = 20_000) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest corpus vectors by cosine, ties to the lower id. corpus and queries: vec_id, embedding.

    Queries are a stated set against all rows: they go to the executors in blocks of `block_rows`, each task keeps only its k best for each
    query (one matrix product a batch), and the tasks' bests are ranked. Null and zero vectors take no part.
    """
    spark = corpus.sparkSession
    total = queries.count()
    out = None
    for i in range(max(1, -(-total // block_rows))):
        blocks = max(1, -(-total // block_rows))
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", "embedding").collect()
        rows = [(r[0], np.asarray(r[1], np.float64)) for r in rows if r[1] is not None]
        rows = [(v, x / np.linalg.norm(x)) for v, x in rows if np.linalg.norm(x) > 0]
        block = spark.sparkContext.broadcast((np.array([v for v, _ in rows]), np.array([x for _, x in rows])))

        def run(batches, block=block):
            ids, q = block.value
            best_s, best_v = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            for b in batches:
                emb = b.column(1)
                keep = [j for j, e in enumerate(emb) if e.is_valid]
                if not keep or not len(ids):
                    continue
                x = np.array([emb[j].as_py() for j in keep], np.float64)
                v = np.array(b.column(0).to_pylist())[keep]
                length = np.linalg.norm(x, axis=1)
                x, v = x[length > 0] / length[length > 0, None], v[length > 0]
                s = np.concatenate([best_s, np.round(q @ x.T, 9)], axis=1)
                w = np.concatenate([best_v, np.broadcast_to(v, (len(ids), len(v)))], axis=1)
                best_s, best_v = _nearest(s, w, k)
            ok = np.isfinite(best_s)
            qi = np.repeat(ids, k).reshape(len(ids), k) if len(ids) else best_v
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qi[ok], pa.int64()), "vec_id": pa.array(best_v[ok], pa.int64()), "score": pa.array(best_s[ok], pa.float64())})

        part = corpus.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(first: DataFrame, second: DataFrame, k: int, constant: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two channels of hits; ties keep the first channel's order."""
    a = first.select("record_id", "code", "corpus_ix", F.col("rank").alias("ra"))
    b = second.select("record_id", "code", "corpus_ix", F.col("rank").alias("rb"))
    j = a.join(b, ["record_id", "code", "corpus_ix"], "full_outer")
    score = F.coalesce(F.lit(weights[0]) / (constant + F.col("ra")), F.lit(0.0)) + F.coalesce(F.lit(weights[1]) / (constant + F.col("rb")), F.lit(0.0))
    w = W.partitionBy("record_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("ra"), "rb")
    return j.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("record_id", "code", "corpus_ix", "score", "rank")


def relative_cut(hits: DataFrame, fraction: float, most: int, least_one: bool = False, per_code: DataFrame | None = None) -> DataFrame:
    """Hits whose score is at least a fraction of the query's best, at most `most` of them after the cut.

    per_code: (code, fraction) for codes with an own fraction. A best score of zero or less keeps none; least_one keeps the top hit whatever the fraction of its code.
    """
    best = F.max("score").over(W.partitionBy("record_id"))
    h = hits.withColumn("best", best)
    share = F.lit(fraction)
    if per_code is not None:
        h = h.join(lookup(per_code.withColumnRenamed("fraction", "own"), "fractions"), "code", "left")
        share = F.coalesce("own", share)
    ok = (F.col("best") > 0) & (F.round("score", 9) >= F.round(share * F.col("best"), 9))
    if least_one:
        ok = ok | ((F.col("best") > 0) & (F.col("rank") == 1))
    h = h.where(ok)
    return h.withColumn("k", F.row_number().over(W.partitionBy("record_id").orderBy("rank"))).where(F.col("k") <= most).select("record_id", "code", "corpus_ix", "score", "rank")


def dictionary_rerank(candidates: DataFrame, hits: DataFrame, fraction: float, most: int) -> DataFrame:
    """Dictionary codes (record_id, code) ranked by relative score, rank and code; those of at least a fraction stay, at least one, at most `most`."""
    best = hits.groupBy("record_id").agg(F.max("score").alias("best"))
    j = candidates.join(hits.select("record_id", "code", "score", F.col("rank").alias("r")), ["record_id", "code"], "left").join(best, "record_id", "left")
    rel = F.round(F.coalesce(F.when(F.col("best") > 0, F.col("score") / F.col("best")), F.lit(0.0)), 9)
    w = W.partitionBy("record_id").orderBy(F.desc("rel"), F.asc_nulls_last("r"), "code")
    return j.withColumn("rel", rel).withColumn("k", F.row_number().over(w)).where(((F.col("rel") >= fraction) | (F.col("k") == 1)) & (F.col("k") <= most)).select("record_id", "code", "rel", F.col("k").cast("bigint").alias("k"))


def learn_fractions(hits: DataFrame, gold: DataFrame, grid: list[float], positives: int = 5, least: int = 12) -> DataFrame:
    """code, fraction: for codes with enough hits and positives the first fraction of the grid that maximizes binary F1 over the hits.

    gold: record_id, code.
    """
    rel = F.col("score") / F.max("score").over(W.partitionBy("record_id"))
    h = hits.select("record_id", "code", F.round(rel, 9).alias("rel")).join(gold.select("record_id", "code").distinct().withColumn("y", F.lit(1)), ["record_id", "code"], "left")
    g = h.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    pred = F.col("rel") >= F.col("t")
    s = g.groupBy("code", "t").agg(F.count("*").alias("n"), F.count("y").alias("pos"), F.count_if(pred & F.col("y").isNotNull()).alias("tp"), F.count_if(pred & F.col("y").isNull()).alias("fp"))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))
    s = s.where(f"n >= {least} and pos >= {positives}").withColumn("f1", F.round(f, 9))
    return s.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("f1"), "t"))).where("k = 1").select("code", F.col("t").alias("fraction"), "f1")
