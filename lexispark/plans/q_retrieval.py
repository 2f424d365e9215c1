"""Queries: code corpus, ranked retrieval, cuts, fusion of ranks, threshold learning."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from . import q_dictionary as QD
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
PHRASES = V.MEN + f""", m as (select code, {V.norm_sql('mention')} as phrase from men where mention is not null and code is not null), n as (select code, phrase, count(*) as n from m where length(phrase) >= 4 group by all),
ph0 as (select code, phrase, n, row_number() over (partition by code order by n desc, phrase) as k from n), ph as (select code, string_agg(phrase, ' ' order by k) as phrases from ph0 where k <= 50 and n >= 2 group by code)"""
LOOK = "de as (select code, min(greek_description) as d from code_lookup where greek_description <> '' group by code)"
CORPUS = PHRASES + ", " + LOOK + f""", co as (select code, label_ix as ix, {V.norm_sql("l.code || ' ' || coalesce(d, '') || ' ' || coalesce(phrases, '')")} as norm from labelset l left join de using (code) left join ph using (code)),
ct as (select code, ix, unnest(string_split(norm, ' ')) as token from co where norm <> ''), cdl as (select ix, count(*) as dl from ct group by ix), ctf as (select code, ix, token, count(*) as f from ct group by all), cdf as (select token, count(*) as df from ctf group by token),
cst as (select count(*) as n, (select count(*) from ct) / count(*)::double as avgdl from co)"""
QUERY = V.REC + f""", qt as (select record_id, unnest(string_split({V.norm_sql('text')}, ' ')) as token from rec where text is not null), qf as (select record_id, token, count(*) as qtf from qt where token <> '' group by all)"""
BM25 = CORPUS + ", " + QUERY + """, bp as (select token, code, ix, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)) as w from ctf join cdf using (token) join cdl using (ix), cst),
bs as (select record_id, code, ix, sum(qtf * w) as score from qf join bp using (token) group by all), bh as (select *, row_number() over (partition by record_id order by round(score, 9) desc, ix) as rank from bs where score > 0 qualify rank <= 20)"""
TFIDF = """, ti as (select token, ln((1 + n) / (1 + df)::double) + 1 as idf from cdf, cst), tw as (select code, ix, token, f * idf as w from ctf join ti using (token)), tn as (select ix, sqrt(sum(w * w)) as l from tw group by ix), tp as (select token, code, tw.ix, w / l as w from tw join tn using (ix)),
tq as (select record_id, token, qtf * idf as q from qf join ti using (token)), tl as (select record_id, sqrt(sum(q * q)) as l from tq group by record_id), ts as (select record_id, code, ix, sum(q * w) as dot from tq join tp using (token) group by all),
th as (select record_id, code, ix, dot / l as score, row_number() over (partition by record_id order by round(dot / l, 9) desc, ix desc) as rank from ts join tl using (record_id) where dot > 0 qualify rank <= 20)"""
CUT = """, cu0 as (select *, max(score) over (partition by record_id) as best from bh), cu as (select record_id, code, ix, score, rank, row_number() over (partition by record_id order by rank) as k from cu0 where best > 0 and round(score, 9) >= round(0.5::double * best, 9) qualify k <= 8)"""


def corpus(s, d):
    from .staging import stage

    look = table(s, d, "code_lookup").where("greek_description <> ''").groupBy("code").agg(F.min("greek_description").alias("description"))
    c = R.code_documents(table(s, d, "labelset").join(look, "code", "left"), R.mention_phrases(V.mentions(s, d)))
    return stage(c, "code-corpus")  # one row for each label, used by every channel


def queries(s, d):
    return V.records(s, d).where("text is not null").select("record_id", T.tokenize(T.normalize_text(F.col("text"), fold_sigma=True)).alias("tokens"))


def _bm25(s, d):
    return R.bm25(corpus(s, d), queries(s, d), 20)


def _out(h):
    return h.select("record_id", "code", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@C.add("code_corpus", CORPUS + "select code, norm from co")
def code_corpus(s, d):
    return corpus(s, d).select("code", "norm")


@C.add("mention_expansion", PHRASES + " select code, phrases from ph")
def mention_expansion(s, d):
    return R.mention_phrases(V.mentions(s, d)).select("code", F.array_join("phrases", " ").alias("phrases"))


@C.add("bm25_topk", BM25 + "select record_id, code, round(score, 6) as score, rank from bh")
def bm25_topk(s, d):
    return _out(_bm25(s, d))


@C.add("tfidf_topk", BM25 + TFIDF + "select record_id, code, round(score, 6) as score, rank from th")
def tfidf_topk(s, d):
    return _out(R.tfidf(corpus(s, d), queries(s, d), 20))


@C.add(
    "dense_topk",
    """with v as (select vec_id, embedding from embeddings where embedding is not null), s as (select q.vec_id as query_id, c.vec_id, round(list_dot_product(q.embedding::double[], c.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])), 9) as score from v q, v c where q.vec_id % 20 = 0)
select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10""",
)
def dense_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    # the stated query set of searches: ids divisible by 20, against all rows
    h = R.dense(e, e.where("vec_id % 20 = 0"), 10)
    return h.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@C.add(
    "rrf_hybrid",
    BM25
    + TFIDF
    + """, j as (select coalesce(b.record_id, t.record_id) as record_id, coalesce(b.code, t.code) as code, b.rank as ra, t.rank as rb, coalesce(1 / (60 + b.rank)::double, 0) + coalesce(1 / (60 + t.rank)::double, 0) as score from bh b full join th t on b.record_id = t.record_id and b.code = t.code)
select record_id, code, round(score, 6) as score, row_number() over (partition by record_id order by round(score, 9) desc, ra nulls last, rb nulls first) as rank from j qualify rank <= 15""",
)
def rrf_hybrid(s, d):
    return _out(R.retrieve("hybrid", corpus(s, d), queries(s, d), 15))


@C.add("relative_cut", BM25 + CUT + "select record_id, code, round(score, 6) as score, rank from cu")
def relative_cut(s, d):
    return _out(R.relative_cut(_bm25(s, d), 0.5, 8))


@C.add("ir_union_dict", BM25.replace(V.REC + ", ", "", 1).replace(PHRASES, QD.MATCH + ", " + PHRASES, 1) + CUT + "select record_id, code from cu union select record_id, code from mc")
def ir_union_dict(s, d):
    from ..operators.fusion import union

    return union(R.relative_cut(_bm25(s, d), 0.5, 8), QD.coded(s, d).select("record_id", F.explode("codes").alias("code")))


@C.add(
    "dict_rerank",
    BM25.replace(V.REC + ", ", "", 1).replace(PHRASES, QD.MATCH + ", " + PHRASES, 1)
    + """, be as (select record_id, max(score) as best from bh group by record_id), rr as (select mc.record_id, mc.code, round(coalesce(score / best, 0), 9) as rel, rank from mc left join bh on bh.record_id = mc.record_id and bh.code = mc.code left join be on be.record_id = mc.record_id)
select record_id, code, round(rel, 6) as rel, row_number() over (partition by record_id order by rel desc, rank nulls last, code) as k from rr qualify (rel >= 0.3 or k = 1) and k <= 6""",
)
def dict_rerank(s, d):
    r = R.dictionary_rerank(QD.coded(s, d).select("record_id", F.explode("codes").alias("code")), _bm25(s, d), 0.3, 6)
    return r.withColumn("rel", F.round("rel", 6))


GRID = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
LEARN = """, gm as (select distinct record_id, unnest(flatten(list_filter(document_level_annotations, lambda g: g is not null))) as code from rec where len(document_level_annotations) > 0), lh as (select bh.record_id, bh.code, round(score / max(score) over (partition by bh.record_id), 9) as rel, gm.code is not null as y from bh left join gm on gm.record_id = bh.record_id and gm.code = bh.code),
ls as (select code, t, count(*) as n, count(*) filter (y) as pos, count(*) filter (y and rel >= t) as tp, count(*) filter (not y and rel >= t) as fp from lh cross join (values (0.3::double), (0.4::double), (0.5::double), (0.6::double), (0.7::double), (0.8::double)) g(t) group by all having count(*) >= 12 and count(*) filter (y) >= 5),
lt as (select code, t as fraction, round(case when tp + fp + pos = 0 then 0 else 2 * tp / (tp + fp + pos)::double end, 9) as f1 from ls), le as (select code, fraction, f1 from lt qualify row_number() over (partition by code order by f1 desc, fraction) = 1)"""


def _member(s, d):
    return V.gold(s, d).select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code"))


@C.add("learn_code_thresholds", BM25 + LEARN + "select code, fraction, round(f1, 6) as f1 from le")
def learn_code_thresholds(s, d):
    return R.learn_fractions(_bm25(s, d), _member(s, d), GRID).withColumn("f1", F.round("f1", 6))


@C.add(
    "per_code_cut",
    BM25
    + LEARN
    + """, pc0 as (select bh.*, max(score) over (partition by record_id) as best, coalesce(le.fraction, 0.5) as fr from bh left join le using (code))
select record_id, code, round(score, 6) as score, rank from pc0 where best > 0 and round(score, 9) >= round(fr * best, 9) qualify row_number() over (partition by record_id order by rank) <= 8""",
)
def per_code_cut(s, d):
    h = _bm25(s, d)
    return _out(R.relative_cut(h, 0.5, 8, per_code=R.learn_fractions(h, _member(s, d), GRID).select("code", "fraction")))


@C.add(
    "ir_grid",
    BM25
    + LEARN
    + """, c0 as (select record_id, code, rank, score, max(score) over (partition by record_id) as best from bh), c1 as (select g.f, g.m, record_id, code, row_number() over (partition by g.f, g.m, record_id order by rank) as k from c0 cross join (values (0.4::double, 6), (0.4::double, 10), (0.6::double, 6), (0.6::double, 10)) g(f, m) where best > 0 and round(score, 9) >= round(f * best, 9)), c2 as (select * from c1 where k <= m)
select f as fraction, m as most, count(*) as predicted, count(gm.code) as right from c2 left join gm on gm.record_id = c2.record_id and gm.code = c2.code group by all""".replace(" as right", " as n_right"),
)
def ir_grid(s, d):
    from functools import reduce

    from pyspark.sql import DataFrame

    from .staging import stage

    # the channel's hits are made once and cut for each point of the grid
    h = stage(_bm25(s, d), "ir-grid-hits")
    parts = [R.relative_cut(h, f, m).select("record_id", "code").withColumns({"fraction": F.lit(f), "most": F.lit(m)}) for f in (0.4, 0.6) for m in (6, 10)]
    j = reduce(DataFrame.unionByName, parts).join(_member(s, d).withColumn("y", F.lit(1)), ["record_id", "code"], "left")
    return j.groupBy("fraction", "most").agg(F.count("*").alias("predicted"), F.count("y").alias("n_right"))
