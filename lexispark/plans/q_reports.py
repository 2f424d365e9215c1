"""Queries: comparison of runs, probes and checks, strict entities, class weights, losses and schedules, batches."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import pooling as P
from ..operators import reports as R
from ..operators import retrieval as IR
from ..operators import scoring as S
from ..operators import spans as N
from ..operators import tuning as T
from . import q_dictionary as QD
from . import q_fusion as QF
from . import q_retrieval as QR
from . import q_scoring as QS
from . import q_spans as QN
from . import views as V
from .catalogue import Catalogue
from .session import table
from .staging import stage

C = Catalogue()


@C.add("blind_gold_probe", V.REC + ", x as (select record_id, split, unnest(flatten(list_filter(document_level_annotations, lambda g: g is not null))) as c from rec) select split, count(*) filter (record_id in (select record_id from x where trim(c) <> '')) > 0 as has_gold from rec where split is not null group by split")
def blind_gold_probe(s, d):
    return R.gold_probe(table(s, d, "records").where("record_id is not null"))


RUNS = [("dict", "single/dict", "sys_dict"), ("dict_again", "single/dict", "sys_dict"), ("voted", "ensemble/rank", "sys_rank"), ("absent", "single/none", "sys_none"), ("net", "single/net", "sys_net"), ("net_copy", "single/net2", "sys_net"), ("a", None, "sys_link")]
_RUNS = ", ".join(f"('{n}', {'null' if p is None else repr(p)}, '{x}')" for n, p, x in RUNS)


@C.add(
    "compare_runs",
    QS.HITS
    + f""", ru(name, path, system_name) as (values {_RUNS}), r1 as (select * from ru qualify path is null or row_number() over (partition by path order by length(name), name) = 1),
me as (select system_name, round(tp / (tp + fp)::double, 4) as precision, round(tp / n::double, 4) as recall, round({QS.F1.format('tp', 'fp', '(n - tp)')}, 4) as f1 from mi),
r2 as (select name, path, precision, recall, f1, case when f1 is null then 'no predictions' end as error from r1 left join me using (system_name)),
r3 as (select * from r2 qualify error is not null or row_number() over (partition by precision, recall, f1 order by length(name), name) = 1)
select row_number() over (order by error is not null, f1 desc, name) as rank, name, case when path like 'ensemble/%' then 'ensemble_strategy' else 'individual' end as tier, precision, recall, f1, error from r3""",
)
def compare_runs(s, d):
    return R.comparison(V.gold(s, d), V.predictions(s, d), s.createDataFrame(RUNS, "name string, path string, system_name string"))


@C.add(
    "breakdown_errors",
    QS.HITS
    + """, mg as (select k.system_name, g.record_id, g.ix, g.codes from known k join grp g using (record_id) where not exists (select 1 from hit h where h.system_name = k.system_name and h.record_id = g.record_id and h.ix = g.ix)),
e as (select system_name, 'fn' as kind, unnest(codes) as code from mg union all select system_name, 'fp', code from pl where record_id in (select record_id from docs) and not exists (select 1 from gl where gl.record_id = pl.record_id and gl.code = pl.code))
select system_name, kind, code, count(*) as n from e where code is not null group by all""",
)
def breakdown_errors(s, d):
    return R.breakdown_errors(V.gold(s, d), V.predictions(s, d))


@C.add("mcnemar_statistic", QS.HITS + """, h as (select gr.record_id, gr.ix, count(*) filter (system_name = 'sys_net') > 0 as a, count(*) filter (system_name = 'sys_dict') > 0 as b from grp gr left join hit on hit.record_id = gr.record_id and hit.ix = gr.ix group by all),
c as (select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from h)
select only_a, only_b, case when only_a + only_b >= 25 then round(pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b)::double, 6) end as statistic from c""")
def mcnemar_statistic(s, d):
    x = R.mcnemar_test(S.mcnemar(V.gold(s, d), V.predictions(s, d), "sys_net", "sys_dict"))
    return x.select("only_a", "only_b", F.round("statistic", 6).alias("statistic"))


@C.add("score_order_check", V.PREDS + "select record_id, count(*) as runs from pr group by record_id having count(*) < (select count(distinct system_name) from pr)")
def score_order_check(s, d):
    return R.order_check(V.predictions(s, d), "system_name")


@C.add("texts_by_id", V.REC + ", i as (select distinct record_id from predictions where record_id is not null) select record_id as ix, record_id, coalesce(text, '') as text from i left join rec using (record_id)")
def texts_by_id(s, d):
    ids = table(s, d, "predictions").where("record_id is not null").select(F.col("record_id").alias("ix"), "record_id").distinct()
    return R.texts_by_id(ids, V.records(s, d))


@C.add("mentions_json", QN.VALID + "select record_id, to_json(list({'start': span_start, 'end': span_end, 'code': code, 'mention': mention} order by span_start, span_end, code, mention))::varchar as json from ok where code is not null group by record_id")
def mentions_json(s, d):
    return R.mentions_json(QN.valid(s, d).where("code is not null"))


@C.add("length_batches", V.REC + ", b as (select length(text) // 256 as bucket from rec) select coalesce(bucket, 0) as bucket, count(*) as texts, 0 as too_large from b group by 1")
def length_batches(s, d):
    b = R.length_batches(V.records(s, d), 16)
    n = b.groupBy("bucket", "part", "batch").agg(F.count("*").alias("n"))
    return n.groupBy("bucket").agg(F.sum("n").alias("texts"), F.count_if(F.col("n") > 16).alias("too_large"))


_ES = QN.BIO + """, lbe as (select t.record_id, token_ix, min((g.span_start::bigint * 10000000 + (10000000 - g.span_end))) as span from t left join es g on g.record_id = t.record_id and g.span_start <= t.s and g.span_end >= t.e group by all),
bioe as (select record_id, token_ix, case when span is null then 'O' when lag(span) over (partition by record_id order by token_ix) is distinct from span then 'B' else 'I' end as label from lbe),
eg0 as (select *, sum((label <> 'I')::int) over (partition by record_id order by token_ix) as run from bio), eg as (select record_id, min(token_ix) as a, max(token_ix) as b from eg0 group by record_id, run having arg_min(label, token_ix) = 'B'),
ee0 as (select *, sum((label <> 'I')::int) over (partition by record_id order by token_ix) as run from bioe), ee as (select record_id, min(token_ix) as a, max(token_ix) as b from ee0 group by record_id, run having arg_min(label, token_ix) = 'B'),
y as (select count(*) filter (eg.record_id is not null and ee.record_id is not null) as tp, count(*) filter (eg.record_id is null) as fp, count(*) filter (ee.record_id is null) as fn from eg full join ee on eg.record_id = ee.record_id and eg.a = ee.a and eg.b = ee.b) """


@C.add("entity_f1", _ES + f"select tp, fp, fn, round({QS.F1.format('tp', 'fp', 'fn')}, 6) as f1 from y")
def entity_f1(s, d):
    rec = V.records(s, d)
    x = N.entity_scores(N.bio(rec, QN._extra(s, d)), N.bio(rec, QN._gold(s, d)))
    return x.select("tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@C.add("pipeline_mentions")
def pipeline_mentions(s, d):
    """Model spans fused with the dictionary's and linked, over whole texts."""
    v = QN.valid(s, d)
    return N.pipeline(V.records(s, d), v.where("source = 'model'"), QD.dictionary(s, d), N.prior(v.where("source = 'gold'")))[0]


@C.add("label_class_weights", V.GROUPS + ", n as (select count(*) as n from docs), p as (select l.code, count(distinct record_id) as pos from (select distinct code from labelset) l left join gl using (code) group by all) select code, pos, round(least(greatest(case when pos = 0 then n else (n - pos) / pos::double end, 1), 20), 6) as weight from p, n")
def label_class_weights(s, d):
    return QS._r(P.label_class_weights(V.gold(s, d), table(s, d, "labelset")), "weight")


@C.add("fold_thresholds", V.SCORES + "select code, round(avg(thr / 1000.0::double), 6) as threshold, count(*) as folds from (select distinct system_name, code, thr from raw) group by code")
def fold_thresholds(s, d):
    f = V.raw_scores(s, d).select("system_name", "code", (F.col("thr") / 1000.0).alias("threshold")).distinct()
    return QS._r(P.average_thresholds(f), "threshold")


@C.add("rank_loss", V.SCORES + ", c as (select raw.record_id, (milli - thr) / 100.0::double as z, (m.code is not null)::int as y from raw left join mem m on m.record_id = raw.record_id and m.code = raw.code where system_name = 'sys_net') select record_id, round(ln(1 + coalesce(sum(exp(-z)) filter (y = 1), 0)) + ln(1 + coalesce(sum(exp(z)) filter (y = 0), 0)), 6) as loss from c group by record_id")
def rank_loss(s, d):
    m = QR._member(s, d).withColumn("y", F.lit(1))
    c = V.raw_scores(s, d).where("system_name = 'sys_net'").join(m, ["record_id", "code"], "left").select("record_id", ((F.col("milli") - F.col("thr")) / 100.0).alias("logit"), F.coalesce("y", F.lit(0)).alias("y"))
    return QS._r(P.rank_loss(c), "loss")


@C.add("rate_schedule", "select step, round(case when step < 10 then step / 10.0::double else greatest(0, 0.5 * (1 + cos(3.141592653589793 * (step - 10) / 90.0::double))) end, 6) as factor from (select unnest(range(0, 101)) as step)")
def rate_schedule(s, d):
    return s.range(0, 101).select(F.col("id").alias("step"), F.round(P.cosine_schedule(F.col("id"), 10, 100), 6).alias("factor"))


CUTS = [round(0.72 + 0.02 * i, 2) for i in range(24)]
_CUTS = "(values " + ", ".join(f"({g}::double)" for g in CUTS) + ") t(t)"


@C.add(
    "routing_sweep",
    QF.CHAMP
    + f""", rc as (select sc.record_id, sc.code, score from sc join champ on champ.code = sc.code and champion = system_name), g as (select t, record_id, code from rc cross join {_CUTS} where round(score, 9) >= t),
gt as (select t, count(*) as tp from (select distinct t, gl.record_id, gl.ix from g join gl using (record_id, code)) group by t),
gf as (select t, count(*) as fp from g where not exists (select 1 from gl where gl.record_id = g.record_id and gl.code = g.code) group by t), nn as (select sum(n_groups) as n from docs)
select t as threshold, gt.tp, coalesce(gf.fp, 0) as fp, round(2 * gt.tp / (gt.tp + coalesce(gf.fp, 0) + n)::double, 6) as f1 from gt left join gf using (t), nn""",
)
def routing_sweep(s, d):
    cells = V.scores(s, d).join(QF._champions(s, d), ["code", "system_name"]).select("record_id", "code", "score")
    return QS._r(T.threshold_sweep(cells, V.gold(s, d), CUTS), "f1").select("threshold", "tp", "fp", "f1")


@C.add(
    "group_index_list",
    V.GROUPS
    + """, gi as (select record_id, ix, string_agg(label_ix::varchar, ',' order by label_ix) as g from gl join (select distinct code, label_ix from labelset) l using (code) group by all),
a as (select record_id, string_agg(g, '|' order by ix) as groups from gi group by record_id) select record_id, coalesce(groups, '') as groups from docs left join a using (record_id)""",
)
def group_index_list(s, d):
    g = V.gold(s, d)
    own = R.group_indices(F.col("groups"), F.flatten("groups"), V.labels(s, d))
    return g.select("record_id", F.array_join(F.transform(own, lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("groups"))


@C.add(
    "ir_grid_kinds",
    QR.BM25
    + QR.TFIDF
    + """, gm as (select distinct record_id, unnest(flatten(list_filter(document_level_annotations, lambda g: g is not null))) as code from rec where len(document_level_annotations) > 0),
ha as (select 'bm25' as kind, record_id, code, rank, score from bh union all select 'tfidf', record_id, code, rank, score from th), c0 as (select *, max(score) over (partition by kind, record_id) as best from ha),
c1 as (select kind, g.f, g.m, record_id, code, row_number() over (partition by kind, g.f, g.m, record_id order by rank) as k from c0 cross join (values (0.3::double, 6), (0.3::double, 12), (0.5::double, 6), (0.5::double, 12), (0.7::double, 6), (0.7::double, 12)) g(f, m) where best > 0 and round(score, 9) >= round(f * best, 9))
select kind, f as fraction, m as most, count(*) as predicted, count(gm.code) as n_right from c1 left join gm on gm.record_id = c1.record_id and gm.code = c1.code where k <= m group by all""",
)
def ir_grid_kinds(s, d):
    """Each retriever's hits are made once, and one pass over them gives every point of the grid."""
    from pyspark.sql import Window as W

    c, q = QR.corpus(s, d), stage(QR.queries(s, d), "grid-queries")
    hits = IR.retrieve("bm25", c, q, 20).withColumn("kind", F.lit("bm25")).unionByName(IR.retrieve("tfidf", c, q, 20).withColumn("kind", F.lit("tfidf")))
    hits = hits.withColumn("best", F.max("score").over(W.partitionBy("kind", "record_id"))).join(QR._member(s, d).withColumn("y", F.lit(1)), ["record_id", "code"], "left")
    points = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(m).alias("most")) for f in (0.3, 0.5, 0.7) for m in (6, 12)])
    # hits are in the order of their scores: what a fraction keeps is a beginning, so a rank tells how many were kept before
    ok = hits.withColumn("p", F.explode(points)).where((F.col("best") > 0) & (F.round("score", 9) >= F.round(F.col("p.fraction") * F.col("best"), 9)) & (F.col("rank") <= F.col("p.most")))
    return ok.groupBy("kind", "p.fraction", "p.most").agg(F.count("*").alias("predicted"), F.count("y").alias("n_right"))


@C.add(
    "context_rerank",
    """with v as (select vec_id, embedding::double[] as e, label from embeddings where embedding is not null), q as (select * from v where vec_id % 20 = 0),
p as (select label, i, avg(x) as m from (select label, unnest(e) as x, generate_subscripts(e, 1) as i from v where label is not null) group by all), c as (select label, list(m order by i) as e from p where label % 2 = 0 group by label),
k as (select q.vec_id as mention_id, q.e, unnest([q.label, q.label + 1, q.label + 2]) as code from q where q.label is not null)
select mention_id, k.code::varchar as code, round(coalesce(list_dot_product(k.e, c.e) / sqrt(list_dot_product(k.e, k.e)) / sqrt(list_dot_product(c.e, c.e)), -1), 6) as similarity from k left join c on c.label = k.code""",
)
def context_rerank(s, d):
    """Candidates scored by vectors of their contexts; codes without a vector get -1."""
    e = table(s, d, "embeddings").where("embedding is not null")
    long = e.where("label is not null and label % 2 = 0").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    codes = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("embedding")).select(F.col("label").cast("string").alias("code"), "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("mention_id"), "label", "embedding")
    wanted = q.where("label is not null").select("mention_id", F.explode(F.array("label", F.col("label") + 1, F.col("label") + 2)).alias("code")).select("mention_id", F.col("code").cast("string").alias("code"))
    return N.context_similarity(wanted, q, codes).withColumn("similarity", F.round("similarity", 6))


@C.add(
    "link_reranked",
    QN.PRIOR
    + ", "
    + QD.DICT
    + f""", ca0 as (select key, code, n as c, n / sum(n) over (partition by key)::double as prior from pr union all select term, code, 0, 0 from di where not exists (select 1 from pr where pr.key = di.term and pr.code = di.code)),
ca as (select key, code, c, case when max(c) over (partition by key) = 0 then 1 / count(*) over (partition by key)::double else prior end as prior from ca0), m as (select mention_id, {V.norm_sql('mention')} as key from ok where source = 'model'),
j as (select mention_id, code, c, round(0.3::double * prior + 0.7::double * coalesce(case when (mention_id + l.label_ix) % 3 = 0 then (mention_id * 31 + l.label_ix * 7) % 100 / 100.0::double end, -1), 9) as s from m join ca using (key) left join (select distinct code, label_ix from labelset) l using (code) where key <> '')
select mention_id, code, round(s, 6) as score from j qualify row_number() over (partition by mention_id order by s desc, c desc, code) = 1""",
)
def link_reranked(s, d):
    """Linking with similarities of contexts (made from ids here) for a third of the candidates."""
    v = QN.valid(s, d)
    m = v.where("source = 'model'")
    lab = table(s, d, "labelset").select("code", "label_ix").distinct()
    x = F.col("mention_id") * 31 + F.col("label_ix") * 7
    third = F.filter(F.sequence(F.lit(0), F.lit(len(V.labels(s, d)) - 1)), lambda i: (F.col("mention_id") + i) % 3 == 0)
    sim = m.select("mention_id", F.explode(third).alias("label_ix")).join(lab, "label_ix").select("mention_id", "code", (x % 100 / 100.0).alias("similarity"))
    return N.link(m, N.prior(v.where("source = 'gold'")), QD.dictionary(s, d), sim, 0.3).select("mention_id", "code", F.round("score", 6).alias("score"))
