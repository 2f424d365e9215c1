"""Queries: splits, folds, augmentation, clusters."""

from pyspark.sql import functions as F

from ..operators import splits as P
from . import q_dictionary as QD
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
LAB = V.GROUPS + ", lb as (select distinct record_id, split, trim(code) as code from gl where trim(code) <> '')"


def _labels(s, d):
    codes = F.array_distinct(F.transform(F.flatten("groups"), lambda x: F.trim(x)))
    return V.gold(s, d).select("record_id", "split", F.explode(codes).alias("code")).where("code <> ''")


@C.add("label_doc_counts", LAB + "select code, count(distinct record_id) as n from lb group by all")
def label_doc_counts(s, d):
    return P.label_counts(_labels(s, d))


REP = LAB + ", rp as (select code, count(*) as total, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from lb group by all)"


def _report(s, d):
    x = _labels(s, d)
    return P.split_report(x.select("record_id", "code"), x.select("record_id", "split").distinct())


@C.add("split_report_pivot", REP + "select * from rp")
def split_report_pivot(s, d):
    return _report(s, d)


@C.add(
    "split_violations",
    REP
    + """, v as (select code, case when total = 1 and train = 0 then 'single outside train' when total between 2 and 4 and (train = 0 or test = 0) then 'rare not in train and test' when total >= 5 and (train = 0 or val = 0 or test = 0) then 'absent from a split' end as rule from rp) select code, rule from v where rule is not null""",
)
def split_violations(s, d):
    return P.violations(_report(s, d))


@C.add("kfold_assign", V.REC + "select record_id, (record_id * 7919 + 42 * 104729) % (5 * 1000003) % 5 as fold from rec")
def kfold_assign(s, d):
    return V.records(s, d).select("record_id", P.fold(F.col("record_id"), 5).alias("fold"))


@C.add("coverage_patch", LAB + ", m as (select code, min(record_id) filter (split = 'val') as v, min(record_id) filter (split = 'test') as t from lb group by all having count(*) filter (split = 'train') = 0) select record_id, case when record_id in (select coalesce(v, t) from m where coalesce(v, t) is not null) then 'train' else split end as split from docs")
def coverage_patch(s, d):
    return P.coverage_patch(_labels(s, d).select("record_id", "code"), V.gold(s, d).select("record_id", "split"))


@C.add("augment_multiplier", LAB + ", n as (select code, count(distinct record_id) as n from lb group by all) select record_id, max(case when n < 50 then 4 when n < 150 then 3 when n < 400 then 2 else 0 end)::bigint as copies from lb join n using (code) group by all")
def augment_multiplier(s, d):
    return P.multipliers(_labels(s, d).select("record_id", "code"))


@C.add("augment_texts")
def augment_texts(s, d):
    return P.augment(V.records(s, d).select("record_id", "text").where("text <> ''"), augment_multiplier(s, d), QD.dictionary(s, d))


@C.add("rare_placement")
def rare_placement(s, d):
    rows = P.rare_placement(_labels(s, d).select("record_id", "code"))
    return s.createDataFrame(rows, "record_id bigint, split string, code string")


def _all(s, d):
    """Records that a split is of: those without labels too, but for the blind ones, whose labels nobody knows."""
    return table(s, d, "records").where("record_id is not null and (split is null or split <> 'blind_test' or size(document_level_annotations) > 0)").select("record_id")


@C.add("stratified_split")
def stratified_split(s, d):
    return P.stratified(_labels(s, d).select("record_id", "code"), records=_all(s, d))


@C.add("stratified_violations", "select null::varchar as code, null::varchar as rule where false")
def stratified_violations(s, d):
    """Labels of the made split that break a rule: none."""
    from .staging import stage

    # the labels that are split are those that are counted, also where a record has several rows
    x = stage(_labels(s, d).select("record_id", "code"), "labels")
    # files of rising ids are small for their rows: their size is no reason to broadcast them
    return P.violations(P.split_report(x, P.stratified(x, records=_all(s, d)).hint("merge")))


@C.add("two_way_split", LAB + ", n as (select code from lb group by code having count(distinct record_id) = 1) select count(*) as records, 0 as single_outside from (select distinct record_id from lb)")
def two_way_split(s, d):
    """All records of labels, and how many labels of one document are outside train: none."""
    x = _labels(s, d).select("record_id", "code")
    w = P.two_way(x)
    lone = x.join(P.label_counts(x).where("n = 1"), "code").join(w.where("split <> 'train'"), "record_id").agg(F.count("*").cast("int").alias("single_outside"))
    return w.agg(F.count("*").alias("records")).join(F.broadcast(lone))


def _features(s, d):
    from pyspark.ml.functions import array_to_vector

    e = table(s, d, "embeddings").where("embedding is not null")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@C.add("kmeans_assign")
def kmeans_assign(s, d):
    from ..operators.clustering import assign

    return assign(_features(s, d), "kmeans", 8)


@C.add("gmm_assign")
def gmm_assign(s, d):
    from ..operators.clustering import assign

    return assign(_features(s, d), "gmm", 4)


@C.add("cluster_sweep")
def cluster_sweep(s, d):
    """Clusters of all vectors by the methods that are fit on a bounded sample of the training part, the rest assigned."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from ..operators.clustering import fit_assign

    e = table(s, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    parts = [fit_assign(e, e.where("vec_id % 5 <> 0"), m, k).withColumns({"method": F.lit(m), "k": F.lit(k)}) for m, k in (("ward", 4), ("ward", 8), ("spectral", 4), ("dbscan", 5))]
    return reduce(DataFrame.unionByName, parts).groupBy("method", "k", "cluster").agg(F.count("*").alias("vectors"))


@C.add("nearest_centroid", """with c as (select label, i, avg(x) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all), v as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), d as (select vec_id, label, round(sum((x - m) * (x - m)), 9) as dist from v join c using (i) group by all)
select vec_id, label as cluster, round(dist, 6) as distance from d qualify row_number() over (partition by vec_id order by dist, label) = 1""")
def nearest_centroid(s, d):
    from ..operators.clustering import nearest

    e = table(s, d, "embeddings").where("embedding is not null")
    return nearest(e, e.select("label", "embedding")).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))
