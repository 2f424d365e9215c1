"""Queries: group-level scoring, reports, paired tests."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import scoring as S
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
BASE = V.GROUPS + ", " + V.PREDS
HITS = (
    BASE
    + """, known as (select system_name, record_id from pr where record_id in (select record_id from docs)),
hit as (select distinct pl.system_name, gl.record_id, gl.ix from pl join gl on pl.record_id = gl.record_id and pl.code = gl.code),
tp as (select system_name, record_id, count(*) as tp from hit group by all),
fp as (select system_name, record_id, count(*) as fp from pl where record_id in (select record_id from docs) and not exists (select 1 from gl where gl.record_id = pl.record_id and gl.code = pl.code) group by all),
sd as (select k.system_name, k.record_id, coalesce(tp.tp, 0) as tp, coalesce(fp.fp, 0) as fp, d.n_groups - coalesce(tp.tp, 0) as fn from known k join docs d using (record_id) left join tp using (system_name, record_id) left join fp using (system_name, record_id)),
mi as (select system_name, sum(tp)::bigint as tp, sum(fp)::bigint as fp, (select sum(n_groups) from docs)::bigint as n from sd group by all)"""
)
PER_CLASS = (
    HITS
    + """, sup as (select code, count(*) as support from gl group by code),
ch as (select h.system_name, gl.code, count(*) as hits from hit h join gl using (record_id, ix) group by all),
cf as (select system_name, code, count(*) as fp from pl where record_id in (select record_id from docs) and not exists (select 1 from gl where gl.record_id = pl.record_id and gl.code = pl.code) group by all),
pc0 as (select s.system_name, l.code, coalesce(sup.support, 0) as support, coalesce(ch.hits, 0) as hits, coalesce(cf.fp, 0) as fp from (select distinct code from labelset) l cross join (select distinct system_name from pr) s left join sup using (code) left join ch using (system_name, code) left join cf using (system_name, code)),
pc1 as (select *, case when hits + fp = 0 then 0 else hits / (hits + fp)::double end as precision, case when support = 0 then 0 else hits / support::double end as recall from pc0),
pc as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from pc1)"""
)
F1 = "case when 2 * {0} + {1} + {2} = 0 then 0 else 2 * {0} / (2 * {0} + {1} + {2})::double end"


def _both(s, d):
    return V.gold(s, d), V.predictions(s, d)


def _report(s, d):
    return S.per_class(*_both(s, d), table(s, d, "labelset"))


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@C.add("score_document", HITS + "select system_name, record_id, tp, fp, fn from sd")
def score_document(s, d):
    return S.score_documents(*_both(s, d))


@C.add("micro_f1_by_system", HITS + f"select system_name, tp, fp, n - tp as fn, round(tp / (tp + fp)::double, 6) as precision, round(tp / n::double, 6) as recall, round({F1.format('tp', 'fp', '(n - tp)')}, 6) as f1 from mi")
def micro_f1(s, d):
    return _r(S.micro(*_both(s, d)), "precision", "recall", "f1")


@C.add(
    "micro_f1_by_split",
    HITS
    + f""", t as (select split, sum(n_groups)::bigint as n from docs group by all), x as (select system_name, split, sum(tp)::bigint as tp, sum(fp)::bigint as fp from sd join docs using (record_id) group by all)
select system_name, split, tp, fp, n - tp as fn, round({F1.format('tp', 'fp', '(n - tp)')}, 6) as f1 from x join t using (split)""",
)
def micro_f1_by_split(s, d):
    return _r(S.micro(*_both(s, d), "split").select("system_name", "split", "tp", "fp", "fn", "f1"), "f1")


@C.add("per_class_report", PER_CLASS + "select system_name, code, support, hits, fp, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from pc")
def per_class_report(s, d):
    return _r(_report(s, d), "precision", "recall", "f1")


@C.add("macro_f1", PER_CLASS + "select system_name, round(coalesce(avg(f1) filter (support > 0), 0), 6) as macro_present, round(avg(f1), 6) as macro_all from pc group by system_name")
def macro_f1(s, d):
    return _r(S.macro(_report(s, d)), "macro_present", "macro_all")


@C.add(
    "doc_breakdown",
    HITS
    + """, g2 as (select record_id, ix, coalesce(string_agg(code, '+' order by code), '') as codes from (select distinct record_id, ix, code from gl union all select record_id, ix, null from grp where len(codes) = 0) group by all),
miss as (select k.system_name, k.record_id, string_agg(g2.codes, '|' order by g2.codes) as missed from known k join g2 using (record_id) where not exists (select 1 from hit h where h.system_name = k.system_name and h.record_id = k.record_id and h.ix = g2.ix) group by all),
wr as (select system_name, record_id, string_agg(code, '|' order by code) as wrong from pl where not exists (select 1 from gl where gl.record_id = pl.record_id and gl.code = pl.code) group by all)
select k.system_name, k.record_id, coalesce(missed, '') as missed, coalesce(wrong, '') as wrong from known k left join miss using (system_name, record_id) left join wr using (system_name, record_id)""",
)
def doc_breakdown(s, d):
    return S.breakdown(*_both(s, d))


@C.add("missing_extra_ids", HITS + "select p.system_name, (select count(*) from docs) - count(d.record_id) as missing, count(*) - count(d.record_id) as extra from pr p left join docs d using (record_id) group by all")
def missing_extra(s, d):
    return S.missing_and_extra(*_both(s, d))


@C.add("avg_codes_per_doc", BASE + ", n as (select system_name, record_id, count(code) as n from pr left join pl using (system_name, record_id) group by all) select system_name, round(avg(n), 6) as avg_codes from n group by all")
def avg_codes(s, d):
    return V.predictions(s, d).groupBy("system_name").agg(F.round(F.avg(F.size("codes")), 6).alias("avg_codes"))


@C.add(
    "compare_table",
    HITS
    + f""", m as (select system_name, round(tp / (tp + fp)::double, 4) as precision, round(tp / n::double, 4) as recall, round({F1.format('tp', 'fp', '(n - tp)')}, 4) as f1 from mi),
u as (select * from m qualify row_number() over (partition by precision, recall, f1 order by length(system_name), system_name) = 1)
select system_name, precision, recall, f1, row_number() over (order by f1 desc, system_name) as rank from u""",
)
def compare_table(s, d):
    return S.compare_table(*_both(s, d))


BANDS = "case when {0} >= 500 then '>=500' when {0} >= 100 then '100-499' when {0} >= 10 then '10-99' else '<10' end"


@C.add(
    "frequency_band_f1",
    PER_CLASS
    + f""", b as (select system_name, {BANDS.format('support')} as band, count(*) as labels, sum(support)::bigint as support, sum(hits)::bigint as hits, sum(fp)::bigint as fp from pc group by all)
select system_name, band, labels, support, hits, fp, round({F1.format('hits', 'fp', '(support - hits)')}, 6) as f1 from b""",
)
def frequency_band_f1(s, d):
    return _r(S.band_f1(_report(s, d)), "f1")


@C.add(
    "per_label_gain",
    PER_CLASS
    + """select a.code, round(a.f1 - b.f1, 6) as gain, case when a.f1 - b.f1 > 0 then 'improved' when a.f1 - b.f1 < 0 then 'degraded' else 'same' end as direction
from pc a join pc b on a.code = b.code and a.system_name = 'sys_dict' and b.system_name = 'sys_net' and a.support > 0""",
)
def per_label_gain(s, d):
    return _r(S.label_gain(_report(s, d), "sys_dict", "sys_net"), "gain")


@C.add(
    "fp_fn_counts",
    BASE
    + """, fl as (select distinct record_id, code from gl)
select system_name, 'fp' as kind, code, count(*) as n from pl where record_id in (select record_id from docs) and not exists (select 1 from fl where fl.record_id = pl.record_id and fl.code = pl.code) group by all
union all select p.system_name, 'fn', fl.code, count(*) from pr p join fl using (record_id) where not exists (select 1 from pl where pl.system_name = p.system_name and pl.record_id = fl.record_id and pl.code = fl.code) group by all""",
)
def fp_fn_counts(s, d):
    return S.error_counts(*_both(s, d))


@C.add(
    "exact_match_upset",
    HITS
    + """, ok as (select record_id, string_agg(system_name, '+' order by system_name) as systems from sd where fp = 0 and fn = 0 group by all)
select coalesce(systems, '') as systems, count(*) as records from docs left join ok using (record_id) group by all""",
)
def exact_match_upset(s, d):
    return S.exact_match_sets(*_both(s, d))


@C.add(
    "mcnemar_counts",
    HITS
    + """, x as (select g.record_id, g.ix, a.ix is not null as a, b.ix is not null as b from grp g left join (select * from hit where system_name = 'sys_dict') a using (record_id, ix) left join (select * from hit where system_name = 'sys_net') b using (record_id, ix))
select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b, count(*) filter (a and b) as both, count(*) filter (not a and not b) as neither from x""",
)
def mcnemar_counts(s, d):
    return S.mcnemar(*_both(s, d), "sys_dict", "sys_net")


_POISSON = "case " + " ".join(f"when u >= {c} then {k + 1}" for k, c in reversed(list(enumerate(S.POISSON)))) + " else 0 end"


@C.add(
    "bootstrap_ci",
    HITS
    + f""", j as (select d.record_id, d.n_groups as n, coalesce(a.tp, 0) as tp_a, coalesce(a.fp, 0) as fp_a, coalesce(b.tp, 0) as tp_b, coalesce(b.fp, 0) as fp_b from docs d left join (select * from sd where system_name = 'sys_dict') a using (record_id) left join (select * from sd where system_name = 'sys_net') b using (record_id)),
u as (select j.*, r, ((record_id % 1000003) * 7919 + (r::bigint * 104729) % 1000003 * ((record_id % 8191) + 13)) % 1000003 as u from j cross join range(1, 101) t(r)),
w as (select *, {_POISSON} as w from u),
x as (select r, sum(n * w) as n, sum(tp_a * w) as tp_a, sum(fp_a * w) as fp_a, sum(tp_b * w) as tp_b, sum(fp_b * w) as fp_b from w where w > 0 group by r),
e as (select 2 * tp_a / (tp_a + fp_a + n)::double - 2 * tp_b / (tp_b + fp_b + n)::double as d from x)
select round(avg(d), 6) as mean, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, round(2 * least(avg((d <= 0)::int), avg((d >= 0)::int)), 6) as p from e""",
)
def bootstrap_ci(s, d):
    return _r(S.bootstrap(*_both(s, d), "sys_dict", "sys_net", 100), "mean", "low", "high", "p")


@C.add(
    "cooccurrence_rules",
    V.GROUPS
    + """, dc as (select distinct record_id, code from gl), occ as (select code, count(*) as n from gl group by code),
p as (select a.code as code_a, b.code as code_b, count(*) as k from dc a join dc b on a.record_id = b.record_id and a.code <> b.code group by all)
select code_a, code_b, k as n_both, round(k / n::double, 3) as probability from p join occ on occ.code = code_a where k >= 10 and k >= 0.25 * n""",
)
def cooccurrence_rules(s, d):
    from ..operators.association import rules

    return rules(V.gold(s, d), 10, 0.25)


@C.add(
    "jaccard_matrix",
    V.GROUPS
    + """, occ as (select code, count(*) as n from gl group by code order by n desc, code limit 20), dc as (select distinct record_id, code from gl where code in (select code from occ)), sz as (select code, count(*) as n from dc group by code),
p as (select a.code as code_a, b.code as code_b, count(*) as k from dc a join dc b on a.record_id = b.record_id and a.code < b.code group by all)
select code_a, code_b, k as both, round(k / (x.n + y.n - k)::double, 6) as jaccard from p join sz x on x.code = code_a join sz y on y.code = code_b""",
)
def jaccard_matrix(s, d):
    from ..operators.association import jaccard

    return _r(jaccard(V.gold(s, d), 20), "jaccard")


@C.add(
    "confusion_matrix",
    BASE
    + """, fl as (select distinct record_id, code from gl), top as (select code from (select code, count(*) as n from gl group by code order by n desc, code limit 5))
select system_name, pl.code as predicted, fl.code as gold, count(*) as n from pl join fl using (record_id) where pl.code in (select code from top) and fl.code in (select code from top) group by all""",
)
def confusion_matrix(s, d):
    from ..operators.association import confusion

    return confusion(*_both(s, d), 5)


@C.add("label_positives", V.GROUPS + "select l.code, count(distinct record_id) as positives from (select distinct code from labelset) l left join gl using (code) group by all")
def label_positives(s, d):
    pos = V.gold(s, d).select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).groupBy("code").agg(F.countDistinct("record_id").alias("positives"))
    return table(s, d, "labelset").select("code").distinct().join(pos, "code", "left").na.fill(0)


@C.add("label_frequency", V.GROUPS + f", n as (select code, count(distinct record_id) as n from gl group by code) select code, n, {BANDS.format('n')} as band, row_number() over (order by n desc, code) as rank from n")
def label_frequency(s, d):
    from pyspark.sql import Window as W

    n = V.gold(s, d).select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).groupBy("code").agg(F.countDistinct("record_id").alias("n"))
    return n.select("code", "n", L.band(F.col("n")).alias("band"), F.row_number().over(W.orderBy(F.desc("n"), "code")).cast("bigint").alias("rank"))
