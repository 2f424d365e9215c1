"""Queries: set operations, fusion strategies, thresholds, search, pooling."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import fusion as U
from ..operators import pooling as P
from ..operators import scoring as S
from ..operators import tuning as T
from . import q_scoring as QS
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
W = {"sys_dict": 0.4, "sys_link": 0.2, "sys_net": 0.5, "sys_rank": 0.3}
CUT = {"sys_dict": 0.5, "sys_link": 0.5, "sys_net": 1.0, "sys_rank": 1.0}
GATE = 0.7
_w = "case system_name when 'sys_dict' then 0.4::double when 'sys_link' then 0.2::double when 'sys_net' then 0.5::double else 0.3::double end"
_cut = "case when system_ix < 2 then 0.5::double else 1.0::double end"
VOTES = V.SCORES + f", v as (select *, case when score >= {_cut} then {_w} else 0::double end as w, score >= {_cut} as vote from sc), cb as (select record_id, code, round(sum(w), 9) as weight, count(*) filter (vote) as votes from v group by all)"
OUT = "select record_id, code from "


def _pred(s, d, name):
    return V.flat(V.predictions(s, d)).where(F.col("system_name") == name)


def _sets(*names):
    return V.PREDS + "".join(f", {n} as (select record_id, code from pl where system_name = 'sys_{n}')" for n in names)


@C.add("merge_union", _sets("dict", "net") + "select * from dict union select * from net")
def merge_union(s, d):
    return U.union(_pred(s, d, "sys_dict"), _pred(s, d, "sys_net"))


@C.add("merge_intersection", _sets("dict", "net", "rank") + "select * from dict intersect select * from net intersect select * from rank")
def merge_intersection(s, d):
    return U.intersection(*[_pred(s, d, n) for n in ("sys_dict", "sys_net", "sys_rank")])


@C.add("merge_k_of_n", V.PREDS + "select record_id, code from pl group by all having count(*) >= 2")
def merge_k_of_n(s, d):
    return U.k_of_n([_pred(s, d, n) for n in V.SYSTEMS], 2)


@C.add("composition_dsl", VOTES + f""", a as (select record_id, code from cb where weight >= {GATE}), b as (select record_id, code from pl where system_name = 'sys_net'), c as (select record_id, code from pl where system_name = 'sys_dict')
select record_id, code from (select * from a union all select * from b union all select * from c) group by all having count(*) >= 2""")
def composition_dsl(s, d):
    base = {"weighted": U.weighted(V.scores(s, d), W, CUT, GATE), "net": _pred(s, d, "sys_net"), "dict": _pred(s, d, "sys_dict")}
    spec = U.parse_compositions([{"slug": "two_of_three", "op": "k_of_n", "k": 2, "inputs": ["weighted", "net", "dict"]}])[0]
    return U.compose(spec, base)


@C.add("normalized_scores", V.SCORES + "select system_name, record_id, code, round(score, 9) as score from sc")
def normalized_scores(s, d):
    raw = V.raw_scores(s, d)
    sc = raw.select("system_name", "system_ix", "record_id", "code", F.when(F.col("system_ix") >= 2, F.col("milli") / 1000.0).otherwise(F.col("p").cast("double")).alias("score"))
    thr = raw.where("system_ix >= 2").select("system_name", "code", (F.col("thr") / 1000.0).alias("threshold")).distinct()
    return U.normalized_scores(sc, thr, 1.0).select("system_name", "record_id", "code", F.round("score", 9).alias("score"))


@C.add("weighted_vote", VOTES + OUT + f"cb where weight >= {GATE}")
def weighted_vote(s, d):
    return U.weighted(V.scores(s, d), W, CUT, GATE)


@C.add("weighted_majority", VOTES + f", runs as (select record_id, code, (weight >= 0.5)::int + (weight >= 0.7)::int + (weight >= 0.9)::int as n from cb) " + OUT + "runs where n >= 2")
def weighted_majority(s, d):
    return U.majority([U.weighted(V.scores(s, d), W, CUT, g) for g in (0.5, 0.7, 0.9)])


@C.add("gated_secondary", VOTES + f", x as (select record_id, code, round(sum(w), 9) as f, round(sum(w) filter (system_name <> 'sys_link'), 9) as b from v group by all), y as (select *, max(b) over (partition by record_id) as best from x) " + OUT + f"y where case when best < 0.9 then f else b end >= {GATE}")
def gated_secondary(s, d):
    return U.gated_secondary(V.scores(s, d), W, CUT, GATE, ["sys_link"], 0.9)


@C.add("weighted_top_k", VOTES + f", t as (select * from cb where weight >= 0.4 qualify row_number() over (partition by record_id order by weight desc, code) <= 4) " + OUT + "t")
def weighted_top_k(s, d):
    return U.weighted_top_k(V.scores(s, d), W, CUT, 0.4, 4)


@C.add("frequency_buckets", VOTES + f", n as (select code, count(distinct record_id) as n from gl group by code) " + OUT + f"cb left join n using (code) where weight >= round(case when coalesce(n, 0) < 25 then {GATE * 1.08}::double else {GATE * 0.97}::double end, 9)")
def frequency_buckets(s, d):
    n = V.gold(s, d).select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).groupBy("code").agg(F.countDistinct("record_id").alias("n"))
    return U.frequency_buckets(V.scores(s, d), W, CUT, GATE, n)


@C.add("two_threshold", VOTES + OUT + f"cb where weight >= 0.9 or (weight >= round(0.9 * 0.72::double, 9) and votes >= 3)")
def two_threshold(s, d):
    return U.two_threshold(V.scores(s, d), W, CUT, 0.9)


CHAMP = (
    QS.PER_CLASS.replace(QS.BASE, V.SCORES, 1)
    + ", champ as (select code, system_name as champion from pc qualify row_number() over (partition by code order by round(f1, 9) desc, system_name) = 1)"
)


def _champions(s, d):
    return U.label_champions(QS._report(s, d), {n: i for i, n in enumerate(V.SYSTEMS)})


@C.add("label_champions", CHAMP + "select code, champion as system_name from champ")
def label_champions(s, d):
    return _champions(s, d)


@C.add("label_routing", CHAMP + "select record_id, sc.code from sc join champ on champ.code = sc.code and champion = system_name where round(score, 9) >= 0.9")
def label_routing(s, d):
    return U.label_routing(V.scores(s, d), _champions(s, d), 0.9)


@C.add("champion_plus_vote", CHAMP + f", v as (select sc.*, coalesce(champion, 'sys_dict') as champion, score >= {_cut} as vote from sc left join champ using (code)) select record_id, code from v group by all having count(*) filter (vote and system_name = champion) > 0 or count(*) filter (vote and system_name is distinct from champion) >= 2")
def champion_plus_vote(s, d):
    return U.champion_plus_vote(V.scores(s, d), _champions(s, d), 2, CUT, list(V.SYSTEMS))


@C.add("record_routing", V.SCORES + ", m as (select record_id, system_name, system_ix, round(max(score), 9) as s from sc group by all), r as (select record_id, system_name from m qualify row_number() over (partition by record_id order by s desc, system_ix) = 1) select record_id, code from sc join r using (record_id, system_name) where round(score, 9) >= 1")
def record_routing(s, d):
    sc = V.scores(s, d)
    return U.record_routing(sc, U.record_champions(sc, "max"))


BINARY = ["sys_dict", "sys_link"]
FACTORS = [0.8, 1.0, 1.2, 1.5]
# the base has a cell from 1 (a binary one 0.5) on; the others vote from the factor on, binary ones from 0.5 on; one count of votes adds and removes
COR = V.SCORES + """, f(f) as (values (0.8::double), (0.9::double), (1.0::double), (1.2::double), (1.5::double)),
x as (select f, record_id, code, count(*) filter (system_name = 'sys_net' and round(score, 9) >= 1) > 0 as own, count(*) filter (system_name <> 'sys_net' and round(score, 9) >= case when system_ix < 2 then 0.5 else f end) as n from sc cross join f group by all) """


@C.add("correction", COR + OUT + "x where f = 0.9 and ((own and n > 0) or (not own and n >= 2))")
def correction(s, d):
    return U.correction(V.scores(s, d), "sys_net", 2, 0.9, True, BINARY)


@C.add(
    "correction_grid",
    COR
    + """, g as (select p.v, f, p.r, record_id, code from x cross join (values (1, 0), (2, 0), (3, 0), (1, 1), (2, 1), (3, 1)) p(v, r) where f <> 0.9 and case when own then r = 0 or n > 0 else n >= v end),
tp as (select v, f, r, count(*) as tp from (select distinct g.v, g.f, g.r, gl.record_id, gl.ix from g join gl using (record_id, code)) group by all),
fp as (select v, f, r, count(*) as fp from g where not exists (select 1 from gl where gl.record_id = g.record_id and gl.code = g.code) group by all)
select v as votes, f as factor, r as remove, tp, fp, round(2 * tp / (tp + fp + (select sum(n_groups) from docs))::double, 6) as f1 from tp join fp using (v, f, r)""",
)
def correction_grid(s, d):
    g = U.correction_grid(V.scores(s, d), "sys_net", [1, 2, 3], FACTORS, BINARY)
    p = g.groupBy("votes", "factor", "remove", "record_id").agg(F.collect_set("code").alias("codes")).withColumn("system_name", F.struct("votes", "factor", "remove"))
    m = S.micro(V.gold(s, d), p)
    return m.select("system_name.votes", "system_name.factor", "system_name.remove", "tp", "fp", F.round("f1", 6).alias("f1"))


REPLAY = {"weighted": ("weighted", {"weights": W, "cuts": CUT, "gate": GATE}), "corrected": ("correction", {"base": "sys_net", "votes": 2, "factor": 0.9, "remove": True, "binary": BINARY}), "two_threshold": ("weighted_two_threshold", {"weights": W, "cuts": CUT, "gate": 0.9})}


@C.add(
    "export_replay",
    VOTES
    + f""", f(f) as (values (0.9::double)), x as (select f, record_id, code, count(*) filter (system_name = 'sys_net' and round(score, 9) >= 1) > 0 as own, count(*) filter (system_name <> 'sys_net' and round(score, 9) >= case when system_ix < 2 then 0.5 else f end) as n from sc cross join f group by all),
b as (select 'weighted' as strategy, record_id, code from cb where weight >= {GATE} union all select 'corrected', record_id, code from x where (own and n > 0) or (not own and n >= 2)
union all select 'two_threshold', record_id, code from cb where weight >= 0.9 or (weight >= round(0.9 * 0.72::double, 9) and votes >= 3)),
e as (select * from b union all select 'both', record_id, code from b where strategy in ('weighted', 'corrected') group by record_id, code having count(*) = 2)
select split, strategy, record_id, code from e join (select record_id, split from docs) using (record_id) where split in ('val', 'test')""",
)
def export_replay(s, d):
    both = U.parse_compositions([{"slug": "both", "op": "intersection", "inputs": ["weighted", "corrected"]}, {"slug": "none", "op": "union", "inputs": ["weighted", "absent"]}])
    split = V.gold(s, d).where("split in ('val', 'test')").select("record_id", "split")
    sc = V.scores(s, d).join(split.select("record_id"), "record_id", "left_semi")
    return U.replay(sc, REPLAY, both).join(split, "record_id").select("split", "strategy", "record_id", "code")


@C.add(
    "cluster_champions",
    QS.HITS
    + f""", c as (select record_id, record_id % 7 as cluster from docs), x as (select cluster, system_name, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from sd join c using (record_id) group by all)
select cluster, system_name, round({QS.F1.format('tp', 'fp', 'fn')}, 6) as f1 from x qualify row_number() over (partition by cluster order by round({QS.F1.format('tp', 'fp', 'fn')}, 9) desc, system_name) = 1""",
)
def cluster_champions(s, d):
    g = V.gold(s, d)
    clusters = g.select("record_id", (F.col("record_id") % 7).alias("cluster"))
    return QS._r(U.cluster_champions(clusters, S.score_documents(g, V.predictions(s, d)), {n: i for i, n in enumerate(V.SYSTEMS)}), "f1")


GRID = [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3]


def _net(s, d):
    return V.scores(s, d).where("system_name = 'sys_net'").select("record_id", "code", "score")


_G = "(values " + ", ".join(f"({g}::double)" for g in GRID) + ") t(t)"


@C.add(
    "global_threshold_sweep",
    V.SCORES
    + f""", g as (select t, record_id, code from sc cross join {_G} where system_name = 'sys_net' and round(score, 9) >= t),
tp as (select t, count(*) as tp from (select distinct t, gl.record_id, gl.ix from g join gl using (record_id, code)) group by t),
fp as (select t, count(*) as fp from g where not exists (select 1 from gl where gl.record_id = g.record_id and gl.code = g.code) group by t), n as (select sum(n_groups) as n from docs)
select t as threshold, tp, fp, (n - tp)::bigint as fn, round(2 * tp / (tp + fp + n)::double, 6) as f1 from tp join fp using (t), n""",
)
def global_threshold_sweep(s, d):
    return QS._r(T.threshold_sweep(_net(s, d), V.gold(s, d), GRID), "f1")


@C.add(
    "label_thresholds",
    V.SCORES
    + f""", pos as (select code, count(distinct record_id) as pos from gl group by code), g as (select t, sc.code, count(m.code) as tp, count(*) - count(m.code) as fp from sc cross join {_G} left join mem m on m.record_id = sc.record_id and m.code = sc.code where system_name = 'sys_net' and round(score, 9) >= t group by all),
f as (select g.code, t, round(2 * tp / (tp + fp + pos)::double, 9) as f1 from g join pos using (code))
select code, t as threshold, round(f1, 6) as f1 from f qualify row_number() over (partition by code order by f1 desc, t) = 1""",
)
def label_thresholds(s, d):
    return QS._r(T.label_thresholds(_net(s, d), V.gold(s, d), GRID), "f1")


@C.add(
    "leave_one_out",
    V.GROUPS
    + ", "
    + V.PREDS
    + """, p as (select l.s, record_id, code from pl cross join (values (''), ('sys_dict'), ('sys_link'), ('sys_net'), ('sys_rank')) l(s) where l.s <> system_name group by all having count(*) >= 2),
tp as (select s, count(*) as tp from (select distinct s, gl.record_id, ix from p join gl using (record_id, code)) group by s),
fp as (select s, count(*) as fp from p where record_id in (select record_id from docs) and not exists (select 1 from gl where gl.record_id = p.record_id and gl.code = p.code) group by s)
select s as left_out, tp, fp, round(2 * tp / (tp + fp + (select sum(n_groups) from docs))::double, 6) as f1 from tp join fp using (s)""",
)
def leave_one_out(s, d):
    return QS._r(T.leave_one_out(V.flat(V.predictions(s, d)), V.gold(s, d), list(V.SYSTEMS), 2), "f1")


@C.add("tune_coordinate_descent")
def tune_coordinate_descent(s, d):
    return T.coordinate_descent(_net(s, d), V.gold(s, d).where("split = 'val'"), GRID)


def _matrix(s, d):
    """The validation matrix of a search: scores by system of each cell, and the gold groups that it hits."""
    g = V.gold(s, d).where("split = 'val'")
    long = g.select("record_id", F.posexplode("groups").alias("ix", "g")).withColumn("group_ix", F.pmod(F.xxhash64("record_id", "ix"), F.lit(2**31 - 1)).cast("int"))
    total = g.agg(F.sum(F.size("groups")).alias("n_groups"))
    hits = long.select("record_id", "group_ix", F.explode(F.array_distinct("g")).alias("code")).groupBy("record_id", "code").agg(F.collect_set("group_ix").alias("group_ix"))
    cells = V.scores(s, d).join(g.select("record_id"), "record_id", "left_semi").groupBy("record_id", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("system_ix", "score"))), lambda x: x.score).alias("scores"))
    return cells.join(hits, ["record_id", "code"], "left").select("scores", F.coalesce("group_ix", F.array().cast("array<int>")).alias("group_ix")).join(F.broadcast(total))


@C.add("random_search")
def random_search(s, d):
    return T.search(_matrix(s, d), len(V.SYSTEMS), "random", 4, 60)


@C.add("hill_climb")
def hill_climb(s, d):
    return T.search(_matrix(s, d), len(V.SYSTEMS), "climb", 4, 60)


@C.add("vns_search")
def vns_search(s, d):
    return T.search(_matrix(s, d), len(V.SYSTEMS), "vns", 4, 60)


CHUNKS = V.SCORES + ", ck as (select record_id, code, system_ix as chunk_ix, (milli - thr) / 100.0::double as logit from raw)"


def _chunks(s, d):
    return V.raw_scores(s, d).select("record_id", F.col("system_ix").alias("chunk_ix"), "code", ((F.col("milli") - F.col("thr")) / 100.0).alias("logit"))


for _how, _expr in {"max": "max(logit)", "mean": "avg(logit)", "mean_max": "0.5 * avg(logit) + 0.5 * max(logit)", "lme": "max(logit) + 2.0 * ln(avg(exp((logit - m) / 2.0)))"}.items():
    _src = "ck" if _how != "lme" else "(select *, max(logit) over (partition by record_id, code) as m from ck)"

    def _pool(s, d, how=_how):
        return QS._r(P.pool(_chunks(s, d), how, temperature=2.0), "score")

    C.add(f"chunk_pool_{_how}", CHUNKS + f" select record_id, code, round(1 / (1 + exp(-({_expr}))), 6) as score from {_src} group by record_id, code")(_pool)


@C.add("seed_average", V.SCORES + "select record_id, code, round(avg(milli / 1000.0::double), 6) as score, count(*) as runs from raw group by all")
def seed_average(s, d):
    return QS._r(P.average_runs(V.raw_scores(s, d).select("record_id", "code", (F.col("milli") / 1000.0).alias("score"))), "score")


@C.add("prob_hierarchy", V.SCORES + ", a as (select record_id, code, avg(milli / 1000.0::double) as score from raw group by all), h(child, parent) as (values ('G54', 'G95'), ('V43', 'V85')), u as (select * from a union all select record_id, parent, score from a join h on code = child) select record_id, code, round(max(score), 6) as score from u group by all")
def prob_hierarchy(s, d):
    a = P.average_runs(V.raw_scores(s, d).select("record_id", "code", (F.col("milli") / 1000.0).alias("score")))
    return QS._r(P.raise_parents(a, s.createDataFrame([("G54", "G95"), ("V43", "V85")], "child string, parent string")), "score")


@C.add("pos_weights", V.GROUPS + ", n as (select count(*) as n from docs), p as (select l.code, count(distinct record_id) as pos from (select distinct code from labelset) l left join gl using (code) group by all) select code, pos, round(least(greatest((n - pos) / greatest(pos, 1)::double, 1), 20), 6) as weight from p, n")
def pos_weights(s, d):
    return QS._r(P.class_weights(V.gold(s, d), table(s, d, "labelset")), "weight")


@C.add("score_losses", V.SCORES + """, c as (select least(greatest(milli / 1000.0::double, 1e-7), 1 - 1e-7) as p, (m.code is not null)::int as y from raw left join mem m on m.record_id = raw.record_id and m.code = raw.code where system_name = 'sys_net'), q as (select p, y, greatest(p - 0.05::double, 1e-7) as q from c)
select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as bce, round(avg(-(y * (1 - p) * ln(p) + (1 - y) * pow(q, 4) * ln(1 - q))), 6) as asl from q""")
def score_losses(s, d):
    m = V.gold(s, d).select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).withColumn("y", F.lit(1))
    c = V.raw_scores(s, d).where("system_name = 'sys_net'").join(m, ["record_id", "code"], "left").select((F.col("milli") / 1000.0).alias("score"), F.coalesce("y", F.lit(0)).alias("y"))
    return QS._r(P.losses(c), "bce", "asl")
