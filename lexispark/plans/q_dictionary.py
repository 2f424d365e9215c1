"""Queries: dictionary loading, mining, matching, rules, filters, and the flagship evaluation."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import dictionary as D
from ..operators import scoring as S
from . import q_scoring as QS
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
DICT = f"""di0 as (select {V.norm_sql('term')} as term, unnest(string_split(codes_pipe_sep, '|')) as code from term_dictionary), di as (select distinct term, trim(code) as code from di0 where term <> '' and trim(code) <> '')"""
MATCH = (
    V.GROUPS
    + ", "
    + DICT
    + f""", nt as (select record_id, {V.norm_sql('text')} as norm from rec where text is not null),
ma as (select distinct record_id, term, code from nt join di on contains(' ' || norm || ' ', ' ' || term || ' ')),
mc as (select distinct record_id, code from ma)"""
)
RULES = [(["V85", "W55"], ["W55"]), (["G54"], ["G95", "V43"]), (["G95"], ["S71"])]
BOOSTS = [(["αυτ", "στενωση"], ["W55"]), (["shunt"], ["B46", "P59"])]
FAMILY, STOPS = ["οικογενειακο ιστορικο"], ["διαρκεια", "κοινωνικο ιστορικο", "συνηθειεσ", "χορηγηθηκε"]


def dictionary(s, d):
    return D.load(table(s, d, "term_dictionary"))


def coded(s, d):
    """record_id, codes of all records by dictionary."""
    return D.predict(V.records(s, d), dictionary(s, d))


@C.add("dictionary_load", DICT + "select term, string_agg(code, '|' order by code) as codes from di group by all")
def dictionary_load(s, d):
    return dictionary(s, d).select("term", F.array_join("codes", "|").alias("codes"))


@C.add("dictionary_by_code", DICT + "select code, string_agg(term, '|' order by term) as terms from di group by all")
def dictionary_by_code(s, d):
    return D.by_code(dictionary(s, d))


@C.add("dictionary_last_wins", f"with x as (select {V.norm_sql('code')} as term, greek_description as c, row_number() over (order by code, greek_description nulls first) as o from code_lookup) select term, c as codes from x where term <> '' qualify row_number() over (partition by term order by o desc) = 1")
def dictionary_last_wins(s, d):
    o = F.struct("code", F.col("greek_description").isNotNull(), "greek_description")
    raw = table(s, d, "code_lookup").select("code", F.coalesce("greek_description", F.lit("")).alias("x"), o.alias("o"), F.col("greek_description").isNull().alias("z"))
    out = D.load_last_wins(raw, "o", "code", "x")
    return out.select("term", F.nullif(F.array_join("codes", "|"), F.lit("")).alias("codes"))


@C.add("mine_dictionary", V.MEN + f""", m as (select {V.norm_sql('mention')} as term, code from men where mention is not null and code is not null), n as (select term, code, count(*) as n from m where length(term) >= 4 group by all), k as (select *, sum(n) over (partition by term) as total from n)
select term, string_agg(code, '|' order by code) as codes from k where n >= 0.2 * total group by all""")
def mine_dictionary(s, d):
    return D.mine(V.mentions(s, d)).select("term", F.array_join("codes", "|").alias("codes"))


@C.add("match_boundary", MATCH + "select record_id, term, string_agg(code, '|' order by code) as codes from ma group by all")
def match_boundary(s, d):
    return D.match(V.records(s, d), dictionary(s, d)).select("record_id", "term", F.array_join("codes", "|").alias("codes"))


@C.add("match_boundary_by_join", MATCH + "select record_id, term, string_agg(code, '|' order by code) as codes from ma group by all")
def match_boundary_by_join(s, d):
    return D.match_by_join(V.records(s, d), dictionary(s, d)).select("record_id", "term", F.array_join("codes", "|").alias("codes"))


@C.add("match_substring", MATCH + "select record_id, term, string_agg(distinct code, '|' order by code) as codes from nt join di on contains(norm, term) group by all")
def match_substring(s, d):
    return D.match_substring(V.records(s, d), dictionary(s, d)).select("record_id", "term", F.array_join("codes", "|").alias("codes"))


@C.add(
    "dict_group_f1",
    MATCH
    + f""", hit as (select distinct gl.record_id, gl.ix from mc join gl using (record_id, code)), wrong as (select record_id, code from mc where record_id in (select record_id from docs) except select record_id, code from gl),
c as (select (select count(*) from hit) as tp, (select count(*) from wrong) as fp, (select sum(n_groups) from docs)::bigint as n)
select tp, fp, n - tp as fn, round(tp / (tp + fp)::double, 6) as precision, round(tp / n::double, 6) as recall, round({QS.F1.format('tp', 'fp', '(n - tp)')}, 6) as f1 from c""",
)
def dict_group_f1(s, d):
    p = coded(s, d).withColumn("system_name", F.lit("dictionary"))
    return QS._r(S.micro(V.gold(s, d), p).drop("system_name"), "precision", "recall", "f1")


def _rules_sql(rules):
    """The same pass over sets, written as set operations rule by rule."""
    out, last = "", "mc"
    for i, (any_of, add) in enumerate(rules):
        a = ", ".join(f"'{c}'" for c in any_of)
        b = ", ".join(f"('{c}')" for c in add)
        out += f", k{i} as (select record_id, code from {last} union select record_id, c from (select distinct record_id from {last} where code in ({a})) x cross join (values {b}) v(c))"
        last = f"k{i}"
    return out, last


_R, _LAST = _rules_sql(RULES)


@C.add("cooccurrence_closure", MATCH + _R + f" select record_id, string_agg(code, '|' order by code) as codes from {_LAST} group by all")
def cooccurrence_closure(s, d):
    return coded(s, d).select("record_id", F.array_join(F.array_sort(L.close(F.col("codes"), RULES)), "|").alias("codes"))


_B = "".join(f" union select record_id, c from nt cross join (values {', '.join(f'(' + repr(c) + ')' for c in add)}) v(c) where " + " or ".join(f"contains(norm, '{p}')" for p in pats) for pats, add in BOOSTS)


@C.add("rule_boosts", MATCH + ", b as (select record_id, code from mc" + _B + ") select record_id, string_agg(code, '|' order by code) as codes from b group by all")
def rule_boosts(s, d):
    r = V.records(s, d).where("text is not null").join(coded(s, d), "record_id", "left")
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    j = r.select("record_id", T.let(T.normalize_text(F.col("text"), fold_sigma=True), lambda n: L.boost(n, codes, BOOSTS)).alias("codes"))
    return j.where(F.size("codes") > 0).select("record_id", F.array_join(F.array_sort("codes"), "|").alias("codes"))


@C.add(
    "section_filter",
    MATCH
    + f""", p1 as (select record_id, norm, strpos(norm, '{FAMILY[0]}') as h from nt), p2 as (select *, case when h = 0 then '' else norm[h:] end as tail from p1),
p3 as (select *, least({', '.join(f"case when strpos(tail, '{x}') = 0 then 1000000000 else strpos(tail, '{x}') - 1 end" for x in STOPS)}) as e from p2),
p4 as (select record_id, h, case when h = 0 then norm else norm[:h - 1] || tail[e + 1:] end as rest from p3),
x as (select distinct record_id, code from p4 join di on contains(' ' || trim(regexp_replace(rest, ' +', ' ', 'g')) || ' ', ' ' || term || ' ') union select record_id, 'FAM' from p4 where h > 0)
select record_id, string_agg(code, '|' order by code) as codes from x group by all""",
)
def section_filter(s, d):
    return D.section_filter(V.records(s, d), dictionary(s, d), FAMILY, STOPS, "FAM").select("record_id", F.array_join("codes", "|").alias("codes"))


PAIRS = [("χωρισ", "φλεγμονη", ["B46"]), ("δεν", "διαταση", ["W55", "V85"])]


def _near(neg, dis):
    pos = lambda x: f"list_position(list_transform(tokens, lambda t: contains(t, '{x}')), true)"
    return f"coalesce({pos(neg)}, 0) > 0 and coalesce({pos(dis)}, 0) > 0 and abs({pos(neg)} - {pos(dis)}) <= 5"


@C.add(
    "negation_filter",
    MATCH
    + ", tk as (select record_id, string_split(norm, ' ') as tokens from nt), x as (select mc.record_id, mc.code from mc join tk using (record_id) where not ("
    + ") and not (".join(f"code in ({', '.join(repr(c) for c in codes)}) and {_near(n, dis)}" for n, dis, codes in PAIRS)
    + ")) select record_id, string_agg(code, '|' order by code) as codes from x group by all",
)
def negation_filter(s, d):
    j = V.records(s, d).join(coded(s, d), "record_id")
    return D.negation_filter(j, PAIRS).where(F.size("codes") > 0).select("record_id", F.array_join(F.array_sort("codes"), "|").alias("codes"))


@C.add(
    "coverage_report",
    MATCH
    + """, a as (select count(*) as documents, count(*) filter (record_id in (select record_id from mc)) as predicted from docs), b as (select count(distinct code) as labels, count(distinct code) filter (code in (select code from mc)) as labels_predicted from labelset)
select *, round(predicted / documents::double, 4) as document_coverage, round(labels_predicted / labels::double, 4) as label_coverage from a, b""",
)
def coverage_report(s, d):
    return D.coverage(V.gold(s, d), coded(s, d), table(s, d, "labelset"))


@C.add("description_lookup", "select l.code, coalesce(min(c.greek_description), l.code) as description from labelset l left join code_lookup c on c.code = l.code and c.greek_description <> '' group by l.code")
def description_lookup(s, d):
    c = table(s, d, "code_lookup").where("greek_description <> ''").groupBy("code").agg(F.min("greek_description").alias("x"))
    return table(s, d, "labelset").select("code").distinct().join(c, "code", "left").select("code", F.coalesce("x", "code").alias("description"))


@C.add("fuzzy_fallback")
def fuzzy_fallback(s, d):
    """Descriptions of the codes without any term, over whole texts."""
    c = table(s, d, "code_lookup").select("code", F.col("greek_description").alias("description"))
    # half the terms only, lest no code be without one
    terms = dictionary(s, d).where("substring(md5(term), 1, 1) < '8'")
    return D.fuzzy_fallback(V.records(s, d), c, covered=terms.select(F.explode("codes").alias("code")))


CHAIN = D.Chain(boosts=tuple(BOOSTS), rules=tuple(RULES), section=(FAMILY, STOPS, "FAM"), negations=tuple(PAIRS))
_A = "".join(f" union select record_id, c from nt cross join (values {', '.join('(' + repr(c) + ')' for c in add)}) v(c) where " + " or ".join(f"contains(norm, '{p}')" for p in pats) for pats, add in BOOSTS)
_AR, _AL = _rules_sql(RULES)
_words = lambda c: f"' ' || trim(regexp_replace({c}, ' +', ' ', 'g')) || ' '"


@C.add(
    "dictionary_predict",
    MATCH
    + ", a0 as (select record_id, code from mc"
    + _A
    + ")"
    + _AR.replace(" from mc ", " from a0 ").replace("from mc where", "from a0 where").replace("from mc union", "from a0 union")
    + f""", s1 as (select record_id, norm, strpos(norm, '{FAMILY[0]}') as h from nt where norm <> ''), s2 as (select *, case when h = 0 then '' else norm[h:] end as tail from s1),
s3 as (select *, least({', '.join(f"case when strpos(tail, '{x}') = 0 then 1000000000 else strpos(tail, '{x}') - 1 end" for x in STOPS)}) as e from s2),
s4 as (select record_id, tail[:e] as seg, norm[:h - 1] || tail[e + 1:] as rest from s3 where h > 0),
ins as (select distinct record_id, code from s4 join di on contains({_words('seg')}, ' ' || term || ' ')), outs as (select distinct record_id, code from s4 join di on contains({_words('rest')}, ' ' || term || ' ')),
a5 as (select * from {_AL} except (select * from ins except select * from outs)), a6 as (select * from a5 union select record_id, 'FAM' from s4),
tk as (select record_id, string_split(norm, ' ') as tokens from nt),
a7 as (select a6.record_id, a6.code from a6 join tk using (record_id) where not ("""
    + ") and not (".join(f"code in ({', '.join(repr(c) for c in codes)}) and {_near(n, dis)}" for n, dis, codes in PAIRS)
    + ")) select record_id, string_agg(code, '|' order by code) as codes from a7 group by all",
)
def dictionary_predict(s, d):
    return D.predict_chain(V.records(s, d), dictionary(s, d), CHAIN).select("record_id", F.array_join("codes", "|").alias("codes"))


@C.add(
    "dictionary_candidates",
    DICT
    + f", ca as (select term, code from di union select {V.norm_sql('greek_description')}, code from code_lookup where greek_description is not null) select term, string_agg(code, '|' order by code) as codes from (select distinct term, code from ca where term <> '' and term <> 'πυρετοσ' and code in (select code from labelset)) group by term",
)
def dictionary_candidates(s, d):
    c = table(s, d, "code_lookup").select("code", F.col("greek_description").alias("description"))
    return D.candidates(dictionary(s, d), c, table(s, d, "labelset"), ["πυρετοσ"]).select("term", F.array_join("codes", "|").alias("codes"))


@C.add(
    "coverage_codes",
    MATCH + ", n as (select code, count(*) as documents from mc group by code) select 'predicted' as kind, code, documents from (select * from n order by documents desc, code limit 20) union all select 'missing', code, 0 from (select distinct code from labelset) where code not in (select code from n)",
)
def coverage_codes(s, d):
    return D.coverage_codes(coded(s, d), table(s, d, "labelset"))
