"""Queries: mention spans, BIO labels, linking."""

from pyspark.sql import functions as F

from ..operators import spans as P
from . import q_dictionary as QD
from . import views as V
from .catalogue import Catalogue

C = Catalogue()
VALID = V.REC + ", " + V.MEN + """, ok as (select mention_id, m.record_id, span_start, span_end, code, coalesce(mention, substring(text, span_start + 1, span_end - span_start)) as mention, confidence, m.source from men m join rec using (record_id) where span_start >= 0 and span_end > span_start and span_end <= length(text)),
gs as (select distinct record_id, span_start, span_end from ok where source = 'gold'), es as (select distinct record_id, span_start, span_end from ok where source <> 'gold')"""


def valid(s, d):
    return P.parse(V.mentions(s, d), V.records(s, d))


def _gold(s, d):
    return valid(s, d).where("source = 'gold'")


def _extra(s, d):
    return valid(s, d).where("source <> 'gold'")


@C.add("mention_parse", VALID + "select mention_id, record_id, span_start, span_end, code, mention from ok")
def mention_parse(s, d):
    return valid(s, d).select("mention_id", "record_id", "span_start", "span_end", "code", "mention")


@C.add(
    "span_f1",
    VALID
    + """, x as (select count(*) filter (g.record_id is not null and e.record_id is not null) as tp, count(*) filter (g.record_id is null) as fp, count(*) filter (e.record_id is null) as fn from gs g full join es e on g.record_id = e.record_id and g.span_start = e.span_start and g.span_end = e.span_end)
select tp, fp, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp)::double end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn)::double end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn)::double end, 6) as f1 from x""",
)
def span_f1(s, d):
    x = P.span_scores(_extra(s, d), _gold(s, d))
    return x.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@C.add("span_uncontained", VALID + "select record_id, span_start, span_end from es e where not exists (select 1 from gs g where g.record_id = e.record_id and g.span_start <= e.span_start and g.span_end >= e.span_end)")
def span_uncontained(s, d):
    return P.uncontained(_extra(s, d), _gold(s, d))


@C.add("gold_with_dictionary", VALID + "select record_id, span_start, span_end, code, confidence from ok where source = 'gold' union all select record_id, span_start, span_end, 'DICT', 0.7::double from (select * from es except select * from gs)")
def gold_with_dictionary(s, d):
    return P.with_dictionary(_gold(s, d), _extra(s, d))


@C.add(
    "span_containment_merge",
    VALID
    + """, ax as (select * from es e where not exists (select 1 from gs g where g.record_id = e.record_id and g.span_start <= e.span_start and g.span_end >= e.span_end) and not exists (select 1 from es f where f.record_id = e.record_id and f.span_start <= e.span_start and f.span_end >= e.span_end and (f.span_start <> e.span_start or f.span_end <> e.span_end)))
select * from ax union all select * from gs g where not exists (select 1 from ax where ax.record_id = g.record_id and ax.span_start <= g.span_start and ax.span_end >= g.span_end)""",
)
def span_containment_merge(s, d):
    return P.merged(_gold(s, d), _extra(s, d))


@C.add("mention_extract")
def mention_extract(s, d):
    return P.extract(V.records(s, d), QD.dictionary(s, d))


BIO = VALID + """, ch as (select record_id, text, unnest(range(1, length(text) + 1)) as i from rec where text <> ''), cc as (select record_id, i, substring(text, i, 1) as c from ch),
bd as (select record_id, i, c in (' ', chr(9), chr(10), chr(13)) as sp from cc), st as (select record_id, i, sp, sum(sp::int) over (partition by record_id order by i) as run from bd),
tk as (select record_id, min(i) - 1 as s, max(i) as e from st where not sp group by record_id, run), t as (select *, row_number() over (partition by record_id order by s) - 1 as token_ix from tk),
lb as (select t.record_id, token_ix, t.s, min((g.span_start::bigint * 10000000 + (10000000 - g.span_end))) as span from t left join gs g on g.record_id = t.record_id and g.span_start <= t.s and g.span_end >= t.e group by all),
bio as (select record_id, token_ix, case when span is null then 'O' when lag(span) over (partition by record_id order by token_ix) is distinct from span then 'B' else 'I' end as label from lb)"""


@C.add("bio_labels", BIO + "select record_id, token_ix, label from bio")
def bio_labels(s, d):
    b = P.bio(V.records(s, d), _gold(s, d))
    return b.select("record_id", F.col("token_ix").cast("bigint").alias("token_ix"), "label")


@C.add(
    "bio_decode",
    BIO
    + """, o as (select *, case when label = 'B' or (label = 'I' and coalesce(lag(label) over (partition by record_id order by token_ix), 'O') = 'O') then 1 else 0 end as op from bio), r as (select *, sum(op) over (partition by record_id order by token_ix) as run from o)
select record_id, min(token_ix) as first_token, max(token_ix) as last_token from r where label <> 'O' group by record_id, run""",
)
def bio_decode(s, d):
    b = P.bio(V.records(s, d), _gold(s, d)).withColumn("p", F.lit(1.0))
    return P.decode(b).select("record_id", F.col("first_token").cast("bigint").alias("first_token"), F.col("last_token").cast("bigint").alias("last_token"))


@C.add("token_f1", BIO + f", lb2 as (select t.record_id, token_ix, count(g.record_id) > 0 as p from t left join es g on g.record_id = t.record_id and g.span_start <= t.s and g.span_end >= t.e group by all), x as (select count(*) filter (label <> 'O' and p) as tp, count(*) filter (label = 'O' and p) as fp, count(*) filter (label <> 'O' and not p) as fn from bio join lb2 using (record_id, token_ix)) select tp, fp, fn, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn)::double end, 6) as f1 from x")
def token_f1(s, d):
    x = P.token_scores(P.bio(V.records(s, d), _extra(s, d)), P.bio(V.records(s, d), _gold(s, d)))
    return x.withColumn("f1", F.round("f1", 6))


PRIOR = VALID + f", pk as (select {V.norm_sql('mention')} as key, code from ok where source = 'gold' and code is not null), pr as (select key, code, count(*) as n from pk where key <> '' group by key, code)"


@C.add("linker_prior", PRIOR + "select key, code, n from pr")
def linker_prior(s, d):
    return P.prior(_gold(s, d))


@C.add(
    "link_mentions",
    PRIOR
    + ", "
    + QD.DICT
    + f""", ca0 as (select key, code, n as c, n / sum(n) over (partition by key)::double as prior from pr union all select term, code, 0, 0 from di where not exists (select 1 from pr where pr.key = di.term and pr.code = di.code)),
ca as (select key, code, c, case when max(c) over (partition by key) = 0 then 1 / count(*) over (partition by key)::double else prior end as prior from ca0), m as (select mention_id, {V.norm_sql('mention')} as key from ok where source <> 'gold')
select mention_id, code, round(round(0.5 * prior - 0.5, 9), 6) as score from m join ca using (key) where key <> '' qualify row_number() over (partition by mention_id order by round(0.5 * prior - 0.5, 9) desc, c desc, code) = 1""",
)
def link_mentions(s, d):
    x = P.link(_extra(s, d), P.prior(_gold(s, d)), QD.dictionary(s, d))
    return x.select("mention_id", "code", F.round("score", 6).alias("score"))


@C.add("mention_codes", VALID + ", f as (select record_id, code, min(span_start::bigint * 1000000000000 + mention_id) as k from ok where source = 'gold' and code is not null group by all) select record_id, string_agg(code, '|' order by k) as codes from f group by all")
def mention_codes(s, d):
    return P.record_codes(_gold(s, d).where("code is not null")).select("record_id", F.array_join("codes", "|").alias("codes"))


# each token's own label scores most and the labels allow each other: the best path is the labels
@C.add("viterbi_decode", BIO + "select record_id, token_ix::int as token_ix, label from bio")
def viterbi_decode(s, d):
    b = P.bio(V.records(s, d), _gold(s, d))
    e = b.select("record_id", "token_ix", *[F.when(F.col("label") == t, 1.0).otherwise((F.col("token_ix") % 5) / 10.0).alias(t.lower()) for t in P.TAGS])
    return P.decode_crf(e)
