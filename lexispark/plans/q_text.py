"""Queries: text scalars, labels, token and length statistics, validation."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import spans
from . import views as V
from .catalogue import Catalogue
from .session import table

C = Catalogue()
TEXTS = V.REC + ", t as (select record_id, split, text from rec)"
NORM = TEXTS + f", nt as (select record_id, split, {V.norm_sql('text')} as norm from t where text is not null), tk as (select record_id, split, case when norm = '' then [] else string_split(norm, ' ') end as tokens from nt)"


def _tokens(s, d):
    return V.records(s, d).where("text is not null").select("record_id", "split", T.tokenize(T.normalize_text(F.col("text"), fold_sigma=True)).alias("tokens"))


@C.add(
    "clean_text",
    TEXTS
    + f", o as (select record_id, regexp_replace(text, '{T.SPACE}+', ' ', 'g') as o from t) select record_id, trim(regexp_replace(o, '[^a-zA-Z0-9\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}} \\-.,%/()\\[\\]:]', '', 'g'), ' ') as text from o",
)
def clean_text(s, d):
    return V.records(s, d).select("record_id", T.clean_text(F.col("text")).alias("text"))


@C.add("normalize_text", NORM + "select record_id, norm from nt")
def normalize_text(s, d):
    return V.records(s, d).where("text is not null").select("record_id", T.normalize_text(F.col("text"), fold_sigma=True).alias("norm"))


@C.add(
    "tokenize_stats",
    NORM
    + """, l as (select split, len(tokens) as n from tk) select split, count(*) as records, round(avg(n), 6) as avg_tokens, max(n) as max_tokens, min(n) as min_tokens, count(*) filter (n > 200) as over_200, round(100 * count(*) filter (n > 200) / count(*)::double, 2) as pct_over from l group by all""",
)
def tokenize_stats(s, d):
    n = F.size("tokens").cast("bigint")
    over = F.count_if(n > 200)
    return _tokens(s, d).groupBy("split").agg(F.count("*").alias("records"), F.round(F.avg(n), 6).alias("avg_tokens"), F.max(n).alias("max_tokens"), F.min(n).alias("min_tokens"), over.alias("over_200"), F.round(100 * over / F.count("*"), 2).alias("pct_over"))


@C.add("length_histogram", TEXTS + "select split, coalesce(length(text), 0) // 250 as bucket, count(*) as records from t group by all")
def length_histogram(s, d):
    return V.records(s, d).groupBy("split", F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 250).alias("bucket")).agg(F.count("*").alias("records"))


@C.add(
    "abbreviation_extract",
    TEXTS
    + ", w as (select record_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) as w from t where text is not null) select w as abbreviation, count(*) as n, count(distinct record_id) as records from w where regexp_full_match(w, '[A-ZΑ-Ω]{2,6}') group by all",
)
def abbreviation_extract(s, d):
    w = V.records(s, d).select("record_id", F.explode(F.split("text", "[^\\p{L}\\p{N}_]+")).alias("abbreviation")).where(F.col("abbreviation").rlike("^[A-ZΑ-Ω]{2,6}$"))
    return w.groupBy("abbreviation").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


@C.add(
    "context_window",
    V.MEN.replace("men as", "men as", 1)
    + ", "
    + V.REC
    + """select mention_id, substring(text, greatest(0, span_start - 40) + 1, least(length(text), span_end + 40) - greatest(0, span_start - 40)) as context from men join rec using (record_id) where span_start >= 0 and span_end > span_start and span_end <= length(text)""",
)
def context_window(s, d):
    m = spans.parse(V.mentions(s, d), V.records(s, d)).select("mention_id", "record_id", "span_start", "span_end")
    return m.join(V.records(s, d).select("record_id", "text"), "record_id").select("mention_id", T.context_window(F.col("text"), F.col("span_start"), F.col("span_end"), 40).alias("context"))


@C.add(
    "chunk_windows",
    NORM
    + """, n as (select record_id, tokens, greatest(0, ceil((len(tokens) - 64) / 48.0))::int as last from tk),
c as (select record_id, tokens, unnest(range(0, last + 1)) as chunk_ix from n)
select record_id, chunk_ix::bigint as chunk_ix, len(tokens[chunk_ix * 48 + 1 : chunk_ix * 48 + 64]) as n_tokens, array_to_string(tokens[chunk_ix * 48 + 1 : chunk_ix * 48 + 64], ' ') as chunk from c""",
)
def chunk_windows(s, d):
    c = _tokens(s, d).select("record_id", "tokens", F.posexplode(T.chunk_starts(F.size("tokens"), 64, 48)).alias("chunk_ix", "at"))
    part = F.slice("tokens", F.col("at") + 1, F.lit(64))
    return c.select("record_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), F.size(part).cast("bigint").alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


@C.add("flatten_labels", V.GROUPS + ", x as (select distinct record_id, code from gl where trim(code) <> '') select d.record_id, coalesce(string_agg(code, '|' order by code), '') as codes from docs d left join x using (record_id) group by all")
def flatten_labels(s, d):
    return V.gold(s, d).select("record_id", F.array_join(L.flatten_labels("groups"), "|").alias("codes"))


@C.add("multi_hot", V.GROUPS + ", x as (select distinct record_id, code from gl) select d.record_id, string_agg((x.code is not null)::int::varchar, '' order by label_ix) as bits from docs d cross join labelset l left join x on x.record_id = d.record_id and x.code = l.code group by all")
def multi_hot(s, d):
    return V.gold(s, d).select("record_id", F.array_join(L.multi_hot(F.flatten("groups"), V.labels(s, d)), "").alias("bits"))


@C.add("resolve_id", "with r as (select * from records qualify row_number() over (partition by record_id order by received_at) = 1) select record_id, coalesce(nullif(patient_id, 0), nullif(record_id, 0)) as resolved from r")
def resolve_id(s, d):
    return V.records(s, d).select("record_id", F.coalesce(F.nullif("patient_id", F.lit(0)), F.nullif("record_id", F.lit(0))).alias("resolved"))


@C.add(
    "eda_report",
    V.GROUPS
    + """, x as (select d.record_id, d.split, count(distinct code) as n from docs d left join gl using (record_id) group by all), u as (select split, count(distinct code) as codes, count(distinct code) filter (code not in (select code from labelset)) as unknown from gl group by all)
select x.split, count(*) as records, min(n) as min_labels, max(n) as max_labels, round(avg(n), 6) as avg_labels, any_value(codes) as codes, any_value(unknown) as unknown from x join u using (split) group by all""",
)
def eda_report(s, d):
    x = V.gold(s, d).select("split", F.array_distinct(F.flatten("groups")).alias("codes"))
    n = F.size("codes").cast("bigint")
    a = x.groupBy("split").agg(F.count("*").alias("records"), F.min(n).alias("min_labels"), F.max(n).alias("max_labels"), F.round(F.avg(n), 6).alias("avg_labels"))
    c = x.select("split", F.explode("codes").alias("code")).distinct().join(table(s, d, "labelset").select("code", F.lit(1).alias("known")), "code", "left").groupBy("split").agg(F.count("*").alias("codes"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return a.join(c, "split")


@C.add(
    "schema_validation",
    V.REC
    + ", "
    + V.MEN
    + "select count(distinct r.record_id) as documents, count(mention_id) as mentions, count(distinct code) as codes, count(*) filter (span_start < 0 or span_end <= span_start or span_end > coalesce(length(text), 0)) as invalid from rec r left join men m using (record_id)",
)
def schema_validation(s, d):
    return spans.validation(V.mentions(s, d), V.records(s, d))


@C.add("prediction_sink_form", V.PREDS + ", x as (select p.system_name, p.record_id, coalesce(string_agg('[' || code || ']', '' order by code), '') as form from pr p left join pl using (system_name, record_id) group by all) select * from x")
def prediction_sink_form(s, d):
    c = L.singletons(F.col("codes"))
    return V.predictions(s, d).select("system_name", "record_id", F.array_join(F.transform(c, lambda g: F.concat(F.lit("["), g[0], F.lit("]"))), "").alias("form"))
