"""Shared inputs of the catalogue: each view as a DataFrame and, independently, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from .session import table


def records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once: record_id, patient_id, split, source, text, groups, labels_flat."""
    r = table(spark, d, "records").where("record_id is not null").dropDuplicates(["record_id"])
    return r.select("record_id", "patient_id", "split", "source", "text", L.groups("document_level_annotations").alias("groups"), "labels_flat")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """record_id, split, groups of the records with at least one group."""
    r = table(spark, d, "records").where("record_id is not null and size(document_level_annotations) > 0")
    return r.select("record_id", "split", L.groups("document_level_annotations").alias("groups")).dropDuplicates(["record_id"])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """system_name, record_id, codes of each system and record once."""
    p = table(spark, d, "predictions").where("record_id is not null and system_name is not null").dropDuplicates(["system_name", "record_id"])
    return p.select("system_name", "record_id", L.first_seen("document_level_annotations").alias("codes"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Each mention once."""
    return table(spark, d, "mentions").where("mention_id is not null").dropDuplicates(["mention_id"])


#: Labels of a space that one expression spells out.
LABELS = 10_000


def labels(spark: SparkSession, d: str) -> list[str]:
    """The label space in its order; a fixed dimension; more than LABELS codes are an error."""
    rows = table(spark, d, "labelset").select("label_ix", F.trim("code").alias("code")).where("code <> ''").orderBy("label_ix").limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    return [r["code"] for r in rows]


REC = "rec as (select * from records where record_id is not null qualify row_number() over (partition by record_id order by received_at) = 1)"
GROUPS = (
    REC
    + """, grp as (select record_id, split, unnest(document_level_annotations) as codes, generate_subscripts(document_level_annotations, 1) as ix from rec where len(document_level_annotations) > 0),
gl as (select distinct record_id, split, ix, code from (select record_id, split, ix, unnest(codes) as code from grp) where code is not null),
docs as (select record_id, split, count(*) as n_groups from grp group by all)"""
)
PREDS = """pr as (select * from predictions where record_id is not null and system_name is not null qualify row_number() over (partition by system_name, record_id order by predicted_at) = 1),
pl as (select distinct system_name, record_id, code from (select system_name, record_id, unnest(flatten(document_level_annotations)) as code from pr) where code is not null)"""
MEN = "men as (select * from mentions where mention_id is not null qualify row_number() over (partition by mention_id order by annotated_at) = 1)"
NORM = "trim(regexp_replace(replace(replace(strip_accents(lower({0})), 'ς', 'σ'), '΄', ''), '[^a-zA-Zα-ωΑ-Ω0-9]+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return NORM.format(c)

#: Systems in their order; the last two give scores, the others sets.
SYSTEMS = ("sys_dict", "sys_link", "sys_net", "sys_rank")


def flat(preds: DataFrame) -> DataFrame:
    """system_name, record_id, code."""
    return preds.select("system_name", "record_id", F.explode("codes").alias("code"))


def raw_scores(spark: SparkSession, d: str) -> DataFrame:
    """system_name, system_ix, record_id, code, milli, thr, p: a score table over all cells that gold or a system names, made from ids in whole numbers.

    milli and thr: score and threshold in thousandths of the score systems; p: whether the system predicts the cell.
    """
    g = gold(spark, d)
    member = g.select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).withColumn("g", F.lit(1))
    pl = flat(predictions(spark, d)).withColumn("p", F.lit(1))
    lab = table(spark, d, "labelset").select("label_ix", "code")
    cells = member.select("record_id", "code").unionByName(pl.select("record_id", "code").join(g.select("record_id"), "record_id", "left_semi")).distinct().join(lab, "code").join(member, ["record_id", "code"], "left")
    sys = F.array(*[F.struct(F.lit(s).alias("system_name"), F.lit(i).alias("system_ix")) for i, s in enumerate(SYSTEMS)])
    x = cells.withColumn("s", F.explode(sys)).select("record_id", "code", "label_ix", "g", "s.system_name", "s.system_ix").join(pl, ["system_name", "record_id", "code"], "left")
    m, k = F.col("system_ix").cast("bigint"), F.col("label_ix").cast("bigint")
    milli = F.least(F.lit(1000), (F.col("record_id") * 7919 + m * 104729 + k * 1299709) % 700 + 300 * F.coalesce("p", F.lit(0)) + 150 * F.coalesce("g", F.lit(0)))
    return x.select("system_name", "system_ix", "record_id", "code", milli.cast("bigint").alias("milli"), (350 + (m * 37 + k * 53) % 300).alias("thr"), F.coalesce("p", F.lit(0)).alias("p"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """system_name, system_ix, record_id, code, score: normalized scores of score systems, 0/1 of the others."""
    s = F.when(F.col("system_ix") >= 2, F.col("milli") / F.col("thr")).otherwise(F.col("p").cast("double"))
    return raw_scores(spark, d).select("system_name", "system_ix", "record_id", "code", s.alias("score"))


SCORES = (
    GROUPS
    + ", "
    + PREDS
    + """, sy(system_name, system_ix) as (values ('sys_dict', 0), ('sys_link', 1), ('sys_net', 2), ('sys_rank', 3)),
mem as (select distinct record_id, code from gl),
cells as (select record_id, code from mem union select record_id, code from pl where record_id in (select record_id from docs)),
raw as (select sy.system_name, sy.system_ix, c.record_id, c.code, cast(least(1000, (c.record_id * 7919 + sy.system_ix * 104729 + l.label_ix::bigint * 1299709) % 700 + 300 * (p.code is not null)::int + 150 * (m.code is not null)::int) as bigint) as milli,
  350 + (sy.system_ix * 37 + l.label_ix * 53) % 300 as thr, (p.code is not null)::int as p
  from cells c join labelset l using (code) cross join sy left join pl p on p.system_name = sy.system_name and p.record_id = c.record_id and p.code = c.code left join mem m on m.record_id = c.record_id and m.code = c.code),
sc as (select system_name, system_ix, record_id, code, case when system_ix >= 2 then milli / thr::double else p::double end as score from raw)"""
)
