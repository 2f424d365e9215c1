"""Group-level scoring: counts per document and system, micro and macro F1, per-class and per-band reports, paired tests.

Inputs: gold (record_id, groups array<array<string>>) and predictions (system_name, record_id, codes array<string>); other columns are ignored
unless named. Gold drives: a record without prediction has all its groups missed, predictions for unknown records are reported, not
counted. An empty group is always missed, repeated groups count each. Empty inputs give empty or zero results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def hit_groups(groups: Column | str, codes: Column | str) -> Column:
    return F.size(F.filter(groups, lambda g: F.arrays_overlap(g, F.col(codes) if isinstance(codes, str) else codes)))


def wrong_codes(groups: Column | str, codes: Column | str) -> Column:
    return F.array_except(codes, F.flatten(groups))


def score_documents(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """system_name, record_id, tp, fp, fn of each prediction for a gold record."""
    j = preds.join(gold.select("record_id", "groups"), "record_id")
    tp = hit_groups("groups", "codes").cast("bigint")
    return j.select("system_name", "record_id", tp.alias("tp"), F.size(wrong_codes("groups", "codes")).cast("bigint").alias("fp"), (F.size("groups") - tp).alias("fn"))


def micro(gold: DataFrame, preds: DataFrame, *by: str) -> DataFrame:
    """system_name, tp, fp, fn, precision, recall, f1 over all gold records; `by` names gold columns that split the report."""
    total = gold.groupBy(*by).agg(F.coalesce(F.sum(F.size("groups")), F.lit(0)).cast("bigint").alias("n"))
    s = score_documents(gold, preds)
    if by:
        s = s.join(gold.select("record_id", *by), "record_id")
    s = s.groupBy("system_name", *by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    j = s.join(total, list(by)) if by else s.join(F.broadcast(total))
    fn = F.col("n") - F.col("tp")
    return j.select("system_name", *by, "tp", "fp", fn.alias("fn"), L.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), L.ratio(F.col("tp"), F.col("n")).alias("recall"), L.f1(F.col("tp"), F.col("fp"), fn).alias("f1"))


def per_class(gold: DataFrame, preds: DataFrame, labels: DataFrame) -> DataFrame:
    """system_name, code, support, hits, fp, precision, recall, f1 for every label of the space (code).

    A hit group credits all its codes. A label that a system never touches has zeros.
    """
    member = gold.select("record_id", F.posexplode("groups").alias("ix", "g")).select("record_id", "ix", F.explode(F.array_distinct("g")).alias("code"))
    support = member.groupBy("code").agg(F.count("*").alias("support"))
    j = preds.join(gold.select("record_id", "groups"), "record_id")
    hits = j.select("system_name", F.explode(F.filter("groups", lambda g: F.arrays_overlap(g, F.col("codes")))).alias("g")).select("system_name", F.explode(F.array_distinct("g")).alias("code")).groupBy("system_name", "code").agg(F.count("*").alias("hits"))
    fp = j.select("system_name", F.explode(wrong_codes("groups", "codes")).alias("code")).groupBy("system_name", "code").agg(F.count("*").alias("fp"))
    systems = [r[0] for r in preds.select("system_name").distinct().limit(1001).collect()]
    if len(systems) > 1000:
        raise ValueError("more than 1000 systems")
    grid = labels.select("code").distinct().withColumn("system_name", F.explode(F.array(*map(F.lit, systems)) if systems else F.array().cast("array<string>")))
    zero = {"support": 0, "hits": 0, "fp": 0}
    r = grid.join(support, "code", "left").join(hits, ["system_name", "code"], "left").join(fp, ["system_name", "code"], "left").na.fill(zero)
    p, q = L.ratio(F.col("hits"), F.col("hits") + F.col("fp")), L.ratio(F.col("hits"), F.col("support"))
    return r.select("system_name", "code", "support", "hits", "fp", p.alias("precision"), q.alias("recall"), L.ratio(2 * p * q, p + q).alias("f1"))


def macro(report: DataFrame) -> DataFrame:
    """system_name, macro F1 over labels with support and over all labels."""
    return report.groupBy("system_name").agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_present"), F.avg("f1").alias("macro_all"))


def breakdown(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """system_name, record_id, missed groups and wrong codes, both joined as text."""
    j = preds.join(gold.select("record_id", "groups"), "record_id")
    missed = F.filter("groups", lambda g: ~F.coalesce(F.arrays_overlap(g, F.col("codes")), F.lit(False)))
    return j.select("system_name", "record_id", F.array_join(F.array_sort(F.transform(missed, lambda g: F.array_join(F.array_sort(F.array_distinct(g)), "+"))), "|").alias("missed"), F.array_join(F.array_sort(wrong_codes("groups", "codes")), "|").alias("wrong"))


def missing_and_extra(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """system_name, records without prediction, predictions without record."""
    n = gold.agg(F.count("*").alias("n"))
    known = gold.select("record_id").withColumn("known", F.lit(1))
    s = preds.join(known, "record_id", "left").groupBy("system_name").agg(F.count("known").alias("k"), F.count("*").alias("m"))
    return s.join(F.broadcast(n)).select("system_name", (F.col("n") - F.col("k")).alias("missing"), (F.col("m") - F.col("k")).alias("extra"))


def error_counts(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """system_name, kind (fp, fn), code, n over flat gold codes."""
    j = preds.join(gold.select("record_id", F.array_distinct(F.flatten("groups")).alias("flat")), "record_id")
    rows = j.select("system_name", F.explode(F.array(F.struct(F.lit("fp").alias("kind"), F.array_except("codes", "flat").alias("c")), F.struct(F.lit("fn").alias("kind"), F.array_except("flat", "codes").alias("c")))).alias("e"))
    return rows.select("system_name", "e.kind", F.explode("e.c").alias("code")).groupBy("system_name", "kind", "code").agg(F.count("*").alias("n"))


def band_f1(report: DataFrame) -> DataFrame:
    """system_name, band of the labels' support, labels, micro F1 inside the band."""
    b = report.withColumn("band", L.band(F.col("support"))).groupBy("system_name", "band").agg(F.count("*").alias("labels"), F.sum("support").alias("support"), F.sum("hits").alias("hits"), F.sum("fp").alias("fp"))
    return b.select("system_name", "band", "labels", "support", "hits", "fp", L.f1(F.col("hits"), F.col("fp"), F.col("support") - F.col("hits")).alias("f1"))


def label_gain(report: DataFrame, system: str, base: str) -> DataFrame:
    """code, gain in F1 of a system over another for labels with support, and its direction."""
    a = report.where((F.col("system_name") == system) & (F.col("support") > 0)).select("code", F.col("f1").alias("a"))
    b = report.where(F.col("system_name") == base).select("code", F.col("f1").alias("b"))
    g = F.col("a") - F.col("b")
    return a.join(b, "code").select("code", g.alias("gain"), F.when(g > 0, "improved").when(g < 0, "degraded").otherwise("same").alias("direction"))


def exact_match_sets(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Systems that are wholly right on a record, joined, and how many records have that combination ('' for none)."""
    ok = score_documents(gold, preds).where("fp = 0 and fn = 0").groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("system_name")), "+").alias("systems"))
    return gold.select("record_id").join(ok, "record_id", "left").groupBy(F.coalesce("systems", F.lit("")).alias("systems")).agg(F.count("*").alias("records"))


def compare_table(gold: DataFrame, preds: DataFrame, digits: int = 4) -> DataFrame:
    """Systems by falling F1 and name; of systems with the same rounded figures the one of shortest name stays."""
    from pyspark.sql import Window as W

    m = micro(gold, preds).select("system_name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")])
    same = W.partitionBy("precision", "recall", "f1").orderBy(F.length("system_name"), "system_name")
    m = m.withColumn("k", F.row_number().over(same)).where("k = 1").drop("k")
    return m.withColumn("rank", F.row_number().over(W.orderBy(F.desc("f1"), "system_name")).cast("bigint"))


def mcnemar(gold: DataFrame, preds: DataFrame, a: str, b: str) -> DataFrame:
    """Groups that only a, only b, both or neither hit, over all gold groups: one row."""
    cell = lambda s: preds.where(F.col("system_name") == s).select("record_id", F.col("codes"))
    j = gold.join(cell(a).withColumnRenamed("codes", "ca"), "record_id", "left").join(cell(b).withColumnRenamed("codes", "cb"), "record_id", "left").select(F.explode("groups").alias("g"), "ca", "cb")
    hit = lambda c: F.coalesce(F.arrays_overlap("g", c), F.lit(False))
    x = j.select(hit("ca").alias("a"), hit("cb").alias("b"))
    return x.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided p: exact binomial below 25 discordant pairs, else chi-square with continuity correction; nan without any."""
    n = b + c
    if n == 0:
        return math.nan
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def bootstrap(gold: DataFrame, preds: DataFrame, a: str, b: str, resamples: int = 200) -> DataFrame:
    """Paired bootstrap of the micro F1 difference: mean, 2.5 and 97.5 percentiles, two-sided p: one row.

    Each record's weight in resample r is Poisson(1), drawn from a hash of (r, record_id), so that resamples need neither a join nor a
    second scan: counts are added up before the shuffle, one row for each resample leaves a task.
    """
    tot = gold.select("record_id", F.size("groups").alias("n"))
    one = lambda s, x: score_documents(gold, preds.where(F.col("system_name") == s)).select("record_id", F.col("tp").alias(f"tp_{x}"), F.col("fp").alias(f"fp_{x}"))
    j = tot.join(one(a, "a"), "record_id", "left").join(one(b, "b"), "record_id", "left").na.fill(0)
    w = poisson_weight(F.col("r"), F.col("record_id"))
    x = j.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", w).where("w > 0")
    s = x.groupBy("r").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "tp_a", "fp_a", "tp_b", "fp_b")])
    f = lambda k: L.ratio(2 * F.col(f"tp_{k}"), F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col("n"))
    d = s.select((f("a") - f("b")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), (2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"))


#: Cumulative Poisson(1) probabilities in millionths.
POISSON = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)


def poisson_weight(r: Column, key: Column) -> Column:
    """Weight of a record in a resample, in whole numbers that any engine can repeat."""
    u = F.pmod((key % 1000003) * 7919 + (r.cast("bigint") * 104729) % 1000003 * ((key % 8191) + 13), F.lit(1000003))
    w = F.lit(0)
    for k, c in enumerate(POISSON):
        w = F.when(u >= c, k + 1).otherwise(w)
    return w
