"""Which labels go together: conditional rules, Jaccard, confusion. gold: (record_id, groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.staging import checked_broadcast, lookup, stage


def _codes(gold: DataFrame) -> DataFrame:
    return gold.select("record_id", F.array_sort(F.array_distinct(F.flatten("groups"))).alias("codes"))


def _pairs(codes: DataFrame) -> DataFrame:
    """a < b inside a record, made in the row itself: no self-join."""
    return codes.select("codes", F.posexplode("codes").alias("i", "a")).select("a", F.explode(F.slice("codes", F.col("i") + 2, F.size("codes"))).alias("b"))


def _group_support(gold: DataFrame) -> DataFrame:
    return gold.select(F.explode("groups").alias("g")).select(F.explode(F.array_distinct("g")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def rules(gold: DataFrame, least: int = 40, share: float = 0.45) -> DataFrame:
    """code_a, code_b, n_both, probability of b given a: documents with both over group occurrences of a."""
    p = _pairs(_codes(gold)).groupBy("a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    both = p.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "both").unionByName(p.select(F.col("b").alias("code_a"), F.col("a").alias("code_b"), "both"))
    j = both.join(lookup(_group_support(gold).withColumnRenamed("code", "code_a"), "support"), "code_a").where(F.col("both") >= share * F.col("n"))
    return j.select("code_a", "code_b", F.col("both").alias("n_both"), F.round(F.col("both") / F.col("n"), 3).alias("probability"))


def jaccard(gold: DataFrame, most: int = 20) -> DataFrame:
    """code_a < code_b of the labels of greatest group support: documents with both, Jaccard."""
    top = _group_support(gold).orderBy(F.desc("n"), "code").limit(most).agg(F.collect_list("code").alias("top"))
    c = _codes(gold).join(F.broadcast(top)).select(F.array_intersect("codes", "top").alias("codes"))
    size = c.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    p = _pairs(c).groupBy("a", "b").agg(F.count("*").alias("both"))
    size = stage(size, "sizes")
    j = p.join(checked_broadcast(size.select(F.col("code").alias("a"), F.col("n").alias("x"))), "a").join(checked_broadcast(size.select(F.col("code").alias("b"), F.col("n").alias("y"))), "b")
    return j.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "both", L.ratio(F.col("both"), F.col("x") + F.col("y") - F.col("both")).alias("jaccard"))


def confusion(gold: DataFrame, preds: DataFrame, most: int = 5) -> DataFrame:
    """system_name, predicted, gold, n: co-counts of predicted and gold labels among the most frequent ones."""
    top = _group_support(gold).orderBy(F.desc("n"), "code").limit(most).agg(F.collect_list("code").alias("top"))
    g = _codes(gold).join(F.broadcast(top)).select("record_id", "top", F.array_intersect("codes", "top").alias("g"))
    j = preds.join(g, "record_id").select("system_name", F.explode(F.array_intersect(F.array_distinct("codes"), "top")).alias("predicted"), "g")
    return j.select("system_name", "predicted", F.explode("g").alias("gold")).groupBy("system_name", "predicted", "gold").agg(F.count("*").alias("n"))
