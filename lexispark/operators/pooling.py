"""Pooling of chunk scores to documents, averaging over runs, hierarchy and class weights.

Chunks: (record_id, chunk_ix, code, logit double). Null logits take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import checked_broadcast


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def pool(chunks: DataFrame, how: str, temperature: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """record_id, code, score: logits pooled by max, mean, lme (stable log-mean-exp) or mean_max (alpha mean + (1 - alpha) max), then the sigmoid."""
    c = chunks.where("logit is not null")
    if how == "lme":
        # the greatest logit is subtracted first; one aggregation keeps both, so no second shuffle is needed
        g = c.groupBy("record_id", "code").agg(F.collect_list("logit").alias("x"), F.max("logit").alias("m"))
        total = F.aggregate(F.transform("x", lambda v: F.exp((v - F.col("m")) / temperature)), F.lit(0.0), lambda a, b: a + b)
        z = F.col("m") + temperature * F.log(total / F.size("x"))
        return g.select("record_id", "code", sigmoid(z).alias("score"))
    agg = {"max": F.max("logit"), "mean": F.avg("logit"), "mean_max": alpha * F.avg("logit") + (1 - alpha) * F.max("logit")}[how]
    return c.groupBy("record_id", "code").agg(agg.alias("z")).select("record_id", "code", sigmoid(F.col("z")).alias("score"))


def average_runs(scores: DataFrame) -> DataFrame:
    """record_id, code, score averaged over runs."""
    return scores.groupBy("record_id", "code").agg(F.avg("score").alias("score"), F.count("*").alias("runs"))


def raise_parents(scores: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """record_id, code, score with each parent at least as probable as its children. hierarchy: child, parent."""
    up = scores.join(checked_broadcast(hierarchy), F.col("code") == F.col("child")).select("record_id", F.col("parent").alias("code"), "score")
    return scores.select("record_id", "code", "score").unionByName(up).groupBy("record_id", "code").agg(F.max("score").alias("score"))


def class_weights(gold: DataFrame, labels: DataFrame, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """code, pos, weight = (N - pos) / max(pos, 1) between two bounds."""
    n = gold.agg(F.count("*").alias("n"))
    pos = gold.select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).groupBy("code").agg(F.count("*").alias("pos"))
    w = (F.col("n") - F.col("pos")) / F.greatest("pos", F.lit(1))
    return labels.select("code").distinct().join(pos, "code", "left").na.fill(0, ["pos"]).join(F.broadcast(n)).select("code", "pos", F.least(F.greatest(w, F.lit(low)), F.lit(high)).alias("weight"))


def label_class_weights(gold: DataFrame, labels: DataFrame, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """code, pos, weight: as class_weights, but a label without positives weighs N before the bounds."""
    n = gold.agg(F.count("*").alias("n"))
    w = class_weights(gold, labels, float("-inf"), float("inf")).join(F.broadcast(n))
    return w.select("code", "pos", F.least(F.greatest(F.when(F.col("pos") == 0, F.col("n")).otherwise(F.col("weight")), F.lit(low)), F.lit(high)).alias("weight"))


def average_thresholds(folds: DataFrame) -> DataFrame:
    """code, threshold averaged over folds (fold, code, threshold)."""
    return folds.groupBy("code").agg(F.avg("threshold").alias("threshold"), F.count("*").alias("folds"))


def rank_loss(cells: DataFrame) -> DataFrame:
    """record_id, loss of logits (record_id, logit, y): log(1 + sum of exp(-logit) over positives) + log(1 + sum of exp(logit) over negatives)."""
    up = F.coalesce(F.sum(F.when(F.col("y") == 1, F.exp(-F.col("logit")))), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(F.col("y") == 0, F.exp(F.col("logit")))), F.lit(0.0))
    return cells.groupBy("record_id").agg((F.log1p(up) + F.log1p(down)).alias("loss"))


def cosine_schedule(step: Column, warmup: int, total: int) -> Column:
    """Factor of the learning rate: rising in proportion up to `warmup` steps, then half a cosine down to 0."""
    share = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share))))


def losses(cells: DataFrame, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05) -> DataFrame:
    """One row: mean binary cross entropy and asymmetric loss of cells (score, y)."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    q = F.greatest(p - clip, F.lit(1e-7))
    bce = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    asl = -(F.col("y") * F.pow(1 - p, F.lit(gamma_pos)) * F.log(p) + (1 - F.col("y")) * F.pow(q, F.lit(gamma_neg)) * F.log(1 - q))
    return cells.agg(F.avg(bce).alias("bce"), F.avg(asl).alias("asl"))
