"""Fusion of several systems' label sets and scores.

Predictions: (system_name, record_id, code), one row each. Scores: (system_name, system_ix int, record_id, code, score double) with score models normalized by
their thresholds (1 and more is positive) and binary models 0/1; a cell that is absent is 0. All strategies return (record_id, code).
Everything is a group-by on (record_id, code) with conditional sums, partially aggregated before its one shuffle. Parameters are driver-side dictionaries of a few models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.staging import checked_broadcast, lookup

CELL = ["record_id", "code"]


def union(*preds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*CELL) for p in preds]).distinct()


def intersection(*preds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, CELL, "left_semi"), [p.select(*CELL).distinct() for p in preds])


def k_of_n(preds: list[DataFrame], k: int) -> DataFrame:
    """Codes in at least k of the inputs; k is clamped to 1..n."""
    k = max(1, min(k, len(preds)))
    rows = reduce(DataFrame.unionByName, [p.select(*CELL).distinct() for p in preds])
    return rows.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*CELL)


@dataclass(frozen=True)
class Composition:
    """A named combination of base predictions."""

    slug: str
    op: str
    inputs: tuple[str, ...]
    k: int | None = None

    def __post_init__(self) -> None:
        if self.op not in ("union", "intersection", "k_of_n"):
            raise ValueError(f"{self.slug}: unknown op {self.op}")
        if len(self.inputs) < 2:
            raise ValueError(f"{self.slug}: at least two inputs are needed")
        if (self.op == "k_of_n") != (self.k is not None):
            raise ValueError(f"{self.slug}: k goes with k_of_n and only with it")


def parse_compositions(specs: list[dict]) -> list[Composition]:
    """Compositions from plain dictionaries; an error for missing keys, unknown operations and repeated slugs."""
    out = []
    for s in specs:
        if missing := {"slug", "op", "inputs"} - s.keys():
            raise ValueError(f"missing {sorted(missing)} in {s}")
        out.append(Composition(s["slug"], s["op"], tuple(s["inputs"]), s.get("k")))
    if len({c.slug for c in out}) < len(out):
        raise ValueError("a slug is given twice")
    return out


def compose(spec: Composition, base: dict[str, DataFrame]) -> DataFrame | None:
    """The plan of a composition; None if one of its inputs is missing."""
    if any(i not in base for i in spec.inputs):
        return None
    inputs = [base[i] for i in spec.inputs]
    return union(*inputs) if spec.op == "union" else intersection(*inputs) if spec.op == "intersection" else k_of_n(inputs, spec.k or 1)


def normalized_scores(scores: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Scores divided by the threshold of their system and label, `default` where none is given."""
    t = thresholds.select("system_name", "code", "threshold")
    return scores.join(checked_broadcast(t), ["system_name", "code"], "left").withColumn("score", F.col("score") / F.coalesce("threshold", F.lit(default))).drop("threshold")


def by_system(values: dict[str, float], default: float = 0.0) -> Column:
    """A value for each row's system."""
    c = F.lit(default)
    for s, v in values.items():
        c = F.when(F.col("system_name") == s, F.lit(float(v))).otherwise(c)
    return c


def vote_weight(weights: dict[str, float], cuts: dict[str, float]) -> Column:
    """The weight of a row's system if its score reaches the system's cut."""
    return F.when(F.col("score") >= by_system(cuts, 1.0), by_system(weights)).otherwise(0.0)


def combined(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float]) -> DataFrame:
    """record_id, code, total weight of the votes, number of votes."""
    w = vote_weight(weights, cuts)
    vote = (F.col("score") >= by_system(cuts, 1.0)) & F.col("system_name").isin(list(weights))
    return scores.groupBy(*CELL).agg(F.sum(w).alias("weight"), F.count_if(vote).alias("votes"))


def _at_least(c: Column, g: Column | float) -> Column:
    return F.round(c, 9) >= F.round(F.lit(g) if isinstance(g, float | int) else g, 9)


def weighted(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float], gate: float) -> DataFrame:
    return combined(scores, weights, cuts).where(_at_least(F.col("weight"), gate)).select(*CELL)


def majority(runs: list[DataFrame]) -> DataFrame:
    """Codes in more than half of the runs."""
    return k_of_n(runs, len(runs) // 2 + 1)


def gated_secondary(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float], gate: float, secondary: list[str], open_below: float) -> DataFrame:
    """Secondary systems count only in records whose best weight without them is below a bound."""
    primary = F.col("system_name").isin(secondary)
    w = vote_weight(weights, cuts)
    s = scores.groupBy(*CELL).agg(F.sum(w).alias("full"), F.sum(F.when(primary, 0.0).otherwise(w)).alias("base"))
    s = s.withColumn("best", F.max("base").over(W.partitionBy("record_id")))
    use = F.when(F.round("best", 9) < round(open_below, 9), F.col("full")).otherwise(F.col("base"))
    return s.where(_at_least(use, gate)).select(*CELL)


def weighted_top_k(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float], gate: float, k: int) -> DataFrame:
    c = combined(scores, weights, cuts).where(_at_least(F.col("weight"), gate))
    w = W.partitionBy("record_id").orderBy(F.desc(F.round("weight", 9)), "code")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(*CELL)


def frequency_buckets(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float], gate: float, support: DataFrame, rare_below: int = 25, rare: float = 1.08, frequent: float = 0.97) -> DataFrame:
    """A higher bound for rare labels, a lower one for others. support: code, n."""
    c = combined(scores, weights, cuts).join(lookup(support, "support"), "code", "left")
    g = F.when(F.coalesce("n", F.lit(0)) < rare_below, gate * rare).otherwise(gate * frequent)
    return c.where(_at_least(F.col("weight"), g)).select(*CELL)


def two_threshold(scores: DataFrame, weights: dict[str, float], cuts: dict[str, float], gate: float, low: float = 0.72, votes: int = 3) -> DataFrame:
    c = combined(scores, weights, cuts)
    return c.where(_at_least(F.col("weight"), gate) | (_at_least(F.col("weight"), gate * low) & (F.col("votes") >= votes))).select(*CELL)


def label_champions(report: DataFrame, order: dict[str, int]) -> DataFrame:
    """code, system_name of the best F1; ties go to the earlier system."""
    ix = by_system({k: float(v) for k, v in order.items()}, 1e9)
    w = W.partitionBy("code").orderBy(F.desc(F.round("f1", 9)), ix)
    return report.where(F.col("system_name").isin(list(order))).withColumn("k", F.row_number().over(w)).where("k = 1").select("code", "system_name")


def label_routing(scores: DataFrame, champions: DataFrame, cut: float = 1.0) -> DataFrame:
    return scores.join(lookup(champions, "champions"), ["code", "system_name"]).where(_at_least(F.col("score"), cut)).select(*CELL)


def champion_plus_vote(scores: DataFrame, champions: DataFrame, others: int, cuts: dict[str, float], systems: list[str]) -> DataFrame:
    """Cells that the label's champion or at least `others` other systems vote for; `others` is put between one and all but one of the systems.

    A label without a champion has the first system.
    """
    c = scores.join(lookup(champions.withColumnRenamed("system_name", "champion"), "champions"), "code", "left").withColumn("champion", F.coalesce("champion", F.lit(systems[0])))
    vote = F.col("score") >= by_system(cuts, 1.0)
    own = F.col("system_name") == F.col("champion")
    s = c.groupBy(*CELL).agg(F.max((vote & own).cast("int")).alias("own"), F.count_if(vote & ~own).alias("n"))
    return s.where((F.col("own") == 1) | (F.col("n") >= max(1, min(others, len(systems) - 1)))).select(*CELL)


def record_champions(scores: DataFrame, policy: str = "max", labels: int = 1) -> DataFrame:
    """record_id, system_name of the best row of scores: its mean over the label space, its greatest or its length; ties go to the earlier system."""
    stat = {"mean": F.sum("score") / labels, "max": F.max("score"), "l2": F.sqrt(F.sum(F.col("score") * F.col("score")))}[policy]
    s = scores.groupBy("record_id", "system_name", "system_ix").agg(stat.alias("s"))
    w = W.partitionBy("record_id").orderBy(F.desc(F.round("s", 9)), "system_ix")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select("record_id", "system_name")


def record_routing(scores: DataFrame, champions: DataFrame, cut: float = 1.0) -> DataFrame:
    return scores.join(champions, ["record_id", "system_name"]).where(_at_least(F.col("score"), cut)).select(*CELL)


def correction_votes(scores: DataFrame, base: str, factors: list[float], binary: list[str]) -> DataFrame:
    """record_id, code, own, votes: whether the base system has the cell, and for each factor how many others vote for it.

    A score system votes from the factor on, a binary one from 0.5 on whatever the factor. All factors are counted in one aggregation.
    """
    two = F.col("system_name").isin(binary)
    own = F.col("system_name") == base
    has = _at_least(F.col("score"), F.when(two, 0.5).otherwise(1.0))
    votes = F.array(*[F.count_if(~own & _at_least(F.col("score"), F.when(two, 0.5).otherwise(float(f)))) for f in factors])
    return scores.groupBy(*CELL).agg((F.count_if(own & has) > 0).alias("own"), votes.alias("votes"))


def corrected(own: Column, n: Column, votes: Column | int, remove: Column | bool) -> Column:
    """Whether a cell is in the corrected set: the base's own unless it is to go for want of any vote, others' with enough votes."""
    gone = (F.lit(remove) if isinstance(remove, bool) else remove) & (n == 0)
    return (own & ~gone) | (~own & (n >= votes))


def correction(scores: DataFrame, base: str, votes: int, factor: float, remove: bool, binary: list[str]) -> DataFrame:
    """The base system's codes, with cells added that enough others vote for at the factor, and on demand without those that no other votes for at it."""
    c = correction_votes(scores, base, [factor], binary)
    return c.where(corrected(F.col("own"), F.col("votes")[0], votes, remove)).select(*CELL)


def correction_grid(scores: DataFrame, base: str, votes: list[int], factors: list[float], binary: list[str]) -> DataFrame:
    """votes, factor, remove, record_id, code of every point of the grid: the cells are counted once and spread over the points they belong to."""
    c = correction_votes(scores, base, factors, binary)
    points = F.array(*[F.struct(F.lit(v).alias("votes"), F.lit(float(f)).alias("factor"), F.lit(int(r)).alias("remove"), corrected(F.col("own"), F.col("votes")[i], v, r).alias("on")) for v in votes for i, f in enumerate(factors) for r in (False, True)])
    return c.select(*CELL, F.explode(F.filter(points, lambda p: p.on)).alias("p")).select("p.votes", "p.factor", "p.remove", *CELL)


def cluster_champions(clusters: DataFrame, scored: DataFrame, order: dict[str, int]) -> DataFrame:
    """cluster, system_name of the best micro F1 inside the cluster (ties: earlier). clusters: record_id, cluster; scored: system_name, record_id, tp, fp, fn."""
    s = scored.join(clusters, "record_id").groupBy("cluster", "system_name").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = s.withColumn("f1", L.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    w = W.partitionBy("cluster").orderBy(F.desc(F.round("f1", 9)), by_system({k: float(v) for k, v in order.items()}, 1e9))
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster", "system_name", "f1")


def cluster_routing(preds: DataFrame, clusters: DataFrame, champions: DataFrame, default: str) -> DataFrame:
    """The predictions of each cluster's champion, of `default` where a record has no cluster or its cluster no champion."""
    route = preds.select("record_id").distinct().join(clusters, "record_id", "left").join(lookup(champions.select("cluster", F.col("system_name").alias("s")), "champions"), "cluster", "left").select("record_id", F.coalesce("s", F.lit(default)).alias("system_name"))
    return preds.join(route, ["record_id", "system_name"]).select(*CELL)


def replay(scores: DataFrame, strategies: dict[str, tuple[str, dict]], compositions: list[Composition] = ()) -> DataFrame:
    """strategy, record_id, code: base strategies of the registry with their parameters, and compositions of them, over the same scores.

    strategies: slug -> (name in STRATEGIES, parameters). A composition that lacks an input is left out. One plan; write it partitioned by strategy.
    """
    base = {slug: STRATEGIES[name](scores, **params) for slug, (name, params) in strategies.items()}
    every = dict(base)
    for c in compositions:
        if (p := compose(c, every)) is not None:
            every[c.slug] = p
    return reduce(DataFrame.unionByName, [p.select(F.lit(slug).alias("strategy"), *CELL) for slug, p in every.items()])


#: Base strategies by slug; each is a function of scores and parameters, so it replays on any split.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "weighted": weighted, "weighted_gated": gated_secondary, "weighted_top_k": weighted_top_k, "weighted_freq_buckets": frequency_buckets, "weighted_two_threshold": two_threshold,
    "per_label_routing": label_routing, "per_label_champion_plus_vote": champion_plus_vote, "per_record_routing": record_routing, "correction": correction, "weighted_majority": majority,
}
