"""Thresholds and search over fusion parameters.

Cells: (record_id, code, score double) of one system, or (record_id, system_ix, code, score) for the search. gold: (record_id, groups).
Sweeps are relational: a cell is put into the grid step that it reaches, counts are added up by step before they are shuffled. Order-dependent
searches run one sequential chain in each group of applyInPandas, chains in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.staging import lookup


def threshold_sweep(cells: DataFrame, gold: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, f1 at each grid step, group-level.

    A group is hit at every step up to its best cell's, a wrong code wrong up to its own: one count by step and a running sum from above.
    """
    total = gold.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0)).cast("bigint").alias("n"))
    steps = sorted(grid)
    reached = F.lit(0)
    for i, t in enumerate(steps):
        reached = F.when(F.round("score", 9) >= round(t, 9), i + 1).otherwise(reached)
    g = gold.select("record_id", F.posexplode("groups").alias("ix", "g")).select("record_id", "ix", F.explode(F.array_distinct("g")).alias("code"))
    c = cells.join(gold.select("record_id"), "record_id", "left_semi").select("record_id", "code", reached.alias("step")).where("step > 0")
    hit = g.join(c, ["record_id", "code"]).groupBy("record_id", "ix").agg(F.max("step").alias("step")).groupBy("step").agg(F.count("*").alias("tp"))
    miss = c.join(g.select("record_id", "code").distinct(), ["record_id", "code"], "left_anti").groupBy("step").agg(F.count("*").alias("fp"))
    spark = cells.sparkSession
    table = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(steps)], "step int, threshold double")
    s = table.join(hit, "step", "left").join(miss, "step", "left").na.fill(0)
    above = W.orderBy(F.desc("step"))
    s = s.select("threshold", F.sum("tp").over(above).alias("tp"), F.sum("fp").over(above).alias("fp")).join(F.broadcast(total))
    return s.select("threshold", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"), L.f1(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp")).alias("f1"))


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """The first threshold of the greatest F1; the default if nothing is ever right: one row."""
    return sweep.orderBy(F.desc(F.round("f1", 9)), "threshold").limit(1).select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(default).alias("threshold"), "f1")


def label_thresholds(cells: DataFrame, gold: DataFrame, grid: list[float], least: int = 1) -> DataFrame:
    """code, threshold, f1: for each label by itself the first grid step of the greatest binary F1, labels of fewer positives left out."""
    y = gold.select("record_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("code")).withColumn("y", F.lit(1))
    support = y.groupBy("code").agg(F.count("*").alias("pos")).where(f"pos >= {least}")
    c = cells.join(gold.select("record_id"), "record_id", "left_semi").join(y, ["record_id", "code"], "left")
    s = c.withColumn("t", F.explode(F.array(*map(F.lit, grid)))).where(F.round("score", 9) >= F.round("t", 9)).groupBy("code", "t").agg(F.count("y").alias("tp"), F.count_if(F.col("y").isNull()).alias("fp"))
    s = s.join(lookup(support, "support"), "code").withColumn("f1", F.round(L.f1(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")), 9))
    return s.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("f1"), "t"))).where("k = 1").select("code", F.col("t").alias("threshold"), "f1")


def leave_one_out(cells: DataFrame, gold: DataFrame, systems: list[str], votes: int) -> DataFrame:
    """left_out ('' for none), tp, fp, f1 of the vote of all systems but one. cells: system_name, record_id, code of positive cells."""
    total = gold.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0)).cast("bigint").alias("n"))
    c = cells.withColumn("left_out", F.explode(F.array(F.lit(""), *map(F.lit, systems)))).where("left_out <> system_name")
    p = c.groupBy("left_out", "record_id", "code").agg(F.count("*").alias("v")).where(F.col("v") >= votes).groupBy("left_out", "record_id").agg(F.collect_set("code").alias("codes"))
    j = p.join(gold.select("record_id", "groups"), "record_id")
    s = j.groupBy("left_out").agg(F.sum(F.size(F.filter("groups", lambda g: F.arrays_overlap(g, F.col("codes"))))).alias("tp"), F.sum(F.size(F.array_except("codes", F.flatten("groups")))).alias("fp"))
    return s.join(F.broadcast(total)).select("left_out", "tp", "fp", L.f1(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp")).alias("f1"))


class Objective:
    """Group micro F1 of a weighted vote over a compact matrix (cells x systems), for searches inside one task."""

    def __init__(self, part: pd.DataFrame, systems: int) -> None:
        self.x = np.stack(part["scores"].to_numpy()) if len(part) else np.zeros((0, systems))
        self.group = part["group_ix"].to_numpy()
        self.n_groups = int(part["n_groups"].iloc[0]) if len(part) else 0
        self.systems = systems

    def __call__(self, w: np.ndarray, t: np.ndarray, g: float) -> float:
        keep = ((self.x >= t) @ w) >= g - 1e-9
        inside = self.group[keep]
        tp = len(np.unique(np.concatenate([i for i in inside if len(i)]))) if any(len(i) for i in inside) else 0
        fp = sum(len(i) == 0 for i in inside)
        return 2 * tp / (tp + fp + self.n_groups) if tp else 0.0


def _start(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    return rng.uniform(0.05, 1, n), rng.uniform(0.6, 1.4, n), float(rng.uniform(0.05, 1.2))


def _move(rng: np.random.Generator, p: tuple[np.ndarray, np.ndarray, float], step: float, parts: int) -> tuple[np.ndarray, np.ndarray, float]:
    w, t, g = p[0].copy(), p[1].copy(), p[2]
    for i in rng.choice(2 * len(w) + 1, min(parts, 2 * len(w) + 1), replace=False):
        d = rng.uniform(-step, step)
        if i < len(w):
            w[i] = np.clip(w[i] + d, 0.0, 2.0)
        elif i < 2 * len(w):
            t[i - len(w)] = np.clip(t[i - len(w)] + d, 0.1, 3.0)
        else:
            g = float(np.clip(g + d, 0.01, 3.0))
    return w, t, g


def chain(f: Objective, seed: int, budget: int, method: str, local: int = 8) -> tuple[float, tuple[np.ndarray, np.ndarray, float]]:
    """One sequential search: 'random', 'climb' (three quarters random, then steps of 0.08) or 'vns'.

    vns: neighbourhoods 1 to 5 shake so many parameters of one block (weights, cuts, gate in turn), each shake is followed by a local search of at most `local` single steps; a gain
    goes back to the first neighbourhood, a cycle without any starts anew from a random point. The best point of all is kept.
    """
    rng = np.random.default_rng(seed)
    best = _start(rng, f.systems)
    value = f(*best)
    spent = 1
    if method != "vns":
        for i in range(budget - 1):
            p = _start(rng, f.systems) if method == "random" or i < 0.75 * budget else _move(rng, best, 0.08, 1)
            if (v := f(*p)) > value:
                best, value = p, v
        return value, best
    here, at, radius = best, value, 1
    while spent < budget:
        p = _shake(rng, here, radius)
        v = f(*p)
        spent += 1
        for _ in range(min(local, budget - spent)):
            q = _move(rng, p, 0.08, 1)
            spent += 1
            if (w := f(*q)) > v:
                p, v = q, w
        if v > at:
            here, at, radius = p, v, 1
        elif radius < 5:
            radius += 1
        else:
            here = _start(rng, f.systems)
            at, radius = f(*here), 1
            spent += 1
        if at > value:
            best, value = here, at
    return value, best


def _shake(rng: np.random.Generator, p: tuple[np.ndarray, np.ndarray, float], radius: int) -> tuple[np.ndarray, np.ndarray, float]:
    """As many parameters of one block as the radius, each moved by up to 0.08 times it."""
    w, t, g = p[0].copy(), p[1].copy(), p[2]
    block = (radius - 1) % 3
    step = lambda n: rng.uniform(-0.08 * radius, 0.08 * radius, n)
    some = rng.choice(len(w), min(radius, len(w)), replace=False)
    if block == 0:
        w[some] = np.clip(w[some] + step(len(some)), 0.0, 2.0)
    elif block == 1:
        t[some] = np.clip(t[some] + step(len(some)), 0.1, 3.0)
    else:
        g = float(np.clip(g + step(1)[0], 0.01, 3.0))
    return w, t, g


def search(matrix: DataFrame, systems: int, method: str = "vns", restarts: int = 4, budget: int = 200, seed: int = 42) -> DataFrame:
    """restart, f1, weights, cuts, gate of the best parameters of each restart.

    matrix: scores array<double>, group_ix array<int> (numbers of the gold groups that the cell hits, empty for a wrong code), n_groups. It is the compact
    validation matrix that a search needs whole; each restart's task holds it once.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v, (w, t, g) = chain(Objective(part, systems), seed + key[0], budget, method)
        return pd.DataFrame({"restart": [key[0]], "f1": [v], "weights": [list(w)], "cuts": [list(t)], "gate": [g]})

    copies = matrix.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    return copies.groupBy("restart").applyInPandas(run, "restart int, f1 double, weights array<double>, cuts array<double>, gate double")


def coordinate_descent(cells: DataFrame, gold: DataFrame, grid: list[float], passes: int = 2, least: int = 1, start: float = 0.5) -> DataFrame:
    """code, threshold after coordinate descent on the group micro F1: classes in order, each takes the first grid step that is strictly better than what is best so far.

    Cells are cut down to (record, code, grid step) before the one sequential task gets them.
    """
    y = gold.select("record_id", F.posexplode("groups").alias("ix", "g")).select("record_id", "ix", F.explode(F.array_distinct("g")).alias("code"))
    pos = y.select("record_id", "code").distinct().groupBy("code").agg(F.count("*").alias("pos"))
    hits = y.groupBy("record_id", "code").agg(F.array_sort(F.collect_set("ix")).alias("groups"))
    rows = cells.join(gold.select("record_id"), "record_id", "left_semi").join(hits, ["record_id", "code"], "left").join(lookup(pos, "support"), "code", "left").select("record_id", "code", F.round("score", 9).alias("score"), F.coalesce("groups", F.array().cast("array<int>")).alias("groups"), F.coalesce("pos", F.lit(0)).alias("pos"))
    total = gold.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0)).cast("bigint")).first()[0]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["code", "record_id"])
        keys = {k: i for i, k in enumerate(sorted({(r, g) for r, gs in zip(part["record_id"], part["groups"]) for g in gs}))}
        count = np.zeros(len(keys), np.int64)
        by = {}
        for code, p in part.groupby("code"):
            by[code] = (p["score"].to_numpy(), [[keys[r, g] for g in gs] for r, gs in zip(p["record_id"], p["groups"])], int(p["pos"].iloc[0]))
        t = {c: start for c in by}
        fp = 0

        def apply(code: str, threshold: float, sign: int) -> int:
            wrong = 0
            for i in np.flatnonzero(by[code][0] >= threshold):
                own = by[code][1][i]
                wrong += not own
                for g in own:
                    count[g] += sign
            return sign * wrong

        for c in by:
            fp += apply(c, t[c], 1)
        score = lambda: (lambda tp: 2 * tp / (tp + fp + total) if tp else 0.0)(int((count > 0).sum()))
        best = score()
        for _ in range(passes):
            gained = False
            for c in sorted(by):
                if by[c][2] < least:
                    continue
                chosen = t[c]
                for g in grid:
                    fp += apply(c, t[c], -1)
                    fp += apply(c, g, 1)
                    t[c], v = g, score()
                    if v > best + 1e-12:
                        best, chosen, gained = v, g, True
                fp += apply(c, t[c], -1)
                fp += apply(c, chosen, 1)
                t[c] = chosen
            if not gained:
                break
        return pd.DataFrame({"code": list(t), "threshold": list(t.values())})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "code string, threshold double")


def grid_rows(values: dict[str, list[float]]) -> Iterator[dict[str, float]]:
    """All combinations of a small parameter grid."""
    import itertools

    for x in itertools.product(*values.values()):
        yield dict(zip(values, x))
