"""Same or near-same records on both sides of a split: a full-text index of evaluation shards, through which training records stream.

Plan. (1) `routing` finds, without loss and without a cap, which texts of the two sides may share enough of their five-word runs; equal texts of one side are one class.
(2) Evaluation classes are dealt to shards, and training classes to the shards that hold a partner of theirs. (3) Each shard builds an FM-index of its
evaluation texts and streams its training texts through backward search; the runs found are located, merged into maximal matches along
diagonals, and counted exactly. Also classes of the same words go this way. Reports count on classes; only the list of pairs names every record.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import checked_broadcast, spread, stage
from .fmindex import FMIndex
from .routing import RUN, distinct, routes
from .textkernel import Words, chunks, windows


def match_shard(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """Stream a shard's training texts through the index of its evaluation texts.

    e: rep_e, text_e. t: rep, text, wanted (the evaluation classes to which it was routed). Returns for each routed pair with a match
    the distinct runs on either side, those in common, the number of maximal matches and the longest of them.
    """
    cols = ["rep_e", "rep_t", "runs_e", "runs_t", "common", "matches", "longest"]
    if not len(e) or not len(t):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
    ew = Words(list(e["text_e"]))
    index = FMIndex([ew.hash[a:b] for a, b in zip(ew.first[:-1], ew.first[1:])])
    eid = e["rep_e"].to_numpy()
    eh, er, _ = windows(ew, RUN)
    runs_e = _distinct(eh, er, len(e))
    rank = np.argsort(eid)
    out = []
    for i, j in chunks(list(t["text"])):
        part = t.iloc[i:j]
        tw = Words(list(part["text"]))
        th, tr, _ = windows(tw, RUN)
        runs_t = _distinct(th, tr, len(part))
        at, lo, hi = index.backward(tw.hash, tw.rec, RUN)
        size = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        seq, pos = index.locate(rows)
        at = np.repeat(at, size)
        who = tw.rec[at]
        wanted = np.unique(np.concatenate([k * len(e) + rank[np.searchsorted(eid, w, sorter=rank)] for k, w in enumerate(part["wanted"])]).astype(np.int64))
        key = who * len(e) + seq
        hit = np.isin(key, wanted)
        key, at, who, pos = key[hit], at[hit], who[hit], pos[hit]
        if not len(key):
            continue
        # maximal matches: neighbouring runs on one diagonal of a pair
        where = at - tw.first[who]
        order = np.lexsort((where, pos - where, key))
        k, d, w = key[order], (pos - where)[order], where[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(k))) + RUN - 1
        pair, begin = np.unique(k[first], return_index=True)
        matches, longest = np.diff(np.append(begin, len(first))), np.maximum.reduceat(length, begin)
        # distinct runs in common, whatever the order of the matches
        run_hash = np.zeros(len(tw.hash), np.uint64)
        run_hash[_starts(tw)] = th
        order = np.lexsort((run_hash[at], key))
        k, h = key[order], run_hash[at][order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        common = np.bincount(np.searchsorted(pair, k[new]), minlength=len(pair))
        out.append(pd.DataFrame({"rep_e": eid[pair % len(e)], "rep_t": part["rep"].to_numpy()[pair // len(e)], "runs_e": runs_e[pair % len(e)], "runs_t": runs_t[pair // len(e)], "common": common, "matches": matches, "longest": longest}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})


def _starts(words: Words) -> np.ndarray:
    return np.flatnonzero(words.rec[: len(words.hash) - RUN + 1] == words.rec[RUN - 1 :])


def _distinct(h: np.ndarray, rec: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(distinct(h, rec)[1], minlength=n)


class SplitOverlap:
    """Pairs of a training and an evaluation record of which one's text stands, exactly or almost, in the other.

    records: record_id bigint, split string, text string; further columns are ignored. Null ids, null splits and null or empty texts
    take no part, and a text of fewer than five words has no run and so no partner; a record given more than once counts once.
    share: least share of the distinct five-word runs of the text that has fewer of them.
    hits: sent runs in common that make a candidate; any number is exact, a larger one sends more runs and checks fewer pairs.
    shard: evaluation classes of one index. stream: training classes that one task takes through it.
    """

    def __init__(self, records: DataFrame, train: str = "train", share: float = 0.5, hits: int = 8, shard: int = 400, stream: int = 2000) -> None:
        self.share, self.hits, self.shard, self.stream = share, hits, shard, stream
        self.texts = records.select("record_id", F.when(F.col("split") == train, 1).when(F.col("split").isNotNull(), 2).alias("side"), "text").where("record_id is not null and side is not null and text <> ''")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Matches between class representatives, and membership (record_id, side, rep): a class is the texts of one side with the same words."""
        pairs, texts = routes(spread(self.texts), self.share, self.hits)
        rep = texts.groupBy("sig", "side").agg(F.min("record_id").alias("rep"))
        members = stage(texts.join(rep, ["sig", "side"]).select("flush", "number", "record_id", "side", "rep"), "overlap-members")
        named = members.select("flush", "number", "side", "rep").distinct()
        a, b = (named.toDF(f"flush_{x}", f"number_{x}", f"side_{x}", f"rep_{x}") for x in "ab")
        pairs = pairs.join(a, ["flush_a", "number_a"]).join(b, ["flush_b", "number_b"])
        pick = lambda side: F.when(F.col("side_a") == side, F.col("rep_a")).otherwise(F.col("rep_b"))
        pairs = stage(pairs.select(pick(2).alias("rep_e"), pick(1).alias("rep_t")).distinct(), "overlap-routes")
        members = members.select("record_id", "side", "rep").distinct()

        # texts of the routed classes: the ids are joined by broadcast only if they are few
        wanted = pairs.select(F.explode(F.array("rep_e", "rep_t")).alias("record_id")).distinct()
        texts = stage(self.texts.select("record_id", "side", "text").join(checked_broadcast(stage(wanted, "overlap-wanted")), "record_id", "left_semi").dropDuplicates(["record_id", "side"]), "overlap-texts")
        n = pairs.select("rep_e").distinct().count()
        k = max(1, -(-n // self.shard))
        pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("rep_e"), F.lit(k)))
        ev = pairs.select("shard", F.col("rep_e").alias("rep")).distinct()
        tr = pairs.groupBy("shard", F.col("rep_t").alias("rep")).agg(F.collect_list("rep_e").alias("wanted"))
        # a shard with many training texts is built several times, each time for a part of them
        parts = tr.groupBy("shard").agg(F.ceil(F.count("*") / self.stream).cast("int").alias("parts"))
        tr = tr.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
        ev = ev.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        e = ev.join(texts.where("side = 2"), ev.rep == texts.record_id).select(F.col("shard").alias("shard_e"), F.col("part").cast("int").alias("part_e"), F.col("rep").alias("rep_e"), F.col("text").alias("text_e"))
        t = tr.join(texts.where("side = 1"), tr.rep == texts.record_id).select("shard", F.col("part").cast("int").alias("part"), "rep", "text", "wanted")
        found = e.groupBy("shard_e", "part_e").cogroup(t.groupBy("shard", "part")).applyInPandas(match_shard, "rep_e bigint, rep_t bigint, runs_e bigint, runs_t bigint, common bigint, matches bigint, longest bigint")
        return stage(found.where(F.col("common") >= F.lit(self.share) * F.least("runs_e", "runs_t")), "overlap-found"), members

    def pairs(self) -> DataFrame:
        """Every pair of records: eval_id, train_id and the pair's counts."""
        found, members = self.classes()
        t = members.where("side = 1").select(F.col("rep").alias("rep_t"), F.col("record_id").alias("train_id"))
        e = members.where("side = 2").select(F.col("rep").alias("rep_e"), F.col("record_id").alias("eval_id"))
        return found.join(e, "rep_e").join(t, "rep_t").where("eval_id <> train_id").select("eval_id", "train_id", "runs_e", "runs_t", "common", "matches", "longest").dropDuplicates(["eval_id", "train_id"])


def split_overlap(records: DataFrame, **params: float) -> DataFrame:
    """record_id_a < record_id_b: one in train, one not, of which the one's text stands exactly or almost in the other."""
    p = SplitOverlap(records, **params).pairs()
    return p.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b")).distinct()


def split_report(records: DataFrame, **params: float) -> DataFrame:
    """For each evaluation split and source: its records, those that overlap with train, the training records and pairs concerned, the greatest share.

    Counted on classes: members of a class are added up before they meet other classes, pairs of records are never listed. The split and source of a
    record given more than once are the least ones.
    """
    found, members = SplitOverlap(records, **params).classes()
    meta = records.where("record_id is not null and split is not null").groupBy("record_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    ev = meta.where("split <> 'train'")
    own = members.where("side = 2").join(ev, "record_id").groupBy(F.col("rep").alias("rep_e"), "split", "source").agg(F.count("*").alias("n_e"))
    train = members.where("side = 1").groupBy(F.col("rep").alias("rep_t")).agg(F.count("*").alias("n_t"))
    share = F.col("common") / F.least("runs_e", "runs_t")
    parts = [
        ev.groupBy("split", "source").agg(F.count("*").alias("records")),
        found.groupBy("rep_e").agg(F.max(share).alias("share")).join(own, "rep_e").groupBy("split", "source").agg(F.sum("n_e").alias("leaked"), F.max("share").alias("most")),
        found.select("rep_e", "rep_t").join(own, "rep_e").groupBy("split", "source", "rep_t").agg(F.sum("n_e").alias("n_e")).join(train, "rep_t").groupBy("split", "source").agg(F.sum("n_t").alias("train_records"), F.sum(F.col("n_e") * F.col("n_t")).alias("pairs")),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "leaked", "train_records", "pairs")]
    return rows.groupBy("split", "source").agg(*counts, F.round(F.max("most"), 4).alias("most"))
