"""Splits with guarantees for rare labels, reports on them, folds, augmentation.

Labels: (record_id, code), distinct. Forced placement runs on the driver over the first few documents of each label, held as numbers: its input follows the label space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import lookup, stage
from .stratification import SPLITS, stratify


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("code").agg(F.countDistinct("record_id").alias("n"))


#: First documents of a label that are looked at before more of them are fetched, how many times as many then, and labels that one chain of moves may go through.
FIRST_DOCS, DEEPER, CHAIN = 16, 8, 8


class _Placement:
    """Labels, numbered in the order in which they are placed, and the documents that are known of them, by falling width and id.

    Of each known document all labels are known, so the counts by split are those of all documents; of a label with more than `depth` documents only the first `depth` are sure to be known.
    """

    def __init__(self, n: np.ndarray, depth: np.ndarray, record: np.ndarray, code: np.ndarray, width: np.ndarray) -> None:
        self.n, self.depth = n, depth
        self.ids, doc = np.unique(record, return_inverse=True)
        order = np.lexsort((-record, -width, code))
        self.docs, self.first = doc[order], np.searchsorted(code[order], np.arange(len(n) + 1))
        order = np.argsort(doc, kind="stable")
        self.codes, self.begin = code[order], np.searchsorted(doc[order], np.arange(len(self.ids) + 1))
        self.at = np.full(len(self.ids), -1, np.int8)
        self.bound = np.zeros(len(self.ids), bool)
        self.count = np.zeros((len(n), 3), np.int32)
        self.log: list[tuple[int, int, int, int]] = []
        self.short: set[int] = set()

    def wanted(self, c: int) -> tuple[int, ...]:
        return (0,) if self.n[c] == 1 else (0, 2) if self.n[c] < 5 else (0, 1, 2)

    def own(self, c: int) -> list[int]:
        return self.docs[self.first[c] : min(self.first[c + 1], self.first[c] + self.depth[c])].tolist()

    def set(self, i: int, split: int, c: int) -> None:
        labels = self.codes[self.begin[i] : self.begin[i + 1]]
        self.log.append((i, split, c, int(self.at[i])))
        if self.at[i] >= 0:
            self.count[labels, self.at[i]] -= 1
        self.count[labels, split] += 1
        self.at[i] = split

    def undo(self, to: int) -> None:
        while len(self.log) > to:
            i, split, _, before = self.log.pop()
            labels = self.codes[self.begin[i] : self.begin[i + 1]]
            self.count[labels, split] -= 1
            if before >= 0:
                self.count[labels, before] += 1
            self.at[i] = before

    def broken(self, i: int, now: int) -> list[int]:
        """Labels up to `now` that lose their only document of a split they need if i leaves it."""
        labels = self.codes[self.begin[i] : self.begin[i + 1]]
        return [c for c in labels[(labels <= now) & (self.count[labels, self.at[i]] == 1)].tolist() if self.at[i] in self.wanted(c)]

    def give(self, c: int, split: int, now: int, fixed: frozenset[int] = frozenset()) -> bool:
        """A document of c goes to the split: the first free one, else one that moves, if may be without taking anything from a label up to `now`, else such labels get another document."""
        own = self.own(c)
        for i in own:
            if self.at[i] < 0:
                self.set(i, split, c)
                return True
        if self.depth[c] < self.n[c]:
            self.short.add(c)
            return True
        if len(fixed) >= CHAIN:
            return False
        movable = [(self.broken(i, now), i) for other in (2, 1, 0) if other != split for i in own if self.at[i] == other and not self.bound[i] and i not in fixed]
        for lost, i in sorted(movable, key=lambda x: len(x[0])):
            mark, other = len(self.log), int(self.at[i])
            self.set(i, split, c)
            if all(self.count[x, other] > 0 or self.give(x, other, now, fixed | {i}) for x in lost):
                return True
            self.undo(mark)
        return False

    def run(self) -> tuple[int, int] | None:
        """Place all labels; the first label and split that can't be, if there is one. `short` has labels of which more documents have to be known: the result doesn't count then."""
        failed = None
        for c in range(len(self.n)):
            for split in self.wanted(c):
                if not self.count[c, split] and not self.give(c, split, c):
                    failed = failed or (c, split)
            if self.n[c] == 1:
                self.bound[self.docs[self.first[c]]] = True
        return failed


def rare_placement(labels: DataFrame, limit: int | None = None) -> list[tuple[int, str, str]]:
    """(record_id, split, code) of forced placements: labels by rising count and name; of one document it goes to train, of two to four one goes to train and one to test,
    of five or more one to each of train, val and test. The free document with most labels, then the highest id, is taken; without a free one a document that no single label binds moves,
    if may be one that no earlier label needs where it is, else these get others.

    An error if a rule can't be kept, and beyond `limit` labels if one is given. The driver holds the counts of labels and, as numbers, the first FIRST_DOCS documents of each label with all labels of these;
    of labels whose first ones are all placed by then it fetches more and begins anew.
    """
    labels = stage(labels.select("record_id", "code"), "placement-labels")
    counts = label_counts(labels).toArrow()
    if limit is not None and len(counts) > limit:
        raise ValueError(f"more than {limit} labels")
    if not len(counts):
        return []
    n = counts["n"].to_numpy()
    order = sorted(range(len(n)), key=lambda i, codes=counts["code"].to_pylist(): (n[i], codes[i]))
    codes, n = counts["code"].combine_chunks().take(pa.array(order)), n[order]
    ranked = stage(labels.join(labels.groupBy("record_id").agg(F.count("*").alias("labels")), "record_id"), "placement-widths")
    depth = np.minimum(n, FIRST_DOCS)
    parts = [_known(ranked, ranked, FIRST_DOCS, codes)]
    while True:
        record, code, width = (np.concatenate(x) for x in zip(*parts))
        fresh = np.unique(np.stack([record, code]), axis=1, return_index=True)[1] if len(parts) > 1 else slice(None)
        p = _Placement(n, depth, record[fresh], code[fresh], width[fresh])
        failed = p.run()
        if not p.short:
            break
        short = np.array(sorted(p.short))
        for k in np.unique(depth[short]).tolist():
            some = short[depth[short] == k]
            these = labels.sparkSession.createDataFrame([(c,) for c in codes.take(pa.array(some)).to_pylist()], "code string")
            parts.append(_known(ranked.join(these, "code"), ranked, k * DEEPER, codes))
        depth = depth.copy()
        depth[short] = np.minimum(n[short], depth[short] * DEEPER)
    if failed:
        raise ValueError(f"label {codes[failed[0]]} can't be placed in {SPLITS[failed[1]]}")
    last = {i: k for k, (i, *_) in enumerate(p.log)}
    return [(int(p.ids[i]), SPLITS[s], codes[c].as_py()) for k, (i, s, c, _) in enumerate(p.log) if last[i] == k]


def _known(some: DataFrame, ranked: DataFrame, depth: int, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, number of the label and width for all labels of the first `depth` documents of each of some labels."""
    order = [F.desc("labels"), F.desc("record_id")]
    # the first documents of parts of a label, then of the label: a label of very many documents is no single task's window
    part = W.partitionBy("code", F.pmod(F.xxhash64("record_id"), F.lit(64))).orderBy(*order)
    rows = some.withColumn("k", F.row_number().over(part)).where(F.col("k") <= depth)
    docs = rows.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(*order))).where(F.col("k") <= depth).select("record_id").distinct()
    t = ranked.join(docs, "record_id", "left_semi").select("record_id", "code", "labels").toArrow()
    return t["record_id"].to_numpy(), pc.index_in(t["code"], value_set=codes).to_numpy().astype(np.int64), t["labels"].to_numpy()


def two_way(labels: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """record_id, split (train, test) of two parts: records of labels with one document are forced to train, the others dealt out in proportion."""
    single = labels.join(lookup(label_counts(labels).where("n = 1"), "label-counts"), "code").select("record_id").distinct().withColumn("forced", F.lit("train"))
    r = stratified(labels, share, 0.0, seed, forced=False)
    return r.join(single, "record_id", "left").select("record_id", F.coalesce("forced", "split").alias("split"))


def stratified(labels: DataFrame, test: float = 0.1, val: float = 0.1, seed: int = 42, forced: bool = True, records: DataFrame | None = None) -> DataFrame:
    """record_id, split: forced rare placements, then iterative stratification of the others, test first, then validation, to the exact sizes. records: record_id of all records, also of those without labels.

    Where more records are forced into a split than its share, it takes no others. One task goes through the labels, since each step depends on all before it (`stratification`); the result is staged.
    """
    spark = labels.sparkSession
    # once for all passes: each would else take its own of several rows of a record
    labels = stage(labels.select("record_id", "code"), "stratified-labels")
    fixed = spark.createDataFrame([(i, SPLITS.index(s)) for i, s, _ in rare_placement(labels)] if forced else [], "record_id bigint, forced tinyint")
    # of labels with as many records left the first in hashed order is next
    numbers = labels.select("code").distinct().select("code", (F.row_number().over(W.orderBy(F.xxhash64("code", F.lit(seed)), "code")) - 1).alias("c"))
    sets = labels.join(lookup(numbers, "label-numbers"), "code").groupBy("record_id").agg(F.collect_set("c").alias("codes"))
    if records is not None:
        sets = sets.join(records.select("record_id").distinct(), "record_id", "full")
    rows = sets.join(fixed, "record_id", "left").select("record_id", F.coalesce("forced", F.lit(-1).cast("tinyint")).alias("forced"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    r = rows.repartition(1).sortWithinPartitions("record_id").mapInArrow(lambda batches: stratify(batches, test, val, seed, forced), "record_id bigint, split string")
    return stage(r, "stratified-split")


def split_report(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """code, total, train, val, test. splits: record_id, split."""
    j = labels.join(splits, "record_id")
    c = lambda s: F.count_if(F.col("split") == s).alias(s)
    return j.groupBy("code").agg(F.count("*").alias("total"), c("train"), c("val"), c("test"))


def violations(report: DataFrame) -> DataFrame:
    """code, rule of labels that break a rule: one document must be in train, two to four in train and test, more in all three."""
    rule = F.when((F.col("total") == 1) & (F.col("train") == 0), "single outside train").when(F.col("total").between(2, 4) & ((F.col("train") == 0) | (F.col("test") == 0)), "rare not in train and test").when((F.col("total") >= 5) & ((F.col("train") == 0) | (F.col("val") == 0) | (F.col("test") == 0)), "absent from a split")
    return report.select("code", rule.alias("rule")).where("rule is not null")


def fold(key: Column, k: int, seed: int = 42) -> Column:
    """Fold of a key, in arithmetic that any engine repeats."""
    return F.pmod(key * 7919 + seed * 104729, F.lit(k * 1000003)) % k


def coverage_patch(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """record_id, split after the least moves so that each label stands in train: a missing label's val record, else test record, of least id moves."""
    j = labels.join(splits, "record_id")
    missing = j.groupBy("code").agg(F.count_if(F.col("split") == "train").alias("t"), F.min(F.when(F.col("split") == "val", F.col("record_id"))).alias("v"), F.min(F.when(F.col("split") == "test", F.col("record_id"))).alias("s")).where("t = 0")
    move = missing.select(F.coalesce("v", "s").alias("record_id")).where("record_id is not null").distinct().withColumn("m", F.lit("train"))
    return splits.join(move, "record_id", "left").select("record_id", F.coalesce("m", "split").alias("split"))


def multipliers(labels: DataFrame, bands: tuple[tuple[int, int], ...] = ((50, 4), (150, 3), (400, 2))) -> DataFrame:
    """record_id, copies: the greatest multiplier of a record's labels; labels below a band's count get its multiplier, others none."""
    m = F.lit(0)
    for below, times in reversed(bands):
        m = F.when(F.col("n") < below, times).otherwise(m)
    return labels.join(lookup(label_counts(labels), "label-counts"), "code").groupBy("record_id").agg(F.max(m).cast("bigint").alias("copies"))


def augment(records: DataFrame, copies: DataFrame, synonyms: DataFrame, p: float = 0.35, seed: int = 42, most: int = 10_000) -> DataFrame:
    """record_id, copy, text: copies of records with the terms of a code replaced at random by other terms of it.

    synonyms: term, codes (normalized, as the dictionary). A term that is a single word is swapped where a hash of (record, copy, term) is below p.
    """
    by = synonyms.select("term", F.explode("codes").alias("code"))
    pairs = by.alias("a").join(by.alias("b"), "code").where("a.term <> b.term").groupBy(F.col("a.term").alias("term")).agg(F.min("b.term").alias("other"))
    rows = pairs.where("instr(term, ' ') = 0").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms to swap")
    swaps = {r["term"]: r["other"] for r in rows}
    table = F.create_map(*[F.lit(x) for kv in swaps.items() for x in kv]) if swaps else None
    r = records.join(copies.where("copies > 0"), "record_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    if table is None:
        return r.select("record_id", "copy", "text")
    word = lambda x: F.when((F.pmod(F.xxhash64("record_id", "copy", x, F.lit(seed)), F.lit(1000)) < int(p * 1000)) & F.map_contains_key(table, F.lower(x)), F.element_at(table, F.lower(x))).otherwise(x)
    return r.select("record_id", "copy", F.array_join(F.transform(F.split("text", " "), word), " ").alias("text"))
