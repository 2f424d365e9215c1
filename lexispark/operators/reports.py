"""Reports and checks over predictions, scores and documents: comparison of runs, error counters, probes, projections to JSON, batches by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from . import scoring as S


def gold_probe(records: DataFrame, groups: str = "document_level_annotations") -> DataFrame:
    """split, has_gold: whether any record of the split has a code that isn't blank; without one its metrics mean nothing. Null splits are left out."""
    some = F.exists(F.flatten(L.groups(groups)), lambda c: F.trim(c) != "")
    return records.where("split is not null").groupBy("split").agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("has_gold"))


def tier(path: Column, ensembles: tuple[str, ...] = ("ensemble/",)) -> Column:
    """ensemble_strategy for predictions below one of the prefixes, else individual."""
    hit = F.lit(False)
    for p in ensembles:
        hit = hit | F.startswith(path, F.lit(p))
    return F.when(hit, "ensemble_strategy").otherwise("individual")


def comparison(gold: DataFrame, preds: DataFrame, runs: DataFrame, digits: int = 4, ensembles: tuple[str, ...] = ("ensemble/",)) -> DataFrame:
    """rank, name, tier, precision, recall, f1, error: the runs compared, errors last, others by falling F1 and name.

    runs: name, path, system_name (a few hundred rows: they are ranked in one window). Of runs with one path the one of shortest name stays, then of runs with the
    same rounded figures likewise. A run without any prediction for a gold record has an error and no figures.
    """
    shortest = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.length("name"), "name"))
    once = runs.withColumn("k", shortest("path")).where("k = 1 or path is null").drop("k")
    m = S.micro(gold, preds).select("system_name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")])
    j = once.join(m, "system_name", "left").withColumn("error", F.when(F.col("f1").isNull(), "no predictions"))
    j = j.withColumn("k", shortest("precision", "recall", "f1")).where("k = 1 or error is not null")
    rank = F.row_number().over(W.orderBy(F.col("error").isNotNull(), F.desc("f1"), "name")).cast("bigint")
    return j.select(rank.alias("rank"), "name", tier(F.col("path"), ensembles).alias("tier"), "precision", "recall", "f1", "error")


def breakdown_errors(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """system_name, kind, code, n over the breakdown by document: every wrong code, and every code of a missed group as often as groups are missed."""
    j = preds.join(gold.select("record_id", "groups"), "record_id")
    missed = F.flatten(F.filter("groups", lambda g: ~F.coalesce(F.arrays_overlap(g, F.col("codes")), F.lit(False))))
    kinds = F.array(F.struct(F.lit("fp").alias("kind"), S.wrong_codes("groups", "codes").alias("c")), F.struct(F.lit("fn").alias("kind"), missed.alias("c")))
    return j.select("system_name", F.explode(kinds).alias("e")).select("system_name", "e.kind", F.explode("e.c").alias("code")).groupBy("system_name", "kind", "code").agg(F.count("*").alias("n"))


def mcnemar_test(counts: DataFrame) -> DataFrame:
    """The row of paired counts with statistic and p: exact binomial below 25 discordant groups, else chi-square with continuity; null without any.

    The error function is a series in built-in functions: no value leaves the engine.
    """
    b, c = F.col("only_a").cast("double"), F.col("only_b").cast("double")
    n = b + c
    chi = F.pow(F.abs(b - c) - 1, F.lit(2)) / n
    tail = F.aggregate(F.sequence(F.lit(0), F.least(b, c).cast("int")), F.lit(0.0), lambda acc, k: acc + choose(n, k))
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))
    return counts.withColumn("statistic", F.when(n >= 25, chi)).withColumn("p", F.when(n == 0, F.lit(None).cast("double")).when(n < 25, exact).otherwise(erfc(F.sqrt(chi / 2))))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a product, exact in doubles for n below 50."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)


def erfc(x: Column) -> Column:
    """Complementary error function of a number from 0 up: Taylor's series up to 2.5, beyond it the continued fraction; relative error below 1e-9."""
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), lambda a, i: F.struct((-a.term * x * x / i).alias("term"), (a.sum - a.term * x * x / i / (2 * i + 1)).alias("sum")), lambda a: 1 - a.sum * 2 / F.sqrt(F.lit(3.141592653589793)))
    deep = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, i: i / F.lit(2.0) / (x + acc))
    return F.when(x < 2.5, odd).otherwise(F.exp(-x * x) / F.sqrt(F.lit(3.141592653589793)) / (x + deep))


def order_check(scores: DataFrame, run: str = "run") -> DataFrame:
    """record_id, runs of the ids that not every run of scores has: keyed joins need no order, only the same ids. Empty if all agree."""
    n = scores.agg(F.countDistinct(run).alias("n"))
    return scores.groupBy("record_id").agg(F.countDistinct(run).alias("runs")).join(F.broadcast(n)).where("runs < n").select("record_id", "runs")


def texts_by_id(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """ix, record_id, text of the wanted ids (ix, record_id) in their order; '' for an id that is missing or has no text."""
    return ids.join(texts.select("record_id", "text"), "record_id", "left").select("ix", "record_id", F.coalesce("text", F.lit("")).alias("text"))


def mentions_json(mentions: DataFrame) -> DataFrame:
    """record_id, json: a record's mentions as one JSON array by start, end and code, null fields left out."""
    m = F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "code", "mention")
    return mentions.groupBy("record_id").agg(F.to_json(F.array_sort(F.collect_list(m))).alias("json"))


def length_batches(texts: DataFrame, size: int, width: int = 256, salt: int = 0, key: str = "record_id", text: str = "text") -> DataFrame:
    """key, bucket, batch: texts of similar length put into batches of at most `size`, in hashed order inside a bucket of lengths.

    A bucket is `width` characters wide and dealt to parts of some thousand texts by hash first, so that no window holds a whole bucket; only a part's last batch is smaller.
    """
    n = F.coalesce(F.char_length(text), F.lit(0))
    rows = texts.select(key, F.floor(n / width).alias("bucket"), n.alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("in_bucket") / (64 * size))).cast("int")
    count = rows.groupBy("bucket").agg(F.count("*").alias("in_bucket"))
    rows = rows.join(count, "bucket").withColumn("part", F.pmod(F.xxhash64(key, F.lit(salt)), parts))
    w = W.partitionBy("bucket", "part").orderBy(F.desc("n"), key)
    return rows.select(key, "bucket", "part", (F.floor((F.row_number().over(w) - 1) / size)).alias("batch"))


def group_indices(groups: Column, codes: Column, labels: list[str]) -> Column:
    """Groups as sorted indices into an ordered label space, unknown codes and empty groups dropped; without any group left each known code is its own."""
    at = lambda c: (F.array_position(F.array(*map(F.lit, labels)), c) - 1).cast("int")
    known = lambda g: F.array_sort(F.array_distinct(F.filter(F.transform(g, at), lambda i: i >= 0)))
    own = F.filter(F.transform(groups, known), lambda g: F.size(g) > 0)
    single = F.transform(known(F.coalesce(codes, F.array().cast("array<string>"))), lambda i: F.array(i))
    return F.when(F.size(own) > 0, own).otherwise(single)
