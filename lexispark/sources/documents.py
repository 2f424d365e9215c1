"""Readers and writers of documents, labels, dictionaries, predictions, scores and thresholds."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L

DOCUMENT = "patient_id bigint, id bigint, doc_id bigint, text string, document_level_annotations array<array<string>>, mention_level_annotations array<struct<start:int,end:int,code:string,mention:string,confidence:double>>"


def read_documents(spark: SparkSession, path: str, number_lines: bool = False) -> DataFrame:
    """record_id and the document's fields from JSON lines. A byte order mark and blank lines are ignored.

    The id is the first of patient_id, id and doc_id that is neither null nor 0. With number_lines the physical line number stands in for a missing
    id; that reads each file in one piece, for lines can't be numbered otherwise.
    """
    raw = spark.read.text(path, wholetext=True) if number_lines else spark.read.text(path)
    if number_lines:
        raw = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).withColumn("n", (F.col("n") + 1).cast("bigint"))
    rows = raw.withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    d = rows.select("*", F.from_json("value", DOCUMENT).alias("d"))
    ids = [F.nullif(f"d.{c}", F.lit(0)) for c in ("patient_id", "id", "doc_id")] + ([F.col("n")] if number_lines else [])
    return d.select(F.coalesce(*ids).alias("record_id"), "d.text", L.groups("d.document_level_annotations").alias("groups"), F.coalesce("d.mention_level_annotations", F.array()).alias("mentions"))


def parse_mentions(docs: DataFrame) -> DataFrame:
    """Documents with their mentions valid, in order of start and end, and with the slice where a mention is missing."""
    ok = F.filter("mentions", lambda m: (m.start >= 0) & (m.end > m.start) & (m.end <= F.char_length("text")))
    full = F.transform(ok, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.code.alias("code"), F.coalesce(m.mention, F.substring(F.col("text"), m.start + 1, m.end - m.start)).alias("mention"), m.confidence.alias("confidence")))
    return docs.withColumn("mentions", F.array_sort(full))


def read_predictions(spark: SparkSession, root: str, split: str) -> DataFrame:
    """system_name, record_id, codes from all `<split>_predictions.jsonl` under a folder; the system is the file's folder."""
    p = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{split}_predictions.jsonl").json(root)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return p.select(name.alias("system_name"), F.coalesce(F.nullif("patient_id", F.lit(0)), F.nullif("id", F.lit(0)), F.nullif("doc_id", F.lit(0))).alias("record_id"), L.first_seen("document_level_annotations").alias("codes"))


def write_predictions(preds: DataFrame, path: str) -> None:
    """record_id, codes as JSON lines, each code a group of its own, sorted by id."""
    out = preds.select(F.col("record_id").alias("patient_id"), L.singletons(F.col("codes")).alias("document_level_annotations"))
    out.repartitionByRange("patient_id").sortWithinPartitions("patient_id").write.mode("overwrite").json(path)


def write_by_strategy(preds: DataFrame, path: str) -> None:
    """strategy, record_id, codes, a folder for each strategy."""
    preds.write.mode("overwrite").partitionBy("strategy").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label_ix, code: trimmed, non-empty lines in their order (a label space is one small file)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "c")).select("n", F.trim(F.regexp_replace("c", "^﻿", "")).alias("code")).where("code <> ''")
    return lines.select((F.row_number().over(W.orderBy("n")) - 1).alias("label_ix"), "code")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term, codes_pipe_sep from CSV with a header."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).select("term", "codes_pipe_sep")


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """code, description; rows without either are dropped, a missing file gives none."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "code string, description string")
    d = spark.read.option("header", "true").option("escape", '"').csv(path)
    return d.select(F.trim("code").alias("code"), F.trim("greek_description").alias("description")).where("code <> '' and description <> ''")


def read_scores(spark: SparkSession, folder: str, system: str) -> DataFrame | None:
    """system_name, record_id, code, score from scores.npy, ids.json and labels.json; None if the shapes don't agree or a file is missing."""
    import numpy as np

    names = [os.path.join(folder, n) for n in ("scores.npy", "ids.json", "labels.json")]
    if not all(map(os.path.exists, names)):
        return None
    scores = np.load(names[0], mmap_mode="r")
    ids, labels = (json.load(open(n, encoding="utf-8")) for n in names[1:])
    if scores.shape != (len(ids), len(labels)):
        return None
    rows = spark.createDataFrame([(int(i), [float(x) for x in s]) for i, s in zip(ids, scores)], "record_id bigint, s array<double>")
    return rows.select(F.lit(system).alias("system_name"), "record_id", F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("code"), F.col("s").alias("score"))).alias("x")).select("system_name", "record_id", "x.code", "x.score")


def read_thresholds(spark: SparkSession, path: str, labels: list[str] | None = None, default: float | None = None) -> DataFrame:
    """code, threshold from JSON (bare or under `thresholds`) or from .npy in the order of `labels`.

    With `labels` a missing one is an error, or has the default; a missing file gives the default for all labels, without one it is an error.
    """
    if default is not None and "://" not in path and not os.path.exists(path):
        t: dict[str, float] = {}
    elif path.endswith(".npy"):
        import numpy as np

        values = np.load(path)
        if labels is None or values.shape != (len(labels),):
            raise ValueError("thresholds in .npy need as many labels as there are values")
        t = dict(zip(labels, map(float, values)))
    else:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        t = t.get("thresholds", t)
    if missing := [x for x in labels or [] if x not in t]:
        if default is None:
            raise ValueError(f"no threshold for {missing[:5]}")
        t = {x: t.get(x, default) for x in labels or []}
    return spark.createDataFrame([(k, float(v)) for k, v in t.items()], "code string, threshold double")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """term, codes as CSV (term, codes_pipe_sep) sorted by term over all files."""
    out = dictionary.select("term", F.array_join("codes", "|").alias("codes_pipe_sep"))
    out.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_lookup(descriptions: DataFrame, labels: DataFrame, path: str) -> None:
    """code, description of every label as JSON lines by code; a label without a description has its code."""
    d = labels.select("code").distinct().join(descriptions.groupBy("code").agg(F.min("description").alias("d")), "code", "left")
    d.select("code", F.coalesce("d", "code").alias("description")).repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").json(path)


def write_manifest(exports: DataFrame, path: str) -> None:
    """One JSON line for each strategy of exports (strategy, record_id, codes): records, codes, and its folder."""
    m = exports.groupBy("strategy").agg(F.count("*").alias("records"), F.sum(F.size("codes")).alias("codes")).withColumn("folder", F.concat(F.lit("strategy="), "strategy"))
    m.coalesce(1).sortWithinPartitions("strategy").write.mode("overwrite").json(path)


def predictions_path(split: str, explicit: dict[str, str], folder: str | None = None) -> str:
    """The file of a split's predictions: the explicit one, else the one beside the others if it is there (a remote folder isn't looked into), else an error."""
    if split in explicit:
        return explicit[split]
    beside = os.path.join(folder, f"{split}_predictions.jsonl") if folder else ""
    if beside and ("://" in beside or os.path.exists(beside)):
        return beside
    raise FileNotFoundError(f"no predictions for {split}")
