"""Sources, sinks and streams."""

import json

import numpy as np
import pytest

from lexispark.operators import dictionary
from lexispark.sources import documents as D
from lexispark.streaming import coding


def test_documents(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    rows = [{"patient_id": 0, "id": 7, "text": "αβγ", "document_level_annotations": [["A"], None, []], "mention_level_annotations": [{"start": 1, "end": 3, "code": "A"}, {"start": 2, "end": 9, "code": "B"}]}, {"text": "x"}]
    p.write_text("﻿" + json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]) + "\n", encoding="utf-8")
    got = D.parse_mentions(D.read_documents(spark, str(p), number_lines=True)).orderBy("record_id").collect()
    assert [(r["record_id"], r["groups"], [m["mention"] for m in r["mentions"]]) for r in got] == [(3, [], []), (7, [["A"], []], ["βγ"])]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, ["b", "a", "b"]), (1, [])], "record_id bigint, codes array<string>")
    D.write_predictions(df, str(tmp_path / "o"))
    (tmp_path / "sys").mkdir()
    text = "".join(f.read_text() for f in sorted((tmp_path / "o").glob("*.json")))
    (tmp_path / "sys" / "val_predictions.jsonl").write_text(text)
    got = {(r["system_name"], r["record_id"]): r["codes"] for r in D.read_predictions(spark, str(tmp_path), "val").collect()}
    assert got == {("sys", 1): [], ("sys", 2): ["a", "b"]}


def test_small_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("B1 \n\nA2\n")
    assert [(r[0], r[1]) for r in D.read_labels(spark, str(tmp_path / "l.txt")).orderBy("label_ix").collect()] == [(0, "B1"), (1, "A2")]
    (tmp_path / "t.json").write_text('{"thresholds": {"A": 0.4}}')
    assert D.read_thresholds(spark, str(tmp_path / "t.json")).first()[1] == 0.4
    with pytest.raises(ValueError):
        D.read_thresholds(spark, str(tmp_path / "t.json"), ["A", "B"])
    assert D.read_descriptions(spark, str(tmp_path / "none.csv")).count() == 0
    np.save(tmp_path / "scores.npy", np.array([[0.1, 0.2]]))
    (tmp_path / "ids.json").write_text("[5]")
    (tmp_path / "labels.json").write_text('["A", "B"]')
    assert sorted(tuple(r) for r in D.read_scores(spark, str(tmp_path), "m").collect()) == [("m", 5, "A", 0.1), ("m", 5, "B", 0.2)]
    (tmp_path / "ids.json").write_text("[5, 6]")
    assert D.read_scores(spark, str(tmp_path), "m") is None


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "record_id bigint, text string, received_at timestamp"
    spark.sql("select 1L as record_id, 'ήπια στένωση' as text, timestamp'2024-01-01' as received_at union all select 2L, null, timestamp'2024-01-02'").write.parquet(src)
    d = dictionary.load(spark.createDataFrame([("στένωση", "A|B")], "term string, codes_pipe_sep string"))
    q = coding.run(coding.coded(coding.read_records(spark, src, schema), d), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r["record_id"], r["term"], r["codes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "στενωση", ["A", "B"])]
    w = coding.window_counts(coding.read_records(spark, src, schema), d)
    assert w.isStreaming and w.schema["n"].dataType.simpleString() == "bigint"
