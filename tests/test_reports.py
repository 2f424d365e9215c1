"""Reports, entities, the mention pipeline, clusters, split rules and report sinks on small cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import clustering, fusion, pooling, reports, scoring, spans, splits, tuning
from lexispark.sources import documents


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_mcnemar_p_agrees_with_the_driver_function(spark):
    pairs = [(0, 0), (3, 1), (0, 7), (12, 12), (20, 10), (88, 21), (400, 300), (1000, 1003), (15, 60)]
    df = spark.createDataFrame(pairs, "only_a long, only_b long")
    for r in reports.mcnemar_test(df).collect():
        want = scoring.mcnemar_p(r["only_a"], r["only_b"])
        assert (r["p"] is None) if math.isnan(want) else math.isclose(r["p"], want, rel_tol=1e-7), r
    x = [0.0, 0.1, 1.0, 2.4, 2.6, 5.0, 9.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", reports.erfc(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r["y"], math.erfc(r["x"]), rel_tol=1e-7) for r in got)


def test_comparison_and_probe(spark):
    gold = spark.createDataFrame([(1, [["A"], ["B"]]), (2, [["A"]])], "record_id long, groups array<array<string>>")
    preds = spark.createDataFrame([("x", 1, ["A", "B"]), ("y", 1, ["A"]), ("y", 2, ["A"])], "system_name string, record_id long, codes array<string>")
    runs = spark.createDataFrame([("zz", "p/1", "x"), ("z", "p/1", "x"), ("same", "ensemble/q", "y"), ("samelonger", None, "y"), ("gone", "p/2", "w")], "name string, path string, system_name string")
    got = [tuple(r) for r in reports.comparison(gold, preds, runs).orderBy("rank").collect()]
    assert got == [(1, "z", "individual", 1.0, 0.6667, 0.8, None), (2, "gone", "individual", None, None, None, "no predictions")]  # same has the same figures
    rec = spark.createDataFrame([("val", [["A"]]), ("val", None), ("blind", [[" ", None]]), ("none", None), (None, [["A"]])], "split string, document_level_annotations array<array<string>>")
    assert rows(reports.gold_probe(rec), "split", "has_gold") == [("blind", False), ("none", False), ("val", True)]


def test_strict_entities(spark):
    seq = lambda s: spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "record_id long, token_ix int, label string")
    r = spans.entity_scores(seq("BIOBOI"), seq("BIIBOB")).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 2)  # the lone I is no entity


def test_character_map():
    assert spans.char_map("  Άγχος!  Νέο-3 ") == ("αγχοσ νεο 3", [2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14])
    assert spans.char_map("") == ("", []) and spans.char_map(" - ") == ("", [])
    assert spans.char_map("e\u0301a") == ("ea", [0, 2])


def test_mention_pipeline(spark):
    texts = spark.createDataFrame([(1, "Άσθμα και στένωση αορτής"), (2, None)], "record_id long, text string")
    model = spark.createDataFrame([(1, 10, 17)], "record_id long, span_start int, span_end int")
    terms = spark.createDataFrame([("στενωση αορτησ", ["B"]), ("ασθμα", ["A"])], "term string, codes array<string>")
    prior = spark.createDataFrame([("ασθμα", "A2", 3)], "key string, code string, n long")
    mentions, codes = spans.pipeline(texts, model, terms, prior)
    assert rows(mentions, "span_start", "span_end", "mention", "code") == [(0, 5, "Άσθμα", "A2"), (10, 24, "στένωση αορτής", "B")]
    assert rows(codes, "record_id", "codes") == [(1, ["A2", "B"])]


@pytest.mark.parametrize("method", ["ward", "spectral", "dbscan"])
def test_clusters_of_separate_blobs(spark, method):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, features array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.fit_assign(df, df.where("id % 3 > 0"), method, 3 if method != "dbscan" else 5).collect()}
    kinds = [{got[i] for i in range(a, a + 40)} - {-1} for a in (0, 40, 80)]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3
    assert clustering.fit_assign(df, df.where("false"), method, 3).count() == 0


def test_forced_placement_keeps_the_rules(spark):
    rng = random.Random(4)
    lab = {(i, f"c{rng.choice(range(40))}") for i in range(60) for _ in range(rng.randrange(1, 4))} | {(99, "solo")}
    df = spark.createDataFrame(sorted(lab), "record_id long, code string")
    assert splits.violations(splits.split_report(df, splits.stratified(df))).count() == 0
    placed = splits.rare_placement(df)
    assert (99, "train", "solo") in placed and len({i for i, _, _ in placed}) == len(placed)
    with pytest.raises(ValueError, match="labels"):
        splits.rare_placement(df, limit=3)
    assert splits.stratified(df.where("false")).count() == 0


def test_correction_counts_votes_at_the_factor(spark):
    cells = [("net", "a", 1.2), ("rank", "a", 0.95), ("bin", "a", 0.0), ("net", "b", 1.0), ("rank", "b", 0.7), ("bin", "b", 0.0), ("net", "c", 0.2), ("rank", "c", 0.95), ("bin", "c", 1.0), ("net", "d", 0.0), ("rank", "d", 0.3), ("bin", "d", 1.0)]
    sc = spark.createDataFrame([(s, 1, c, v) for s, c, v in cells], "system_name string, record_id long, code string, score double")
    run = lambda *a: [r["code"] for r in fusion.correction(sc, "net", *a, ["bin"]).orderBy("code").collect()]
    assert run(2, 0.9, True) == ["a", "c"] and run(2, 1.0, True) == [] and run(2, 0.9, False) == ["a", "b", "c"] and run(1, 0.5, True) == ["a", "b", "c", "d"]
    g = fusion.correction_grid(sc, "net", [1, 2], [0.9, 1.0], ["bin"])
    assert rows(g.where("votes = 2 and factor = 0.9 and remove = 1"), "code") == [("a",), ("c",)]


def test_losses_weights_and_schedule(spark):
    c = spark.createDataFrame([(1, 0.5, 1), (1, -1.0, 0), (2, 3.0, 0)], "record_id int, logit double, y int")
    assert rows(pooling.rank_loss(c).withColumn("loss", F.round("loss", 6)), "record_id", "loss") == [(1, round(math.log1p(math.exp(-0.5)) + math.log1p(math.exp(-1)), 6)), (2, round(math.log1p(math.exp(3)), 6))]
    assert [round(r[0], 4) for r in spark.range(0, 12, 3).select(pooling.cosine_schedule(F.col("id"), 3, 9)).collect()] == [0.0, 1.0, 0.5, 0.0]


def test_shakes_stay_in_one_block():
    rng = np.random.default_rng(0)
    p = (np.full(4, 0.5), np.full(4, 1.0), 0.5)
    for radius in range(1, 6):
        w, t, g = tuning._shake(rng, p, radius)
        changed = [not np.array_equal(w, p[0]), not np.array_equal(t, p[1]), g != p[2]]
        assert sum(changed) == 1 and changed[(radius - 1) % 3]


def test_report_sinks_and_thresholds(spark, tmp_path):
    terms = spark.createDataFrame([("β", ["B"]), ("α", ["A", "C"])], "term string, codes array<string>")
    documents.write_dictionary(terms, f"{tmp_path}/d")
    assert [tuple(r) for r in documents.read_terms(spark, f"{tmp_path}/d").collect()] == [("α", "A|C"), ("β", "B")]
    documents.write_lookup(spark.createDataFrame([("A", "x")], "code string, description string"), spark.createDataFrame([("B",), ("A",)], "code string"), f"{tmp_path}/l")
    assert rows(spark.read.json(f"{tmp_path}/l"), "code", "description") == [("A", "x"), ("B", "B")]
    documents.write_manifest(spark.createDataFrame([("s", 1, ["A", "B"]), ("s", 2, [])], "strategy string, record_id int, codes array<string>"), f"{tmp_path}/m")
    assert json.loads(spark.read.text(f"{tmp_path}/m").first()[0]) == {"strategy": "s", "records": 2, "codes": 2, "folder": "strategy=s"}
    np.save(f"{tmp_path}/t.npy", np.array([0.25, 0.75]))
    assert rows(documents.read_thresholds(spark, f"{tmp_path}/t.npy", ["A", "B"]), "code", "threshold") == [("A", 0.25), ("B", 0.75)]
    assert rows(documents.read_thresholds(spark, f"{tmp_path}/none.json", ["A"], 0.5), "code", "threshold") == [("A", 0.5)]
    with pytest.raises(FileNotFoundError):
        documents.predictions_path("val", {}, str(tmp_path))
    (tmp_path / "val_predictions.jsonl").write_text("")
    assert documents.predictions_path("val", {}, str(tmp_path)).endswith("val_predictions.jsonl")


def test_batches_and_order(spark):
    t = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(500)] + [(900, None)], "record_id long, text string")
    b = reports.length_batches(t, 8).collect()
    sizes = {}
    for r in b:
        sizes[r["bucket"], r["part"], r["batch"]] = sizes.get((r["bucket"], r["part"], r["batch"]), 0) + 1
    assert len(b) == 501 and max(sizes.values()) == 8
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, record_id long")
    assert rows(reports.order_check(s), "record_id", "runs") == [(2, 1)]
