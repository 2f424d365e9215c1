import pytest

from lexispark.operators import dictionary as D

CHAIN = D.Chain(boosts=((["shunt"], ["B"]),), rules=((["B"], ["R"]),), section=(["family"], ["social"], "FAM"), negations=(("no", "pain", ["P"]),), window=1)
TEXTS = [
    (1, "Shunt placed"),
    (2, "fever now family fever and rash social smoker"),
    (3, "family rash, social: no pain"),
    (4, "no other pain"),
    (5, "no a b c pain"),
    (6, "nothing"),
    (7, ""),
    (8, None),
    (None, "rash"),
    (9, "fe family x social ver"),
]
TERMS = [("fever", ["F"]), ("rash", ["S"]), ("pain", ["P"]), ("smoker", ["F", "K"])]
WANT = {1: ["B", "R"], 2: ["F", "FAM", "K"], 3: ["FAM"], 5: ["P"], 9: ["FAM"]}


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_chain_of_either_size_of_dictionary(spark, monkeypatch, most):
    monkeypatch.setattr(D, "AUTOMATON_TERMS", most)
    t = spark.createDataFrame(TEXTS, "record_id long, text string")
    d = spark.createDataFrame(TERMS, "term string, codes array<string>")
    got = {r["record_id"]: r["codes"] for r in D.predict_chain(t, d, CHAIN).collect()}
    assert got == WANT


def test_chain_is_one_pass_that_normalizes_once(spark):
    t = spark.createDataFrame(TEXTS, "record_id long, text string")
    d = spark.createDataFrame(TERMS, "term string, codes array<string>")
    plan = D.predict_chain(t, d, CHAIN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.count("translate(") <= 2
