import random

import pytest

from lexispark.operators import splits


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), "record_id long, code string")


def by_hand(rows):
    """Placement of labels that all find free documents, over all documents of each label; None if one doesn't."""
    docs, width = {}, {}
    for i, c in rows:
        docs.setdefault(c, []).append(i)
        width[i] = width.get(i, 0) + 1
    placed = {}
    for c in sorted(docs, key=lambda c: (len(docs[c]), c)):
        n = len(docs[c])
        for s in ("train",) if n == 1 else ("train", "test") if n < 5 else ("train", "val", "test"):
            if any(placed.get(i) == s for i in docs[c]):
                continue
            free = [i for i in docs[c] if i not in placed]
            if not free:
                return None
            placed[max(free, key=lambda i: (width[i], i))] = s
    return placed


def test_more_labels_than_five_thousand_are_placed(spark):
    rows = {(i, f"r{i // 2}") for i in range(10_400)} | {(i, f"c{i % 7}") for i in range(10_500)}
    placed = splits.rare_placement(frame(spark, rows))
    assert {i: s for i, s, _ in placed} == by_hand(rows)


def test_split_of_more_labels_than_five_thousand_breaks_no_rule(spark):
    rows = {(i, f"r{i // 2}") for i in range(10_400)} | {(i, f"c{i % 7}") for i in range(10_500)}
    labels = frame(spark, rows)
    split = splits.stratified(labels).cache()
    assert split.count() == 10_500
    assert splits.violations(splits.split_report(labels, split)).count() == 0


def test_placement_looks_deeper_where_the_first_documents_are_placed(spark):
    # the widest documents of "many" all go to train for a label of their own; those that may go elsewhere stand far behind them
    rows = {(i, f"{k}-{i:03}") for i in range(150) for k in "xyz"} | {(i, "many") for i in range(160)}
    placed = {i: s for i, s, _ in splits.rare_placement(frame(spark, rows))}
    assert placed == by_hand(rows) and placed[159] == "val" and placed[158] == "test"


def test_placement_of_random_labels(spark):
    rng, seen = random.Random(5), 0
    for _ in range(4):
        rows = {(i, f"c{int(rng.paretovariate(0.6)) % 90}") for i in range(300) for _ in range(rng.randrange(1, 4))}
        labels, want = frame(spark, rows), by_hand(rows)
        placed = {i: s for i, s, _ in splits.rare_placement(labels)}
        assert want is None or placed == want
        seen += want is not None
        assert splits.violations(splits.split_report(labels, splits.stratified(labels))).count() == 0
    assert seen


def test_a_document_moves_without_taking_another_label_its_last_one(spark):
    # x and y put 12 and 22 into train, 11 and 21 into test; z has both of test and needs one in train
    rows = {(11, "x"), (12, "x"), (21, "y"), (22, "y"), (11, "z"), (21, "z"), (12, "w"), (22, "w")} | {(i, "w") for i in range(30, 35)}
    labels = frame(spark, rows)
    placed = splits.rare_placement(labels)
    assert splits.violations(splits.split_report(labels, splits.stratified(labels))).count() == 0
    assert len({i for i, _, _ in placed}) == len(placed)


def test_a_rule_that_cannot_be_kept_is_an_error(spark):
    rows = {(1, "a"), (2, "b"), (1, "z"), (2, "z")}
    with pytest.raises(ValueError, match="label z can't be placed in test"):
        splits.rare_placement(frame(spark, rows))


def test_violations_of_more_labels_than_five_thousand(spark, tmp_path):
    import __spark_entry__ as e

    rows = [(i, "train", [[f"r{i // 2}"], [f"c{i % 7}"]]) for i in range(10_400)] + [(i, "train", [[f"c{i % 7}"]]) for i in range(10_400, 10_500)] + [(7, "val", [["r3", "c0"]])]
    spark.createDataFrame(rows, "record_id long, split string, document_level_annotations array<array<string>>").write.parquet(f"{tmp_path}/records.parquet")
    assert e.queries()["stratified_violations"](spark, str(tmp_path)).count() == 0
