import random

import pytest

from lexispark.llm import overlap, routing
from tests.llm.test_llm import brute_overlap, rows


@pytest.mark.parametrize("holders", [4_000_000, 20])
def test_overlap_in_passes_loses_no_pair(spark, monkeypatch, holders):
    """Several passes of meeting, also with runs spread over buckets: the same pairs as by brute force, each pass with a part of the flushes."""
    rng = random.Random(3)
    draw = lambda k: " ".join(rng.choices([f"w{i}" for i in range(900)], k=k))
    base = draw(60).split(" ")
    recs = [(i, "train" if i % 2 else "test", f"{draw(20)} {' '.join(base[: 40 + i % 20])} {draw(10)}") for i in range(60)]
    recs += [(100 + i, "val" if i % 3 else "train", draw(30)) for i in range(40)]
    recs += [(200 + i, "train" if i % 3 else "val", recs[60 + i][2]) for i in range(40)]
    df = spark.createDataFrame(recs, "record_id bigint, split string, text string")
    monkeypatch.setattr(routing, "HOT_HOLDERS", holders)
    monkeypatch.setattr(routing, "PASS_CHARS", 1 + sum(len(t) for _, _, t in recs) // 3)
    taken = []
    meeting = routing._meeting
    monkeypatch.setattr(routing, "_meeting", lambda k, n: taken.append((k, n)) or meeting(k, n))
    assert rows(overlap.split_overlap(df), "record_id_a", "record_id_b") == brute_overlap(recs)
    assert taken == [(0, 3), (1, 3), (2, 3)]
