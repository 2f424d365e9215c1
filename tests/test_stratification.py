import random

import numpy as np
import pyarrow as pa
import pytest

from lexispark.operators import splits
from lexispark.operators import stratification as S


def batches(sets, size=37):
    rows = [{"record_id": i, "forced": -1, "codes": sorted(c)} for i, c in enumerate(sets)]
    schema = pa.schema([("record_id", pa.int64()), ("forced", pa.int8()), ("codes", pa.list_(pa.int32()))])
    return pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=size)


def record_by_record(sets, need, seed):
    """The second part by the method as it is written: one record after the other, of whole-number demands."""
    rng, n = np.random.default_rng(seed), len(sets)
    left = dict.fromkeys(sorted({c for s in sets for c in s}), 0)
    for c in left:
        left[c] = sum(c in s for s in sets)
    want = [{c: k * x for c, k in left.items()} for x in (n - need, need)]
    room, free, second = [n - need, need], set(range(n)), set()

    def go(docs, demand, unit):
        to, coin = [], None
        demand, r = list(demand), list(room)
        for _ in docs:
            if demand[0] != demand[1]:
                f = int(demand[1] > demand[0])
            elif r[0] != r[1]:
                f = int(r[1] > r[0])
            else:
                coin = rng.random() < 0.5 if coin is None else coin
                f = 0 if coin else 1
            to.append(f)
            demand[f] -= unit
            r[f] -= 1
        k = sum(to)
        some = docs[:k] if k in (0, len(docs)) else rng.permutation(np.array(docs)).tolist()[:k]
        for d in docs:
            f = int(d in set(some))
            room[f] -= 1
            for c in sets[d]:
                want[f][c] -= n
                left[c] -= 1
        free.difference_update(docs)
        second.update(some)

    while any(left.values()):
        c = min((k, c) for c, k in left.items() if k)[1]
        go([d for d in range(n) if d in free and c in sets[d]], (want[0][c], want[1][c]), n)
    go(sorted(free), room, 1)
    first = [d for d in range(n) if d not in second]
    return set(sorted(second)[:need]) | set(first[: max(0, need - len(second))])


@pytest.mark.parametrize("chunk", [S.CHUNK, 16])
def test_second_part_is_that_of_one_record_after_the_other(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    # the loop flips a coin only where a tie comes up, the closed form wherever one may: let both have the same
    monkeypatch.setattr(np.random, "default_rng", lambda seed: Chance(seed))
    rng = random.Random(3)
    for k in range(30):
        sets = [{int(rng.paretovariate(0.5)) % 25 for _ in range(rng.randrange(5))} for _ in range(rng.randrange(2, 150))]
        names = {c: i for i, c in enumerate(sorted({c for s in sets for c in s}))}
        sets = [{names[c] for c in s} for s in sets]
        (folder := tmp_path / str(k)).mkdir()
        own = S.Sets(str(folder), batches(sets))
        need = rng.randrange(1, len(sets))
        got = S.second_part(own, np.ones(len(sets), bool), need, k)
        assert set(np.flatnonzero(got).tolist()) == record_by_record(sets, need, k)


class Chance:
    def __init__(self, seed):
        self.seed = seed

    def random(self):
        return 0.3 if self.seed % 2 else 0.7

    def permutation(self, docs):
        return np.array(sorted(docs, key=lambda d: (int(d) * 7919 + self.seed * 104729) % 1009), dtype=np.asarray(docs).dtype)


def test_needs_of_splits():
    assert S.needs([80, 10, 10], [5, 3, 2], 90) == [75, 7, 8]
    # more are forced into test than its share: the rest of the pool goes to the others
    assert S.needs([80, 10, 10], [20, 5, 60], 15) == [14, 1, 0]


def test_split_has_exact_sizes_and_labels_in_proportion(spark):
    # each record's rarest label is an a; labels b and c are only in proportion if all labels of a record count
    rng = random.Random(8)
    rows = {(i, f"a{i % 80}") for i in range(2_000)} | {(i, f"b{rng.randrange(40)}") for i in range(2_000)} | {(i, f"c{rng.randrange(40)}") for i in range(2_000)}
    labels = spark.createDataFrame(sorted(rows), "record_id long, code string")
    split = splits.stratified(labels).cache()
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 1_600, "val": 200, "test": 200}
    for part in ("test", "val"):
        off = [abs(r[part] - r["total"] / 10) for r in splits.split_report(labels, split).where("code not like 'a%'").collect()]
        assert sum(off) / len(off) < 1.5 and max(off) < 5
    assert splits.violations(splits.split_report(labels, split)).count() == 0
    assert {*splits.stratified(labels.repartition(7)).collect()} == {*split.collect()}


def test_records_without_labels_are_split_too(spark):
    labels = spark.createDataFrame([(i, f"a{i % 4}") for i in range(100)], "record_id long, code string")
    split = splits.stratified(labels, records=spark.range(200).withColumnRenamed("id", "record_id"))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 160, "val": 20, "test": 20}


def test_each_label_stands_in_train_without_forced_placements(spark):
    rows = [(i, f"r{i}") for i in range(30)] + [(i, "all") for i in range(40)]
    labels = spark.createDataFrame(rows, "record_id long, code string")
    report = splits.split_report(labels, splits.stratified(labels, 0.5, 0.2, forced=False))
    assert report.where("train = 0").count() == 0


def test_a_broken_rule_is_an_error():
    with pytest.raises(ValueError, match="break a rule"):
        list(S.stratify(batches([{0}, {0}, {1}]), 0.0, 0.0, 1, True))
