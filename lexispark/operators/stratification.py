"""Iterative stratification of records with several labels (Sechidis et al. 2011; MultilabelStratifiedShuffleSplit): test, then validation, each with its exact size.

Each step depends on all before it, so one task goes through the labels. Label sets are numbers in mapped files in its local folder: memory follows the records by a few bytes each and the label space.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPLITS = ("train", "val", "test")
#: Records that are looked at together.
CHUNK = 1 << 18
NONE = np.iinfo(np.int64).max


def _mapped(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, kind)


class Sets:
    """Label sets of records by rising id, and the records of each label. From batches of record_id, forced (number of a split or -1), codes (numbers of labels)."""

    def __init__(self, folder: str, batches: Iterable[pa.RecordBatch]) -> None:
        at = lambda name: f"{folder}/{name}"
        pairs, forced = 0, [np.empty(0, np.int8)]
        with open(at("ids"), "wb") as ids, open(at("codes"), "wb") as codes, open(at("ends"), "wb") as ends:
            np.zeros(1, np.int64).tofile(ends)
            for b in batches:
                b.column("record_id").to_numpy().tofile(ids)
                b.column("codes").flatten().to_numpy().tofile(codes)
                end = pairs + np.cumsum(pc.list_value_length(b.column("codes")).to_numpy(), dtype=np.int64)
                end.tofile(ends)
                forced.append(b.column("forced").to_numpy())
                pairs = int(end[-1]) if len(end) else pairs
        self.forced = np.concatenate(forced)
        self.ids, self.codes, self.ends = _mapped(at("ids"), np.int64), _mapped(at("codes"), np.int32), _mapped(at("ends"), np.int64)
        self.n = len(self.ids)
        self.labels = max((int(c.max()) + 1 for _, c in self.pairs() if len(c)), default=0)
        n = self.counts(np.ones(self.n, bool))
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.docs = np.memmap(at("docs"), np.int32, "w+", shape=(pairs,)).view(np.ndarray) if pairs else np.empty(0, np.int32)
        fill = self.first[:-1].copy()
        for doc, code in self.pairs():
            order = np.argsort(code, kind="stable")
            code, k = code[order], np.bincount(code, minlength=self.labels)
            self.docs[fill[code] + np.arange(len(code)) - (np.cumsum(k) - k)[code]] = doc[order]
            fill += k

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Record and label of all pairs, in pieces."""
        for a in range(0, self.n, CHUNK):
            b = min(a + CHUNK, self.n)
            yield np.repeat(np.arange(a, b), np.diff(self.ends[a : b + 1])), self.codes[self.ends[a] : self.ends[b]]

    def counts(self, some: np.ndarray) -> np.ndarray:
        """Records of each label among those of a mask."""
        n = np.zeros(self.labels, np.int64)
        for doc, code in self.pairs():
            n += np.bincount(code[some[doc]], minlength=self.labels)
        return n

    def of(self, label: int) -> np.ndarray:
        return self.docs[self.first[label] : self.first[label + 1]]

    def tally(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of some records and how many of these have each."""
        if len(docs) <= CHUNK:
            return np.unique(self._flat(docs), return_counts=True)
        n = np.zeros(self.labels, np.int64)
        for a in range(0, len(docs), CHUNK):
            n += np.bincount(self._flat(docs[a : a + CHUNK]), minlength=self.labels)
        return np.flatnonzero(n), n[n > 0]

    def _flat(self, docs: np.ndarray) -> np.ndarray:
        begin = self.ends[docs]
        width = self.ends[docs + 1] - begin
        return self.codes[np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())]


class _Lowest:
    """The label of the least count above 0; of several the one of least number. Labels stand in rows, of which the least counts are kept."""

    def __init__(self, left: np.ndarray) -> None:
        self.side = math.isqrt(max(len(left) - 1, 0)) + 1
        self.rows = np.full((self.side, self.side), NONE)
        self.flat = self.rows.reshape(-1)
        self.flat[: len(left)] = np.where(left > 0, left, NONE)
        self.least = self.rows.min(1)

    def get(self) -> int | None:
        r = int(self.least.argmin())
        return None if self.least[r] == NONE else r * self.side + int(self.rows[r].argmin())

    def set(self, labels: np.ndarray, left: np.ndarray) -> None:
        self.flat[labels] = np.where(left > 0, left, NONE)
        r = np.unique(labels // self.side)
        self.least[r] = self.rows[r].min(1)


def second_share(m: int, a: int, b: int, unit: int, room: tuple[int, int], rng: np.random.Generator) -> int:
    """How many of m records go to the second of two parts if each goes where the demand is greater, which falls by `unit` then.

    Of equal demands the part with more room for records is taken, then either by chance. In closed form: from some record on the parts take turns.
    """
    ahead, rest = divmod(a - b, unit)
    if rest or room[0] - ahead > room[1] or (room[0] - ahead == room[1] and rng.random() < 0.5):
        ahead += 1
    return min(m, max(0, (m - ahead + 1) // 2))


def second_part(sets: Sets, pool: np.ndarray, need: int, seed: int) -> np.ndarray:
    """Mask of the records of a pool that go to the second of two parts, of `need` records. The label of fewest records left is next; its records go, in an order by chance, where more of it are wanted.

    Records without labels come last. Then the first records by id, or those beyond the first, change parts until the size is exact.
    """
    n, second = int(pool.sum()), np.zeros(sets.n, bool)
    if not 0 < need < n:
        return pool.copy() if need else second
    rng, free, room = np.random.default_rng(seed), pool.copy(), (n - need, need)
    left = sets.counts(pool)
    want = left * need  # in n-ths of a record
    lowest = _Lowest(left)

    def deal(docs: np.ndarray, k: int) -> np.ndarray:
        nonlocal room
        some = docs[:k] if k in (0, len(docs)) else rng.permutation(docs)[:k]
        second[some], free[docs] = True, False
        room = room[0] - len(docs) + k, room[1] - k
        return some

    while (c := lowest.get()) is not None:
        docs = sets.of(c)
        docs = docs[free[docs]]
        some = deal(docs, second_share(len(docs), n * int(left[c]) - int(want[c]), int(want[c]), n, room, rng))
        if len(some):
            labels, k = sets.tally(some)
            want[labels] -= k * n
        labels, k = sets.tally(docs)
        left[labels] -= k
        lowest.set(labels, left[labels])
    docs = np.flatnonzero(free)
    deal(docs, second_share(len(docs), *room, 1, room, rng))

    got = int(second.sum())
    second[np.flatnonzero(second)[need:]] = False
    second[np.flatnonzero(pool & ~second)[: max(0, need - got)]] = True
    return second


def needs(targets: list[int], forced: list[int], pool: int) -> list[int]:
    """Records of the pool for each split. Where more are forced into a split than its target it gets none, and the others share the pool in proportion to what they lack."""
    lack = [max(0, t - f) for t, f in zip(targets, forced)]
    total = sum(lack)
    if total == pool:
        return lack
    got = [x * pool // total for x in lack]
    for i in sorted(range(len(lack)), key=lambda i: -(lack[i] * pool % total))[: pool - sum(got)]:
        got[i] += 1
    return got


def stratify(batches: Iterable[pa.RecordBatch], test: float, val: float, seed: int, rules: bool) -> Iterator[pa.RecordBatch]:
    """record_id, split of all records: forced ones, then test, then validation from what is left, then a record into train for each label that has none there. `rules`: an error if a rule for rare labels is broken."""
    with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
        sets = Sets(folder, batches)
        at, n = sets.forced, sets.n
        pool = at < 0
        targets = [round((1.0 - val - test) * n), round(val * n)]
        need = needs([*targets, n - sum(targets)], np.bincount(at[~pool], minlength=3).tolist(), int(pool.sum()))
        for s, by in ((2, seed), (1, seed + 1)):
            part = second_part(sets, pool, need[s], by)
            at[part] = s
            pool &= ~part
        at[pool] = 0

        count = np.stack([sets.counts(at == s) for s in range(3)])
        for c in np.flatnonzero(count[0] == 0).tolist():
            docs = sets.of(c)
            if not count[0, c] and len(docs):
                i = next(docs[at[docs] == s][0] for s in (1, 2) if count[s, c])
                labels = sets.codes[sets.ends[i] : sets.ends[i + 1]]
                count[at[i], labels] -= 1
                count[0, labels] += 1
                at[i] = 0
        total = count.sum(0)
        broken = (count[0] == 0) | (total > 1) & (count[2] == 0) | (total > 4) & (count[1] == 0)
        if rules and broken.any():
            raise ValueError(f"{int(broken.sum())} labels break a rule of placement")
        names = pa.array(SPLITS)
        for a in range(0, n, CHUNK // 4):
            b = min(a + CHUNK // 4, n)
            yield pa.RecordBatch.from_arrays([pa.array(sets.ids[a:b]), names.take(pa.array(at[a:b]))], ["record_id", "split"])
