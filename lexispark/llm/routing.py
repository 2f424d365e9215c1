"""Which texts of two sides may share so many of their runs: an exact prefix filter whose data move as packed numbers.

A text with n distinct runs has to share `need` = share * n of them with a larger one. Of its runs that also stand on the other side any
need - hits may be left out: whatever shares `need` holds `hits` of the others. So a text sends its rarest shared runs, and nothing is lost or capped.

Runs that very many texts hold (boilerplate of a third of all records, say) are spread over buckets by their holders' flushes; they are left out first, and a text
that has to send one all the same sends it to each of these buckets.

Four shuffles, each of arrays: (1) texts of a task are gathered into flushes; a flush sends each bucket of hash values the runs of its texts, 4 bytes each.
(2) A bucket knows who holds each run. It keeps the holders and tells each flush how frequent the runs of its texts are, one byte each. (3) A flush settles for every
text which runs are left out and tells the buckets. (4) A bucket sends each sender's flush the holders of what was sent; the flush adds them up.

Large collections take (4) in passes, each for a part of the flushes: its shuffle is removed before the next one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import release, stage
from .textkernel import MIX1, Words, chunks, mix, windows

RUN = 5
#: Runs of one flush, and texts at most (their numbers in it take 16 bits); runs that one bucket receives.
FLUSH_RUNS, FLUSH_TEXTS, BUCKET_RUNS = 2_000_000, 1 << 16, 2_000_000
#: Characters of a text for each run, about: only for the number of buckets.
RUN_CHARS = 6
#: Met pairs that are held at once.
MET = 4_000_000
#: Characters of a collection for each pass of meeting: what is met grows faster than the input, what one pass writes in proportion.
PASS_CHARS = 700_000_000
PACKED = "kind int, bucket int, flush bigint, data binary"
POSTINGS, FREQUENCIES, TEXTS, CHOICE, HOLDERS, VISITS = range(6)
#: Holders of a run from which on it is spread over several buckets, as many for each; texts of the sample that finds such runs, and how many of them may be found.
HOT_HOLDERS, HOT_SAMPLE, HOT_RUNS = 4_000_000, 20_000, 10_000_000
#: The class of runs that are spread: more frequent than any other.
HOT = 255


def signature(words: Words) -> np.ndarray:
    """A 64-bit hash of each text's word sequence."""
    with np.errstate(over="ignore"):
        sig = np.zeros(words.n, np.uint64)
        if len(words.hash):
            some = np.flatnonzero(np.diff(words.first))
            within = (np.arange(len(words.hash)) - words.first[words.rec]).astype(np.uint64)
            sig[some] = np.add.reduceat(mix(words.hash + within * MIX1), words.first[some])
        return mix(sig + np.diff(words.first).astype(np.uint64))


def distinct(h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of each text once, by text and value."""
    order = np.lexsort((h, rec))
    h, rec = h[order], rec[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
    return h[new], rec[new]


def _pack(*arrays: np.ndarray | list) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _within(first: np.ndarray, n: int) -> np.ndarray:
    """Position of each of n rows in its group."""
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "flush", "data"])


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 16 bits of numbers and the rest of them, which often takes less than 16."""
    return (x & 0xFFFF).astype(np.uint16), _small(x >> 16)


def _join(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.uint16)


def _undo(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype(np.int64))


class Spread:
    """Runs (hash, sorted) that are spread, and over how many buckets behind the ordinary ones."""

    def __init__(self, run: np.ndarray, salts: np.ndarray, buckets: int) -> None:
        self.run, self.salts, self.buckets = run, salts, buckets

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each run, -1 for those that aren't spread."""
        if not len(self.run):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.run, h), len(self.run) - 1)
        return np.where(self.run[at] == h, at, -1)

    def bucket(self, index: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.buckets + (mix(self.run[index] + (salt % self.salts[index]).astype(np.uint64) * MIX1) % np.uint64(self.buckets)).astype(np.int64)

    def all(self, seed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each bucket that holders of runs (low 32 bits) are in, once for a run and owner: bucket, seed, owner. Runs alike in these bits go to the buckets of all of them."""
        low = self.run.astype(np.uint32)
        order = np.argsort(low, kind="stable")
        a, b = np.searchsorted(low[order], seed), np.searchsorted(low[order], seed, side="right")
        pick = np.repeat(np.arange(len(seed)), b - a)
        index = order[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
        salts = self.salts[index]
        each = np.repeat(np.arange(len(index)), salts)
        bucket = self.bucket(index[each], _within(np.cumsum(salts) - salts, int(salts.sum())))
        rows = np.unique(np.stack([bucket, seed[pick[each]].astype(np.int64), owner[pick[each]].astype(np.int64)], axis=1), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]


class _Flush:
    """Texts gathered until they have FLUSH_RUNS runs; of equal texts of one side only the first sends its runs."""

    def __init__(self, number: int, buckets: int, spread: Spread | None = None) -> None:
        self.number, self.buckets, self.spread = number, buckets, spread
        self.seen: dict[tuple[int, int], int] = {}
        self.members: list[np.ndarray] = []
        self.owner: list[int] = []
        self.size: list[int] = []
        self.hash: list[np.ndarray] = []
        self.rec: list[np.ndarray] = []
        self.runs = 0

    def add(self, ids: np.ndarray, sides: np.ndarray, words: Words) -> None:
        h, rec = distinct(*windows(words, RUN)[:2])
        n = np.bincount(rec, minlength=words.n)
        some = np.flatnonzero(n)
        sig = signature(words).view(np.int64)
        number = np.full(words.n, -1, np.int64)
        for i in some.tolist():
            key = (int(sig[i]), int(sides[i]))
            k = self.seen.setdefault(key, len(self.seen))
            self.owner.append(k)
            if k == len(self.size):
                self.size.append(int(n[i]))
                number[i] = k
        self.members.append(ids[some])
        keep = number[rec] >= 0
        self.hash.append(h[keep])
        self.rec.append(number[rec[keep]].astype(np.uint32))
        self.runs += int(keep.sum())

    @property
    def full(self) -> bool:
        return self.runs >= FLUSH_RUNS or len(self.seen) > FLUSH_TEXTS - 5_000

    def rows(self) -> Iterator[tuple]:
        keys = np.array(list(self.seen), np.int64).reshape(-1, 2)
        yield TEXTS, -1, self.number, _pack(keys[:, 0], keys[:, 1].astype(np.uint8), np.array(self.size, np.uint32), np.concatenate(self.members), np.array(self.owner, np.uint32))
        h, rec = np.concatenate(self.hash), np.concatenate(self.rec)
        bucket = ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.uint32)
        if self.spread is not None:
            hot = self.spread.find(h)
            at = np.flatnonzero(hot >= 0)
            salt = int(mix(np.array([self.number], np.uint64))[0] >> np.uint64(1))
            bucket[at] = self.spread.bucket(hot[at], np.full(len(at), salt, np.int64))
        order = np.argsort(bucket.astype(np.uint16) if 2 * self.buckets <= 1 << 16 else bucket, kind="stable")
        bucket, rec, seed = bucket[order], rec[order], h[order].astype(np.uint32)
        side = keys[:, 1].astype(np.uint8)
        first = _groups(bucket)
        for a, b in zip(first, np.append(first[1:], len(bucket))):
            at = _groups(rec[a:b])
            own = rec[a:b][at]
            yield POSTINGS, int(bucket[a]), self.number, _pack(_deltas(own), _small(np.diff(np.append(at, b - a))), side[own], seed[a:b], len(keys))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "bucket", "flush", "data"])


def _send(buckets: int, spread: Broadcast | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        hot = spread.value if spread is not None else None
        flush = _Flush(number, buckets, hot)
        for b in batches:
            ids, sides, texts = (b.column(i).to_pylist() for i in range(3))
            for i, j in chunks(texts):
                for k in range(i, j, 5_000):
                    to = min(j, k + 5_000)
                    flush.add(np.array(ids[k:to], np.int64), np.array(sides[k:to], np.int64), Words(texts[k:to]))
                    if flush.full:
                        yield from (_batch([r]) for r in flush.rows())
                        number += 1
                        flush = _Flush(number, buckets, hot)
        if flush.seen:
            yield from (_batch([r]) for r in flush.rows())

    return run


def _bucket(buckets: int):
    return lambda key, rows: _hold(key, rows, buckets)


def _hold(key: tuple, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Holders of the runs that stand on both sides, and for each flush how frequent each is on the other side.

    Of runs that are spread a bucket knows a part of the holders only: they count as standing on both sides, and the flush is told which they are.
    """
    if key[0] < 0:
        return rows[["kind", "bucket", "flush", "data"]]
    rows = rows.sort_values("flush")
    flushes, bases, parts = rows["flush"].to_numpy(), [], []
    base = 0
    for data in rows["data"]:
        own, count, side, seed, texts = pickle.loads(data)
        own = _undo(own)
        parts.append((seed, np.repeat(own + base, count), np.repeat(side, count)))
        bases.append(base)
        base += texts
    seed, owner, side = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((side, seed))
    seed, owner, side = seed[order], owner[order], side[order]
    first = _groups(seed)
    size = np.diff(np.append(first, len(seed)))
    train = np.add.reduceat((side == 1).astype(np.int64), first) if len(first) else size
    spread = key[0] >= buckets
    both = (train > 0) & (train < size) | spread
    keep = np.repeat(both, size)
    owner, side, size, train, seed = owner[keep], side[keep], size[both], train[both], seed[keep]
    names = seed[np.cumsum(size) - size] if spread else seed[:0]
    out = [(POSTINGS, int(key[0]), -1, _pack(flushes, np.array(bases, np.int64), _planes(owner), _small(size), _small(train), names))]
    frequent = np.full(len(owner), HOT, np.uint8) if spread else _class(np.where(side == 1, np.repeat(size - train, size), np.repeat(train, size)))
    order = np.argsort(owner, kind="stable")
    owner, frequent, seed = owner[order], frequent[order], seed[order]
    cut = np.searchsorted(owner, [*bases, base])
    for f, at, a, b in zip(flushes, bases, cut[:-1], cut[1:]):
        if b > a:
            first = _groups(owner[a:b])
            out.append((FREQUENCIES, int(key[0]), int(f), _pack(_deltas(owner[a:b][first] - at), _small(np.diff(np.append(first, b - a))), frequent[a:b], seed[a:b] if spread else seed[:0])))
    return _frame(out)


def _class(n: np.ndarray) -> np.ndarray:
    """1 for one, three more for each doubling."""
    return np.minimum(1 + np.floor(3 * np.log2(np.maximum(n, 1))), HOT - 1).astype(np.uint8)


def _settle(share: float, hits: int, spread: Broadcast | None = None):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each text of a flush and each bucket: the class from which on its runs are left out, and how many of that class are."""
        texts = rows["data"][rows["kind"] == TEXTS].iloc[0]
        _, sides, n, _, _ = pickle.loads(texts)
        n = n.astype(np.int64)
        need = np.maximum(1, np.ceil(share * n - 1e-9)).astype(np.int64)
        quota = need - np.minimum(hits, need)
        told = rows[rows["kind"] == FREQUENCIES].sort_values("bucket")
        parts = [(k, _undo(own), count, cls, seed) for k, (own, count, cls, seed) in zip(told["bucket"], map(pickle.loads, told["data"]))]
        whole = np.zeros((len(n), 256), np.int32)
        for _, own, count, cls, _ in parts:
            np.add.at(whole, (np.repeat(own, count), cls), 1)
        alive = whole.sum(1) >= need
        # from the most frequent class down: all of a class while the quota lasts, then a part of the next one
        above = np.cumsum(whole[:, ::-1], axis=1)[:, ::-1]
        level = np.maximum((above > quota[:, None]).sum(1) - 1, 0)
        left = np.maximum(0, quota - np.where(level < 255, above[np.arange(len(n)), np.minimum(level + 1, 255)], 0))
        gone = np.minimum(above[:, 0], quota)
        out = [(CHOICE, -1, int(key[0]), _pack((need - gone).astype(np.int32)))]
        visits: list[tuple[np.ndarray, np.ndarray]] = []
        for k, own, count, cls, seed in parts:
            here = np.bincount(np.repeat(np.arange(len(own)), count)[cls == np.repeat(level[own], count)], minlength=len(own))
            drop = np.minimum(here, left[own])
            left[own] -= drop
            if len(seed):
                # what has to be sent all the same of spread runs visits all their buckets; here they are only held
                who = np.repeat(own, count)
                stays = alive[who] & (level[who] == HOT) & (_within(np.cumsum(count.astype(np.int64)) - count, len(who)) >= np.repeat(drop, count))
                visits.append((seed[stays], who[stays]))
            settled = np.where(alive, level, 0)[own] if not len(seed) else np.zeros(len(own), np.int64)
            out.append((CHOICE, int(k), int(key[0]), _pack(_deltas(own), settled.astype(np.uint8), _small(drop), _small(n[own]))))
        if visits and sum(len(v[0]) for v in visits):
            bucket, seed, who = spread.value.all(*(np.concatenate(x) for x in zip(*visits)))
            first = _groups(bucket)
            for a, b in zip(first, np.append(first[1:], len(bucket))):
                out.append((VISITS, int(bucket[a]), int(key[0]), _pack(seed[a:b].astype(np.uint32), who[a:b].astype(np.uint16), sides[who[a:b]], n[who[a:b]])))
        return _frame(out)

    return run


def _pass_of(flush: int, passes: int) -> int:
    return int(mix(np.array([flush], np.uint64))[0] % np.uint64(passes))


def _meeting(now: int, passes: int):
    return lambda key, posted, chosen: _meet(key, posted, chosen, now, passes)


def _meet(key: tuple, posted: pd.DataFrame, chosen: pd.DataFrame, now: int = 0, passes: int = 1) -> pd.DataFrame:
    """For each flush of the pass the senders among its texts with the larger texts of the other side that hold a run they sent."""
    if not len(posted) or not len(chosen):
        return _frame([])
    flushes, bases, owner, size, train, names = pickle.loads(posted["data"].iloc[0])
    owner, size, train = _join(*owner), size.astype(np.int64), train.astype(np.int64)
    base_of = dict(zip(flushes.tolist(), bases.tolist()))
    parts = []
    visits = chosen[(chosen["kind"] == VISITS) & chosen["flush"].map(lambda f: _pass_of(f, passes) == now).astype(bool)]
    chosen = chosen[chosen["kind"] == CHOICE]
    for f, data in zip(chosen["flush"], chosen["data"]):
        own, level, drop, n = pickle.loads(data)
        parts.append((_undo(own) + base_of[f], level, drop, n))
    text, level, drop, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(text)
    text, level, drop, n = text[order], level[order], drop[order], n[order]
    at = np.searchsorted(text, owner)
    first = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    side = np.where(_within(first, len(owner)) < train[group], 1, 2)
    cls = _class(np.where(side == 1, (size - train)[group], train[group]))
    part = np.flatnonzero(cls == level[at])
    part = part[np.argsort(at[part], kind="stable")]
    kept = part[_within(_groups(at[part]), len(part)) >= drop[at[part]]] if len(part) else part
    sends = cls < level[at]
    sends[kept] = True
    sender = np.flatnonzero(sends)
    lo = np.where(side[sender] == 1, (first + train)[group[sender]], first[group[sender]])
    count = np.where(side[sender] == 1, (size - train)[group[sender]], train[group[sender]])
    order = np.argsort(owner[sender], kind="stable")
    sender, lo, count = sender[order], lo[order], count[order]
    cut = np.searchsorted(owner[sender], bases)
    out = _visited(key, visits, flushes, bases, owner, at, n, first, size, train, names)
    for i, f in enumerate(flushes):
        if _pass_of(f, passes) != now:
            continue
        a, b = cut[i], cut[i + 1] if i + 1 < len(cut) else len(sender)
        total = np.cumsum(count[a:b])
        while a < b:
            # as many senders as meet MET holders, one at least
            stop = a + max(1, int(np.searchsorted(total, MET, side="right")))
            c = count[a:stop]
            held = np.repeat(lo[a:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            by = np.repeat(sender[a:stop], c)
            larger = (n[at[held]] > n[at[by]]) | ((n[at[held]] == n[at[by]]) & (side[by] == 1))
            by, held = by[larger], held[larger]
            if len(by):
                begin = _groups(owner[by])
                out.append((HOLDERS, int(key[0]), int(f), _pack(flushes, bases, _deltas(owner[by][begin] - bases[i]), _small(np.diff(np.append(begin, len(by)))), _planes(owner[held]))))
            a, total = stop, np.cumsum(count[stop:b])
    return _frame(out)


def _visited(key: tuple, visits: pd.DataFrame, flushes: np.ndarray, bases: np.ndarray, owner: np.ndarray, at: np.ndarray, n: np.ndarray, first: np.ndarray, size: np.ndarray, train: np.ndarray, names: np.ndarray) -> list[tuple]:
    """What texts of other flushes meet that visit this bucket for its spread runs (names, in rising order): rows as of _meet."""
    out = []
    for f, data in zip(visits["flush"], visits["data"]):
        seed, who, side, own = pickle.loads(data)
        where = np.minimum(np.searchsorted(names, seed), max(0, len(names) - 1))
        here = np.flatnonzero(names[where] == seed) if len(names) else np.zeros(0, np.int64)
        here = here[np.argsort(who[here], kind="stable")]
        where, who, side, own = where[here], who[here].astype(np.int64), side[here], own[here]
        lo = np.where(side == 1, (first + train)[where], first[where])
        count = np.where(side == 1, (size - train)[where], train[where])
        a, total = 0, np.cumsum(count)
        while a < len(who):
            stop = a + max(1, int(np.searchsorted(total, MET, side="right")))
            c = count[a:stop]
            held = np.repeat(lo[a:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            by = np.repeat(np.arange(a, min(stop, len(who))), c)
            larger = (n[at[held]] > own[by]) | ((n[at[held]] == own[by]) & (side[by] == 1))
            by, held = by[larger], held[larger]
            if len(by):
                begin = _groups(who[by])
                out.append((HOLDERS, int(key[0]), int(f), _pack(flushes, bases, _deltas(who[by][begin]), _small(np.diff(np.append(begin, len(by)))), _planes(owner[held]))))
            a, total = stop, np.cumsum(count[stop:])
    return out


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a sender of the flush and a holder that met often enough."""
    cols = ["flush_a", "number_a", "flush_b", "number_b"]
    least = [pickle.loads(d)[0] for d in rows["data"][rows["kind"] == CHOICE]]
    met = [pickle.loads(d) for d in rows["data"][rows["kind"] == HOLDERS]]
    if not met or not least:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
    flushes = np.unique(np.concatenate([m[0] for m in met]))
    width = np.int64(len(flushes)) << 16
    keys = []
    for own, bases, who, count, held in met:
        held = _join(*held)
        k = np.searchsorted(bases, held, side="right") - 1
        keys.append(np.repeat(_undo(who), count) * width + (np.searchsorted(flushes, own[k]) << 16) + (held - bases[k]))
    pair = np.sort(np.concatenate(keys))
    first = _groups(pair)
    n = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    pair = pair[n >= least[0][pair // width]]
    b = pair % width
    return pd.DataFrame({"flush_a": np.full(len(pair), key[0], np.int64), "number_a": pair // width, "flush_b": flushes[b >> 16], "number_b": b & 0xFFFF})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for flush, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sig, side, n, ids, owner = pickle.loads(data)
            yield pa.RecordBatch.from_pydict({"flush": pa.array(np.full(len(ids), flush, np.int64)), "number": pa.array(owner.astype(np.int64)), "record_id": pa.array(ids), "sig": pa.array(sig[owner]), "side": pa.array(side[owner].astype(np.int32)), "runs": pa.array(n[owner].astype(np.int32))})


def _often(texts: DataFrame, n: int, buckets: int) -> Broadcast | None:
    """Runs that more than HOT_HOLDERS texts hold, as estimated from HOT_SAMPLE of them: an estimate decides only where a run is counted, not whether. None in collections too small for one."""
    if n <= HOT_HOLDERS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_pylist()
            for i, j in chunks(t):
                yield pa.RecordBatch.from_arrays([pa.array(distinct(*windows(Words(t[i:j]), RUN)[:2])[0].view(np.int64))], names=["run"])

    every = max(1, n // HOT_SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("record_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "run bigint")
    rows = sample.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") * every > HOT_HOLDERS).limit(HOT_RUNS + 1).collect()
    if len(rows) > HOT_RUNS:
        raise ValueError(f"more than {HOT_RUNS} runs with more than {HOT_HOLDERS} holders")
    h = np.array([r["run"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    salts = np.array([1 + r["n"] * every // HOT_HOLDERS for r in rows], np.int64)
    return texts.sparkSession.sparkContext.broadcast(Spread(h[order], salts[order], buckets))


def routes(texts: DataFrame, share: float, hits: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (flush_a, number_a, flush_b, number_b) on two sides, the smaller text first, and texts (flush, number, record_id, sig, side, runs).

    texts: record_id, side (1 or 2), text. Texts of one flush, side and word sequence have one number.
    """
    chars, n = texts.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-chars // (RUN_CHARS * BUCKET_RUNS)))
    spread = _often(texts, n, buckets)
    sent = texts.mapInArrow(_send(buckets, spread), PACKED)
    # the texts of each flush go through as groups of their own
    group = F.when(F.col("kind") == TEXTS, -1 - F.pmod(F.xxhash64("flush"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    known = stage(sent.withColumn("group", group).groupBy("group").applyInPandas(_bucket(buckets), PACKED), "routes-buckets")
    chosen = stage(known.where(F.col("kind").isin(FREQUENCIES, TEXTS)).groupBy("flush").applyInPandas(_settle(share, hits, spread), PACKED), "routes-choice")
    posted = known.where(F.col("kind") == POSTINGS)
    passes = max(1, -(-chars // PASS_CHARS))
    parts = []
    for k in range(passes):
        met = posted.groupBy("bucket").cogroup(chosen.where("bucket >= 0").groupBy("bucket")).applyInPandas(_meeting(k, passes), PACKED)
        part = met.unionByName(chosen.where("bucket < 0")).groupBy("flush").applyInPandas(_count, "flush_a bigint, number_a bigint, flush_b bigint, number_b bigint")
        if passes > 1:
            part = stage(part, "routes-pairs")
            del met
            release(texts.sparkSession)
        parts.append(part)
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs, known.where(F.col("kind") == TEXTS).select("flush", "data").mapInArrow(_texts, "flush bigint, number bigint, record_id bigint, sig bigint, side int, runs int")
