"""Evaluation texts leaking into a corpus, by greedy string tiling.

Plan. The evaluation items are the query set. Their runs of `seed` words are a table of hashes; documents stream past it
in Arrow batches, and a document and an item that share a run are joined in it: all places of both. Shared runs are merged along diagonals into maximal matches, and the
pair is tiled: from long lengths down to `seed`, matches of that length whose words are still free are marked one after the other, and what is cut off by
a marked tile is searched again by running Karp-Rabin hashes. So reordered passages are all covered. Items go to the
executors in blocks whose size is checked (one broadcast a block, as many passes as blocks), so the set may grow without bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import spread
from .textkernel import BREAK, MIX1, Words, chunks, rejoin, windows

SCHEMA = "item_id bigint, doc_id bigint, tiles int, longest int, covered int, item_words int"
#: Words of items in one broadcast block: 8 bytes each for the words and 24 for their seeds.
BLOCK_WORDS = 2_000_000
#: Places that one search for shared runs lists at a time; more are searched with a longer run first.
PLACES = 2_000_000


def running(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words, each from two prefix hashes: H[i + k] - H[i] * b ** k."""
    power = np.full(len(h) + 1, MIX1)
    power[0] = 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(power)
        # prefix hashes scaled by falling powers, so that one running sum makes them
        inverse = np.full(len(h) + 1, np.uint64(pow(int(MIX1), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * inverse[:-1])))
        return (total[k:] - total[:-k]) * power[: len(h) - k + 1] if len(h) >= k else np.zeros(0, np.uint64)


def places(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) at which the same run of k words stands in a and in b, in the order of i - j and i."""
    ha, hb = running(a, k), running(b, k)
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, side="right")
    size = hi - lo
    i = np.repeat(np.arange(len(ha)), size)
    j = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    order = np.lexsort((i, i - j))
    return i[order], j[order]


def meetings(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many places of runs of k words there are."""
    x, n = np.unique(running(a, k), return_counts=True)
    y, m = np.unique(running(b, k), return_counts=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int((n[p] * m[q]).sum())


def matches(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches of at least k words: their starts in a and b and their lengths."""
    i, j = places(a, b, k)
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    return i[first], j[first], np.diff(np.append(first, len(i))) + k - 1


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in a, start in b, length) of non-overlapping matches, longest first.

    Of matches of one length the one earlier in a, then in b, is marked first. A match that meets marked words is cut to its free stretches of at least `least` words, which wait
    for their own turn. Sequences that repeat themselves have very many places: then only long runs are searched first, and shorter ones among the words left free.
    """
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    k = least
    while k < min(len(a), len(b)) and meetings(a, b, k) > PLACES:
        k = min(2 * k, len(a), len(b))
    while True:
        # marked words become words of their own, which match nothing
        free_a = np.where(used_a, np.arange(len(a), dtype=np.uint64) * np.uint64(2), a)
        free_b = np.where(used_b, np.arange(len(b), dtype=np.uint64) * np.uint64(2) + np.uint64(1), b)
        queue = [(-n, i, j) for i, j, n in zip(*(x.tolist() for x in matches(free_a, free_b, k)))]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            n = -n
            taken = used_a[i : i + n] | used_b[j : j + n]
            if not taken.any():
                used_a[i : i + n] = True
                used_b[j : j + n] = True
                tiles.append((i, j, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if y - x >= k:
                    heapq.heappush(queue, (x - y, i + x, j + x))
        if k == least:
            return tiles
        k = max(least, k // 2)


class Items:
    """A block of items prepared for seeding: word sequences and a sorted table of their runs."""

    def __init__(self, ids: list[int], texts: list[str], seed: int) -> None:
        words = Words([rejoin(t) for t in texts])
        self.ids = np.asarray(ids, np.int64)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        h, rec, _ = windows(words, seed)
        order = np.lexsort((rec, h))
        h, rec = h[order], rec[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
        self.hash, self.owner = h[new], rec[new]

    def candidates(self, h: np.ndarray, rec: np.ndarray) -> np.ndarray:
        """(text, item) of the runs that occur in an item, each once."""
        if not len(self.hash) or not len(h):
            return np.zeros((0, 2), np.int64)
        lo = np.searchsorted(self.hash, h)
        hit = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == h)
        if not len(hit):
            return np.zeros((0, 2), np.int64)
        lo = lo[hit]
        size = np.searchsorted(self.hash, h[hit], side="right") - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.unique(np.stack([np.repeat(rec[hit], size), self.owner[at]], axis=1), axis=0)


def scan(items: Items, ids: list[int], texts: list[str], seed: int) -> list[tuple[int, ...]]:
    """Tilings of a batch of documents with the items whose runs they hold."""
    rows: dict[tuple[int, int], tuple[int, ...]] = {}
    broken = [i for i, t in enumerate(texts) if BREAK.search(t)] if BREAK.search("\0".join(texts)) else []
    # a broken word may be one word or two: both readings are searched
    for which, variants in ((range(len(texts)), texts), (broken, [rejoin(texts[i]) for i in broken])):
        if not len(which):
            continue
        words = Words(variants)
        h, rec, _ = windows(words, seed)
        for r, k in items.candidates(h, rec):
            tiles = tile(items.words[k], words.hash[words.first[r] : words.first[r + 1]], seed)
            if tiles:
                row = (int(items.ids[k]), ids[which[r]], len(tiles), max(t[2] for t in tiles), sum(t[2] for t in tiles), len(items.words[k]))
                key = row[:2]
                rows[key] = max(rows.get(key, row), row, key=lambda x: x[4])
    return list(rows.values())


def leaks(documents: DataFrame, items: DataFrame, seed: int = 12, coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Item and document pairs that share passages: number of tiles, longest tile, words covered, words of the item.

    documents: doc_id, text; items: item_id, text; other columns are ignored. seed: fewest consecutive words of a passage. coverage: least share of
    the item's words that the tiles cover. Null ids and null or empty texts take no part; an item or a document of fewer words than `seed` has no pair;
    rows given more than once count once.
    """
    docs = spread(documents.select("doc_id", "text").where("doc_id is not null and text <> ''"))
    spark = documents.sparkSession
    sized = items.select("item_id", "text").where("item_id is not null and text <> ''").distinct()
    # a running total by item would need one task: blocks are cut by hash instead, enough of them for the bound
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 4)))
    out = None
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], seed))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i, j in chunks(texts):
                    found = scan(block.value, ids[i:j], texts[i:j], seed)
                    if found:
                        cols = list(zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], names=["item_id", "doc_id", "tiles", "longest", "covered", "item_words"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("covered") >= F.lit(coverage) * F.col("item_words")).dropDuplicates(["item_id", "doc_id"])


def leaked_items(documents: DataFrame, items: DataFrame, **params: float) -> DataFrame:
    """For each item that leaked: documents, longest passage and greatest share of its words in one document."""
    return leaks(documents, items, **params).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"), F.round(F.max(F.col("covered") / F.col("item_words")), 4).alias("most_covered"))
