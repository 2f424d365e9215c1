"""Filling fixed-capacity containers with texts: bounded-space online best-fit.

Plan. Texts are measured in tokens inside Arrow batches and packed where they lie: every task keeps a fixed number of open containers for each budget,
found through a bitset keyed by free space (the least free space that still holds the text wins); when all are open and none fits, the fullest is closed. What is
still open when a task ends goes, text by text, to a second level that packs hashed groups of such remainders, so small tasks waste
no space. Only (budget, text id, size) leaves a task. A text is divided only if it alone exceeds the capacity; its full pieces are containers of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import checked_broadcast, spread, stage

SCHEMA = "budget_id int, container string, doc_id bigint, piece int, tokens int, closed boolean"
#: Remainders that one task of the second level packs.
GROUP = 200_000
#: Budgets that one call packs for: each task keeps open containers of all of them. More are an error.
BUDGETS = 1000


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """A byte-pair encoder from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BestFit:
    """Open containers of one capacity in a bitset keyed by free space.

    add() returns the containers that it closes, each a list of items (key, size).
    """

    def __init__(self, capacity: int, most: int = 64) -> None:
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.bins: dict[int, list[list[tuple[object, int]]]] = {}
        self.open = 0

    def _take(self, free: int) -> list[tuple[object, int]]:
        at = self.bins[free]
        items = at.pop()
        if not at:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return items

    def _put(self, free: int, items: list[tuple[object, int]]) -> None:
        self.bins.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.open += 1

    def add(self, key: object, size: int) -> list[list[tuple[object, int]]]:
        if size > self.capacity:
            raise ValueError("an item beyond the capacity has to be divided first")
        closed: list[list[tuple[object, int]]] = []
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            free, items = self.capacity, []
            if self.open == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        items.append((key, size))
        if free == size:
            closed.append(items)
        else:
            self._put(free - size, items)
        return closed

    def rest(self) -> list[list[tuple[object, int]]]:
        """The containers still open, fullest first."""
        return [x for free in sorted(self.bins) for x in self.bins[free]]


def pieces(tokens: int, capacity: int) -> list[int]:
    """Sizes into which a text is divided: itself if it fits, else full pieces and a remainder."""
    full, last = divmod(tokens, capacity)
    return [tokens] if tokens <= capacity else [capacity] * full + [last] * (last > 0)


def pack(documents: DataFrame, budgets: DataFrame, path: str, pattern: str, most: int = 64) -> DataFrame:
    """budget_id, container, doc_id, piece, tokens: where each piece of each text goes.

    documents: doc_id, text; budgets: budget_id, capacity_tokens, reserved_tokens (a few rows); other columns are ignored. path: token ranks, pattern: their word pattern. Null ids and
    null or empty texts take no part; every row with a text is packed, repeated texts too. Budgets whose capacity isn't above what they reserve are an error.
    """
    given = budgets.select("budget_id", "capacity_tokens", "reserved_tokens").distinct().limit(BUDGETS + 1).collect()
    if len(given) > BUDGETS:
        raise ValueError(f"more than {BUDGETS} budgets")
    caps = {r["budget_id"]: r["capacity_tokens"] - (r["reserved_tokens"] or 0) for r in given}
    if any(c <= 0 for c in caps.values()):
        raise ValueError("a budget has no room")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["budget_id", "container", "doc_id", "piece", "tokens", "closed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        enc = encoder(path, pattern)
        packers = {b: BestFit(c, most) for b, c in caps.items()}
        number = dict.fromkeys(caps, 0)
        rows: list[tuple] = []

        def emit(b: int, items: list[tuple[object, int]], closed: bool) -> None:
            name = f"a{task}-{number[b]}"
            number[b] += 1
            rows.extend((b, name, k[0], k[1], n, closed) for k, n in items)

        for x in batches:
            for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                size = len(enc.encode_ordinary(text))
                for b, p in packers.items():
                    for i, n in enumerate(pieces(size, caps[b])):
                        for items in p.add((doc, i), n):
                            emit(b, items, True)
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows.clear()
        for b, p in packers.items():
            for items in p.rest():
                emit(b, items, False)
        if rows:
            yield batch(rows)

    def again(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b, g = key
        p = BestFit(caps[b], most)
        part = part.sort_values(["doc_id", "piece"])  # online as in the first level: the order is the texts', not their sizes'
        done = [c for d, i, n in zip(part["doc_id"], part["piece"], part["tokens"]) for c in p.add((d, i), int(n))] + p.rest()
        return pd.DataFrame([(b, f"b{g}-{k}", d, i, n) for k, items in enumerate(done) for (d, i), n in items], columns=["budget_id", "container", "doc_id", "piece", "tokens"])

    placed = stage(spread(documents.select("doc_id", "text").where("doc_id is not null and text <> ''")).mapInArrow(run, SCHEMA), "packing")
    rest = placed.where("not closed")
    groups = max(1, rest.count() // GROUP)
    second = rest.groupBy("budget_id", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")).applyInPandas(again, "budget_id int, container string, doc_id bigint, piece int, tokens int")
    return placed.where("closed").select("budget_id", "container", "doc_id", "piece", "tokens").unionByName(second)


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each budget: containers, texts, tokens, share of the capacity used."""
    per = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("used"))
    caps = budgets.select("budget_id", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).alias("room")).distinct()
    return per.join(checked_broadcast(caps), "budget_id").groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("room"), 4).alias("filled"))
