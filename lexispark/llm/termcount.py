"""Frequency of every term sequence up to a length, by sorting truncated suffixes.

Plan. Each record's term sequence gives one suffix for each position, cut at `longest` terms. With it goes a depth: how many of its first
terms already began an earlier suffix of the same record. That depth stands for the record set (prefixes beyond it are new to the record),
so equal suffixes are added up before they are shuffled, and no list of records is ever gathered. Suffixes are
routed by ranges of their terms, first term first, so that a hot first term is split; each range is sorted in reverse-lexicographic
order and one pass with a stack emits all prefix counts. Prefixes that lie in two ranges are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct suffixes that a task holds before it passes them on.
HELD = 200_000
GRAMS = "gram array<string>, n int, occurrences bigint, records bigint"


def suffixes(terms: list[str], longest: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """Truncated suffixes of one record with the depth up to which each repeats an earlier one."""
    seen: set[tuple[str, ...]] = set()
    for i in range(len(terms)):
        s = tuple(terms[i : i + longest])
        depth = 0
        while depth < len(s) and s[: depth + 1] in seen:
            depth += 1
        seen.update(s[:k] for k in range(depth + 1, len(s) + 1))
        yield s, depth


def stack_counts(rows: Iterator[tuple[list[str], int, int]]) -> Iterator[tuple[list[str], int, int]]:
    """Counts of all prefixes of sorted suffixes (suffix, depth, n): gram, occurrences, records.

    Equal neighbouring prefixes are on the stack once; a prefix is emitted when the order leaves it.
    """
    path: list[str] = []
    occurrences: list[int] = []
    records: list[int] = []

    def pop() -> tuple[list[str], int, int]:
        gram, o, r = list(path), occurrences.pop(), records.pop()
        path.pop()
        if occurrences:
            occurrences[-1] += o
        return gram, o, r

    for suffix, depth, n in rows:
        same = 0
        while same < min(len(path), len(suffix)) and path[same] == suffix[same]:
            same += 1
        while len(path) > same:
            yield pop()
        for t in suffix[same:]:
            path.append(t)
            occurrences.append(0)
            records.append(0)
        if path:
            occurrences[-1] += n
            for k in range(depth, len(suffix)):
                records[k] += n
    while path:
        yield pop()


def gram_counts(records: DataFrame, terms: str, longest: int = 2) -> DataFrame:
    """gram, n (terms), occurrences, records for every sequence of up to `longest` neighbouring terms.

    records: one row for each record with an array of strings; null and empty arrays have no term, null terms must be filtered before; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[tuple[str, ...], int], int] = {}

        def out() -> pa.RecordBatch:
            x = pa.RecordBatch.from_arrays([pa.array([list(s) for s, _ in held], pa.list_(pa.string())), pa.array([d for _, d in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["suffix", "depth", "n"])
            held.clear()
            return x

        for b in batches:
            for seq in b.column(0).to_pylist():
                for k in suffixes(seq, longest):
                    held[k] = held.get(k, 0) + 1
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list[str], int, int]]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        block: list[tuple[list[str], int, int]] = []

        def out() -> pa.RecordBatch:
            x = pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in block], pa.list_(pa.string())), pa.array([len(g) for g, _, _ in block], pa.int32()), pa.array([o for _, o, _ in block], pa.int64()), pa.array([r for _, _, r in block], pa.int64())], names=["gram", "n", "occurrences", "records"])
            block.clear()
            return x

        for g in stack_counts(rows()):
            block.append(g)
            if len(block) >= 20_000:
                yield out()
        if block:
            yield out()

    cuts = records.select(terms).where(F.size(terms) > 0).mapInArrow(cut, "suffix array<string>, depth int, n bigint")
    cuts = cuts.groupBy("suffix", "depth").agg(F.sum("n").alias("n"))
    ranges = cuts.repartitionByRange(F.desc("suffix")).sortWithinPartitions(F.desc("suffix"))
    parts = ranges.mapInArrow(count, GRAMS)
    return parts.groupBy("gram").agg(F.max("n").alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def clean_code(c: Column) -> Column:
    """A code without blanks around it, in upper case."""
    return F.upper(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def record_codes(records: DataFrame) -> DataFrame:
    """record_id, codes: those of labels_flat, or of all groups where it is null, cleaned; each record once, blank and null codes dropped."""
    groups = F.flatten(F.filter("document_level_annotations", lambda g: g.isNotNull()))
    codes = F.filter(F.transform(F.coalesce("labels_flat", groups), clean_code), lambda c: c != "")
    return records.where("record_id is not null").select("record_id", codes.alias("codes")).groupBy("record_id").agg(F.first("codes", ignorenulls=True).alias("codes"))


def code_marks(records: DataFrame, frequencies: DataFrame, longest: int = 1, rare: int = 3, common: float = 0.2) -> DataFrame:
    """code, occurrences, records, mark for every code of the records or of the older report: rare, common or null.

    A code of the report that no record holds has zero counts and is rare. Without any record with a code, no code is common.
    """
    codes = record_codes(records)
    counts = gram_counts(codes, "codes", longest).where("n = 1").select(F.col("gram")[0].alias("code"), "occurrences", "records")
    total = codes.where(F.size("codes") > 0).agg(F.count("*").alias("total"))  # one row
    listed = frequencies.select(clean_code(F.col("code")).alias("code")).where("code <> ''").distinct()
    every = counts.join(listed, "code", "full_outer").na.fill(0, ["occurrences", "records"])
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common) * F.col("total"), "common")
    return every.join(F.broadcast(total)).select("code", "occurrences", "records", mark.alias("mark"))


# Codes of each record in SQL, for p4 and p5.
CODES_SQL = """
with once as (select record_id, any_value(labels_flat) as labels_flat, any_value(document_level_annotations) as groups from records where record_id is not null group by record_id),
listed as (select record_id, unnest(case when labels_flat is null then flatten(list_filter(groups, lambda g: g is not null)) else labels_flat end) as c from once),
codes as (select record_id, upper(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) as code from listed where c is not null and regexp_replace(c, '^\\s+|\\s+$', '', 'g') <> '')
"""
FOUND_SQL = (
    CODES_SQL
    + """, n as (select count(distinct record_id) as n from codes),
f as (select code, count(distinct record_id) as records from codes group by code),
every as (select code from codes union select upper(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) from label_frequency where code is not null and trim(code) <> '')
select code, case when coalesce(records, 0) < 3 then 'rare' else 'common' end as mark
from every left join f using (code), n where coalesce(records, 0) < 3 or 5 * records > n.n"""
)
COUNTS_SQL = (
    CODES_SQL
    + """, f as (select code, count(*) as occurrences, count(distinct record_id) as records from codes group by code)
select code, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records from f"""
)
