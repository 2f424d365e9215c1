"""Label set expressions over nested groups of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<string>"


def groups(c: Column | str) -> Column:
    """Groups without null groups and null codes; null becomes no group, an empty group stays."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.transform(F.filter(col, lambda g: g.isNotNull()), lambda g: F.filter(g, lambda x: x.isNotNull())), F.array().cast("array<array<string>>"))


def flatten_labels(c: Column | str) -> Column:
    """Sorted distinct codes of all groups, blank and null ones dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(groups(c)), lambda x: F.trim(x) != "")))


def first_seen(c: Column | str) -> Column:
    """Distinct codes of all groups in order of appearance."""
    return F.array_distinct(F.flatten(groups(c)))


def multi_hot(codes: Column, labels: list[str]) -> Column:
    """0/1 for each label of an ordered label space; other codes are ignored."""
    return F.transform(F.array(*map(F.lit, labels)), lambda x: F.array_contains(codes, x).cast("int"))


def singletons(codes: Column) -> Column:
    """Sorted distinct codes, each as a group of its own: the form in which predictions are stored."""
    return F.transform(F.array_sort(F.array_distinct(codes)), lambda x: F.array(x))


def close(codes: Column, rules: list[tuple[list[str], list[str]]]) -> Column:
    """One ordered pass of (if any, then add) rules; later rules see earlier additions."""
    for any_of, add in rules:
        codes = F.when(F.arrays_overlap(codes, F.array(*map(F.lit, any_of))), F.array_union(codes, F.array(*map(F.lit, add)))).otherwise(codes)
    return codes


def boost(norm: Column, codes: Column, rules: list[tuple[list[str], list[str]]]) -> Column:
    """Codes added where any pattern is a substring of the normalized text."""
    for patterns, add in rules:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(norm, F.lit(p))
        codes = F.when(hit, F.array_union(codes, F.array(*map(F.lit, add)))).otherwise(codes)
    return codes


def band(n: Column) -> Column:
    """Frequency band of a label's count."""
    return F.when(n >= 500, ">=500").when(n >= 100, "100-499").when(n >= 10, "10-99").otherwise("<10")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 where nothing is there."""
    return ratio(2 * tp, 2 * tp + fp + fn)
