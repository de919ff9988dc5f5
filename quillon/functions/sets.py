"""Scores of sets and multisets held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def clean_set(c: Column) -> Column:
    """Distinct trimmed lower-case items, blanks dropped; null counts as empty."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def set_metrics(truth: Column, found: Column) -> dict[str, Column]:
    """precision, recall, f1 and jaccard; two empty sets agree fully, one empty set not at all."""
    hit = F.size(F.array_intersect(truth, found))
    t, p, u = F.size(truth), F.size(found), F.size(F.array_union(truth, found))
    both = (t == 0) & (p == 0)
    share = lambda n, d: F.when(both, F.lit(1.0)).when(d == 0, F.lit(0.0)).otherwise(n / d)
    return {"precision": share(hit, p), "recall": share(hit, t), "f1": share(2 * hit, t + p), "jaccard": share(hit, u)}


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def counts(c: Column) -> Column:
    """Array to map of item to number of occurrences, by sorted runs, in one pass after sorting."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return bound(first, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i)))

    return bound(F.array_sort(c), runs)


def multiset_f1(truth: Column, found: Column) -> Column:
    """F1 of the multiset overlap of two token arrays."""
    a, b = counts(truth), counts(found)
    common = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))), F.lit(0), lambda s, x: s + x)
    total = F.size(truth) + F.size(found)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * common / total)


def at_least(kept: Column, n: int, fillers: Column) -> Column:
    """The array cut or filled cyclically to exactly n items."""
    more = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(fillers, (F.pmod(i, F.size(fillers)) + 1).cast("int")))
    return F.slice(F.concat(kept, more), 1, n)


def best_key(m: Column) -> Column:
    """Key of the largest value, ties to the smaller key."""
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))[0]["k"]
