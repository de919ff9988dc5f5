"""Operators over ordered rows: islands, sessions, anchored groups, merges, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relations import settled


def islands(df: DataFrame, by: list[str], at: str, same: list[str]) -> DataFrame:
    """df with island: the number of the maximal run of rows equal in `same`, from 1 within `by`."""
    w = Window.partitionBy(*by).orderBy(at)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    new = (change | F.lag(at).over(w).isNull()).cast("int")
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def joined_spans(df: DataFrame, by: list[str], at: str, same: list[str], text: str, extra: list[Column] | None = None) -> DataFrame:
    """One row an island: its texts joined in order, its first and last place, its rows."""
    marked = islands(df, by, at, same)
    parts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(text).alias("t"))))
    return marked.groupBy(*by, "island", *same).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"), *(extra or []))


def neighbours(df: DataFrame, by: str, at: str, *values: str) -> DataFrame:
    """by, at, values and next: struct(at, values) of the following row of the same `by`; last rows are left out.

    Rows are dealt into ranges of (by, at), so that no task holds all rows of one `by`; a range's last row of
    each `by` is followed by the first one of a later range, of which there are no more than ranges and values of `by`.
    """
    part = settled(df.select(by, at, *values).repartitionByRange(by, at).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", by).orderBy(at)
    row = F.struct(at, *values)
    inner = part.withColumn("next", F.lead(row).over(w))
    first = part.groupBy("__part", by).agg(F.min_by(row, at).alias("__first"))
    later = first.select("__part", by, F.lead("__first").over(Window.partitionBy(by).orderBy("__part")).alias("__later"))
    joined = inner.filter("next IS NULL").join(later, ["__part", by])
    ends = joined.select(by, at, *values, F.col("__later").alias("next")).filter("next IS NOT NULL")
    return inner.filter("next IS NOT NULL").select(by, at, *values, "next").unionByName(ends)


def folded_groups(df: DataFrame, by: list[str], at: str, field: str, starts, keep: tuple[str, ...] = ()) -> DataFrame:
    """by, at, field, grp and the columns to keep: group numbers by a fold over each sequence that remembers the fields seen.

    starts(seen, prev, item) tells whether a row begins a new group; seen is the array of fields
    in the current group, prev the field before. A sequence is folded in its own row.
    """
    seq = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(field).alias("field"), *keep))).alias("items"))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(None).cast("string").alias("prev"), F.lit(0).alias("grp"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = starts(s["seen"], s["prev"], x["field"])
        grp = F.when(new & (F.size(s["out"]) > 0), s["grp"] + 1).otherwise(s["grp"])
        seen = F.when(new, F.array(x["field"])).otherwise(F.array_union(s["seen"], F.array(x["field"])))
        return F.struct(seen.alias("seen"), x["field"].alias("prev"), grp.alias("grp"), F.concat(s["out"], F.array(grp)).alias("out"))

    groups = F.aggregate("items", zero, step, lambda s: s["out"])
    flat = seq.select(*by, F.explode(F.arrays_zip("items", groups.alias("groups"))).alias("x"))
    return flat.select(*by, F.col("x.items.at").alias("at"), F.col("x.items.field").alias("field"), F.col("x.groups").alias("grp"), *[F.col(f"x.items.{c}").alias(c) for c in keep])


def repeated_key_sessions(df: DataFrame, by: list[str], at: str, field: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A new record where a field comes back after a different one."""
    return folded_groups(df, by, at, field, lambda seen, prev, x: F.array_contains(seen, x) & ~prev.eqNullSafe(x), keep)


def anchored_groups(df: DataFrame, by: list[str], at: str, field: str, anchor: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A new group at the anchor once the group holds another field, or where another field repeats.

    What stands before the first anchor of a sequence belongs to no group and is left out.
    """
    first = F.min(F.when(F.col(field) == anchor, F.col(at))).over(Window.partitionBy(*by))
    led = df.select(*by, at, field, *keep).withColumn("__first", first).filter(F.col(at) >= F.col("__first")).drop("__first")
    others = lambda seen: F.size(F.array_remove(seen, F.lit(anchor))) > 0
    return folded_groups(led, by, at, field, lambda seen, prev, x: F.when(x == anchor, others(seen)).otherwise(F.array_contains(seen, x)), keep)


def truncate_overlaps(df: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """Ends after the next start are set to the month before it; months are numbers."""
    w = Window.partitionBy(*by).orderBy(start, key)
    nxt = F.lead(start).over(w)
    return df.withColumn(end, F.when(F.col(end) > nxt, nxt - 1).otherwise(F.col(end)))


def chunks(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """df with chunk: runs of `size` rows within `by`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def adjacent_changes(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Rows whose value is not null and differs from the row before."""
    w = Window.partitionBy(*by).orderBy(at)
    return df.filter("true").withColumn("__p", F.lag(value).over(w)).filter(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("__p"))).drop("__p")


def graph_issues(graphs: DataFrame, units: DataFrame, doc: str, unit: str, box: str, oracle: str, allow_oracle: bool = False) -> DataFrame:
    """doc, issue, n: what is wrong with the evidence of each row of graphs, none where all is well.

    units (doc, unit, box: array) are counted by document before they meet graphs, so a long
    document costs one row. A coordinate outside of 0 to 1000 makes its unit's box invalid.
    """
    outside = F.exists(box, lambda x: (x < 0) | (x > 1000))
    per = units.groupBy(doc).agg(F.count("*").alias("__u"), (F.count(unit) - F.count_distinct(unit)).alias("__r"), F.count_if(outside).alias("__o"))
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")
    found = {"oracle evidence": one(F.col(oracle) & F.lit(not allow_oracle)), "repeated ids": one(F.col("__r") > 0), "no units": one(F.col("__u").isNull()), "box out of bounds": F.coalesce("__o", F.lit(0)).cast("long")}
    issues = F.array(*[F.struct(F.lit(k).alias("issue"), c.alias("n")) for k, c in found.items()])
    return graphs.join(per, doc, "left").select(doc, F.explode(issues).alias("i")).select(doc, "i.issue", "i.n").filter("n > 0")
