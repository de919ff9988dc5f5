"""Joins with contracts, keyed stores, first-seen rows, splits by quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.sources.files import shared_folder


#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 400_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side within the limit; a larger one is left to shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


#: Rows that a task takes where rows of a key stay together over several windows and groupings.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, most: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over so many tasks that one takes about `most` rows, however large df is; a small df is left to Spark."""
    n = -(-(df.count() if rows is None else rows) // most)
    return df if n < 2 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


class KeyMismatch(ValueError):
    """The two sides of a strict join don't hold the same keys once each."""


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two sides that must hold the same keys, once each; one broken key is enough to raise."""
    keys = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    both = keys(left, "l").join(keys(right, "r"), key, "full_outer")
    bad = both.filter("l IS NULL OR r IS NULL OR l > 1 OR r > 1").take(1)
    if bad:
        raise KeyMismatch(f"{key}={bad[0][key]!r}: {bad[0]['l']} left, {bad[0]['r']} right")
    return left.join(right, key)


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (dropDuplicates keeps any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return first_seen(df, keys, [order.desc()])


def pending(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a result yet."""
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_states(begun: DataFrame, again: DataFrame, key: str, digest: str) -> DataFrame:
    """key and state of the runs asked for: kept (begun under the same configuration), changed (under another one), or new."""
    old = begun.select(key, F.col(digest).alias("__d"), F.lit(True).alias("__b"))
    state = F.when(F.col("__b").isNull(), "new").when(F.col("__d").eqNullSafe(F.col(digest)), "kept").otherwise("changed")
    return again.join(old, key, "left").select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the parents in new are deleted before new is inserted."""
    return upsert(old, new, parent)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: every use sees the same rows in the same parts."""
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Dense numbers from 1 in a global order, without one task ordering all rows.

    Rows are dealt into ranges and written; each range is numbered on its own and shifted by the
    sizes of the ranges before it, of which there is one row a partition. Range bounds are sampled,
    so both uses must read the same written deal.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__c"))
    before = sizes.select("__part", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inner.join(F.broadcast(before), "__part").withColumn(name, F.col("__r") + F.col("__b")).drop("__part", "__r", "__b")


def quotas(strata: DataFrame, weight: str, total: int, key: str) -> DataFrame:
    """Largest remainder shares of `total` by weight, ties by key; strata: one row each."""
    exact = F.col(weight) * F.lit(total) / F.sum(weight).over(Window.partitionBy())
    s = strata.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), F.col(key)))
    s = s.withColumn("left", left).withColumn("place", place)
    return s.withColumn("quota", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).cast("long")).drop("exact", "base", "left", "place")


def hash_order(key: str, seed: str) -> Column:
    return stable_hash(F.col(key), seed=seed)


def set_report(parts: dict[str, DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """Rows issue, part, n: keys in two parts, keys outside the whole, keys in no part."""
    tagged = None
    for name, df in parts.items():
        one = df.select(F.col(key).alias("k"), F.lit(name).alias("part"))
        tagged = one if tagged is None else tagged.union(one)
    twice = tagged.groupBy("k").agg(F.count_distinct("part").alias("c")).filter("c > 1").select(F.lit("overlap").alias("issue"), F.lit("*").alias("part"))
    all_ = whole.select(F.col(key).alias("k"))
    outside = tagged.join(all_, "k", "left_anti").select(F.lit("unknown").alias("issue"), "part")
    missing = all_.join(tagged, "k", "left_anti").select(F.lit("missing").alias("issue"), F.lit("*").alias("part"))
    return twice.union(outside).union(missing).groupBy("issue", "part").agg(F.count("*").alias("n"))
