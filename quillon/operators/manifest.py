"""Digests of whole tables as trees, of which a change renews one path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.relations import settled

#: Bits of an id that one level takes: a node has at most 2^BITS children.
BITS = 12
LEVELS = -(-64 // BITS)


def merkle_nodes(df: DataFrame, by: str, key: str, leaf: Column, bits: int = BITS) -> DataFrame:
    """by, level, block, digest of every node. Ids are 64-bit numbers and name one row each.

    A node of level 1 is the digest of the leaves of a range of ids, with their ids, in order; one of
    a higher level that of the nodes of a range of blocks. No row ever holds more than 2^bits
    children, however large a group, and a changed leaf renews one node a level.
    """
    shift = lambda c: F.shiftrightunsigned(c, bits)
    nodes = df.filter(F.col(key).isNotNull()).select(F.col(by).alias("by"), F.col(key).cast("bigint").alias("block"), leaf.alias("digest"))
    out = []
    for level in range(1, -(-64 // bits) + 1):
        child = F.concat_ws(":", F.col("block").cast("string"), "digest")
        parts = nodes.groupBy("by", shift("block").alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", child.alias("c")))).alias("x"))
        text = F.array_join(F.transform("x", lambda c: c["c"]), "\n")
        nodes = settled(parts.select("by", F.col("up").alias("block"), F.sha2(text, 256).alias("digest")))
        out.append(nodes.select(F.col("by").alias(by), F.lit(level).alias("level"), "block", "digest"))
    return reduce(DataFrame.unionByName, out)


def roots(nodes: DataFrame) -> DataFrame:
    """The digest of each group."""
    by = nodes.columns[0]
    return nodes.filter(F.col("level") == nodes.agg(F.max("level")).first()[0]).select(by, "digest")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """by, level, block of the nodes that differ, or that only one of the trees has."""
    by = old.columns[0]
    at = [by, "level", "block"]
    both = old.withColumnRenamed("digest", "a").join(new.withColumnRenamed("digest", "b"), at, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*at)


def root_sql(table: str, by: str, key: str, leaf: str, bits: int = BITS) -> str:
    """SQL for the roots of a table whose ids are not negative."""
    ctes = [f"n0 AS (SELECT {by} AS grp, {key} AS block, {leaf} AS digest FROM {table} WHERE {key} IS NOT NULL)"]
    levels = -(-64 // bits)
    for k in range(1, levels + 1):
        ctes.append(f"n{k} AS (SELECT grp, block >> {bits} AS block, sha256(string_agg(block::VARCHAR || ':' || digest, chr(10) ORDER BY block)) AS digest FROM n{k - 1} GROUP BY ALL)")
    return f"WITH {', '.join(ctes)} SELECT grp AS {by}, digest FROM n{levels}"
