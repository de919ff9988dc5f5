"""Mixing sources to target weights [native].

Word counts are summed per source, the target of each source is found by filling up to its limit
(`most` times its size) with the excess reshared by weight, and every document is emitted
floor(rate) times plus one copy drawn by a hash of its id with probability rate - floor(rate).

Defined results: null text has size 0; a null source is a source of its own, ordered last; a null
id draws as the empty string; repeated rows draw alike; a source without words gets target 0 and
its documents are not emitted; an empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import BROADCAST_ROWS, WORD_SQL, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of the id: reruns agree."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source of sizes (source, size).

    One row a source remains after the partial sums, so the windows below see sources, not
    documents: with sources sorted by limit over weight, those that the level of the rest reaches
    stay at their limit, and the others share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = rise.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / rest)
    open_ = F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(all_)
    return per.withColumn("at", open_).select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("at") * F.col("w"), F.col("limit"))).alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with __size, __source_size, __target, __copies.

    The table of sources is broadcast if it was counted within the limit; beyond it is salted, so
    that a source with a third of all rows is spread over SALTS tasks.
    """
    sized = docs.withColumn("__size", size_of(F.col(text)))
    t = materialize(source_targets(docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size")), weights, share, most), "sources")
    t = t.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    if t.count() <= BROADCAST_ROWS // 10:
        joined = sized.join(F.broadcast(t), F.col(source).eqNullSafe(F.col("__s")), "left")
    else:
        salted = t.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("__j", F.pmod(F.hash(doc_id), F.lit(SALTS))).join(salted, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__j") == F.col("__k")), "left").drop("__j", "__k")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col(doc_id), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("__copies", copies.cast("int")).drop("__s")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs and copy_no, one row for each copy."""
    planned = plan_mix(docs, **options).filter(F.col("__copies") > 0)
    return planned.select(*[F.col(f"`{c}`") for c in docs.columns if c != "copy_no"], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy_no"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


MIX_CTE = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM per),
leveled AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM ranked WINDOW b AS (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(lim, coalesce((SELECT max(level) FROM leveled WHERE level * w <= lim) * w, lim)) AS target FROM leveled),
mixed AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
   ('0x' || substr(sha256('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
planned AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM mixed)
"""
OP3_SQL = "WITH " + MIX_CTE.format(docs="documents", text="text") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM planned"
