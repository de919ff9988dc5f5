"""Comparison of predicted documents as search results: frozen profiles, one lane a set of predictions, two methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash, tokenize
from quillon.operators.ranking import first_ranks, top_documents
from quillon.operators.relations import maybe_broadcast, settled, strict_join
from quillon.operators.retrieval import phrase_hits, ranking_metrics

CUTS = (10, 25, 50)
#: Profiles that a digest may be made of; they are few by nature.
MOST_PROFILES = 100_000


class ProfilesChanged(ValueError):
    """The profiles aren't those that were frozen."""


def profiles_digest(profiles: DataFrame) -> str:
    """The digest of profiles (profile_id, domain, phrases): of their own digests, in order. Repeated ids raise."""
    each = profiles.select(F.col("profile_id").cast("string").alias("id"), stable_hash(F.col("domain"), F.to_json("phrases"), seed="profile").alias("h"))
    n, distinct = each.agg(F.count("*"), F.count_distinct("id")).first()
    if n != distinct or n > MOST_PROFILES:
        raise ValueError(f"{n} profiles with {distinct} ids; ids are unique and at most {MOST_PROFILES}")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: F.concat_ws(":", x["id"], x["h"])), "\n")
    return each.agg(F.sha2(parts, 256).alias("d")).first().d


def _filled(top: DataFrame, docs: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
    """top (profile_id, doc_id, score, rank) with documents of score 0, by id, where a profile has fewer than `most`.

    Only the first 2 * most ids can be among them.
    """
    have = profiles.select("profile_id").join(top.groupBy("profile_id").agg(F.count("*").alias("n")), "profile_id", "left").select("profile_id", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < most)
    first = settled(docs.select("doc_id").orderBy("doc_id").limit(2 * most))
    blank = have.join(F.broadcast(first.agg(F.collect_list("doc_id").alias("ids")))).select("profile_id", "n", F.explode("ids").alias("doc_id"))
    blank = blank.join(top.select("profile_id", "doc_id"), ["profile_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("doc_id"))
    blank = blank.select("profile_id", "doc_id", F.lit(0.0).alias("score"), (F.col("n") + place).cast("int").alias("rank")).filter(F.col("rank") <= most)
    return top.select("profile_id", "doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank")).unionByName(blank)


def _boolean_first(hits: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile_id and the rank of its first relevant document by hits (profile_id, doc_id, score), documents without hits behind."""
    own = hits.join(docs.select("doc_id", "domain"), "doc_id").join(profiles.select("profile_id", "domain"), ["profile_id", "domain"])
    best = own.groupBy("profile_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))).alias("b"))
    least = profiles.select("profile_id", "domain").join(docs.groupBy("domain").agg(F.min("doc_id").alias("d0")), "domain")
    sought = settled(least.join(best, "profile_id", "left").select("profile_id", F.coalesce("b.d", "d0").alias("d"), F.coalesce(-F.col("b.s"), F.lit(0)).alias("s")))
    j = hits.join(maybe_broadcast(sought), "profile_id")
    ahead = F.when(F.col("s") > 0, (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("doc_id") < F.col("d")))).otherwise(F.col("doc_id") >= F.col("d"))
    counted = j.filter(ahead).groupBy("profile_id").agg(F.count("*").alias("n"))
    # with no hit at all the documents with smaller ids come first too; hits among them are counted there
    bare = sought.filter("s = 0")
    below = docs.select("doc_id").join(maybe_broadcast(bare.select("d").distinct()), F.col("doc_id") < F.col("d")).groupBy("d").agg(F.count("*").alias("m")) if not bare.isEmpty() else bare.select("d", F.lit(0).alias("m")).limit(0)
    return sought.join(counted, "profile_id", "left").join(below, "d", "left").select("profile_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("s") == 0, F.coalesce("m", F.lit(0))).otherwise(0) + 1).alias("first_rank"))


def evaluate_lane(docs: DataFrame, profiles: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """profile_id, domain, method (boolean, bm25), mrr, precision, recall and nDCG at each cut, false_rejection_rate (boolean only).

    docs: doc_id, domain, text in normal form; profiles: profile_id, domain, phrases. All documents are
    ranked, those without a hit behind the others by id; documents of the profile's domain are relevant.
    """
    most = max(cuts)
    d = settled(docs.filter("doc_id IS NOT NULL").select("doc_id", "domain", F.coalesce("text", F.lit("")).alias("text")))
    p = settled(profiles.select("profile_id", "domain", "phrases"))
    totals = d.groupBy("domain").agg(F.count("*").alias("total"))
    owners = p.select("profile_id", F.explode("phrases").alias("phrase")).groupBy("profile_id", "phrase").agg(F.count("*").alias("times"))
    hits = phrase_hits(d, owners, "doc_id", "text", "phrase").distinct().join(maybe_broadcast(owners), "phrase").groupBy("profile_id", "doc_id").agg(F.sum("times").alias("score"))
    hits = settled(hits)
    order = Window.partitionBy("profile_id").orderBy(F.col("score").desc(), "doc_id")
    boolean = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    number = F.xxhash64("profile_id").alias("query_id")  # queries of the ranking are numbers
    named = p.select(number, "profile_id")
    asked = p.select(number, "domain", tokenize(F.array_join("phrases", " ")).alias("tokens"))
    held = d.select("doc_id", "domain", tokenize(F.col("text")).alias("tokens"))
    bm25 = top_documents(held, asked, most).join(maybe_broadcast(named), "query_id").drop("query_id")
    ranks = {"boolean": _boolean_first(hits, d, p), "bm25": first_ranks(held, asked, group="domain", zeros=True).join(maybe_broadcast(named), "query_id").drop("query_id")}
    rejected = hits.join(d.select("doc_id", "domain"), "doc_id").join(p.select("profile_id", "domain"), ["profile_id", "domain"]).groupBy("profile_id").agg(F.count("*").alias("found"))
    out = None
    for method, top in (("boolean", boolean), ("bm25", bm25)):
        full = _filled(settled(top), d, p, most).join(d.select("doc_id", F.col("domain").alias("own")), "doc_id").join(p.select("profile_id", "domain"), "profile_id").join(totals, "domain", "left")
        full = full.withColumns({"rel": F.coalesce((F.col("own") == F.col("domain")).cast("int"), F.lit(0)), "total": F.coalesce("total", F.lit(0))})
        m = ranking_metrics(full, "rel", "total", group="profile_id", cuts=cuts).drop("mrr").join(ranks[method], "profile_id", "left")
        m = m.withColumn("mrr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).drop("first_rank")
        rate = F.coalesce(1 - F.coalesce("found", F.lit(0)) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)) if method == "boolean" else F.lit(None).cast("double")
        one = p.select("profile_id", "domain").join(totals, "domain", "left").join(rejected, "profile_id", "left").join(m, "profile_id").withColumns({"method": F.lit(method), "false_rejection_rate": rate}).drop("total", "found")
        out = one if out is None else out.unionByName(one)
    return out


def compare_on_profiles(manifest: DataFrame, predictions: DataFrame, profiles: DataFrame, digest: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """evaluate_lane of predictions (doc_id, text) for a manifest (doc_id, domain), on profiles whose digest must be the frozen one.

    Changed profiles raise before anything is scored; so do predictions that don't match the manifest one to one.
    """
    if (now := profiles_digest(profiles)) != digest:
        raise ProfilesChanged(f"frozen {digest[:12]}, found {now[:12]}")
    return evaluate_lane(strict_join(manifest.select("doc_id", "domain"), predictions.select("doc_id", "text"), "doc_id"), profiles, cuts)


def mean_metrics(rows: DataFrame) -> DataFrame:
    """method, queries and the mean of every metric over the profiles."""
    names = [c for c in rows.columns if c not in ("profile_id", "domain", "method")]
    return rows.groupBy("method").agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])
