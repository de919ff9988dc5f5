"""Search and ranking: postings, BM25, boolean screens, ranking metrics, mined profiles."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.automaton import PhraseAutomaton
from quillon.operators.relations import maybe_broadcast, settled
from quillon.shipping import ship

K1 = 1.5
B = 0.75
#: Words of the phrases that one automaton holds.
PHRASE_WORDS = 1_000_000


def postings(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """key, term, tf, length, of the vocabulary's terms if one is given: one partial count a task, one shuffle."""
    flat = docs.select(F.col(key).alias("key"), F.size(tokens).alias("length"), F.explode(tokens).alias("term"))
    flat = flat if vocabulary is None else flat.join(vocabulary, "term", "left_semi")
    return flat.groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", tokens: str = "tokens", qkey: str = "query_id", qtokens: str = "tokens") -> DataFrame:
    """qkey, key, score of the documents that share a term with the query; a repeated query term counts each time.

    Only terms that some query has leave the scan: document frequencies and postings are of the
    queries' vocabulary, whatever the corpus holds besides.
    """
    terms = queries.select(F.col(qkey).alias("qkey"), F.explode(qtokens).alias("term")).groupBy("qkey", "term").agg(F.count("*").alias("qtf"))
    vocabulary = terms.select("term").distinct()
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean"))
    post = postings(docs, key, tokens, vocabulary)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n, dfc = F.col("n"), F.col("df")
    idf = F.ln(1 + (n - dfc + 0.5) / (dfc + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = post.join(df, "term").join(F.broadcast(stats)).join(terms, "term")  # stats is one row
    return scored.groupBy("qkey", "key").agg(F.sum(weight * F.col("qtf")).alias("score")).select(F.col("qkey").alias(qkey), F.col("key").alias(key), "score")


def ranked(scores: DataFrame, group: str, key: str, score: str = "score", most: int | None = None) -> DataFrame:
    """Ranks within each group by falling score, ties by key."""
    w = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(key))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= most) if most else out


def ranking_metrics(rankings: DataFrame, relevant: str, total: str, group: str = "query_id", cuts=(10, 25, 50)) -> DataFrame:
    """Precision, recall, nDCG at each cut, and MRR, of rankings (group, rank, relevant 0/1, total relevant)."""
    r, k = F.col(relevant), F.col("rank")
    gain = r / F.log2(k + 1)
    columns: list[Column] = [F.coalesce(F.lit(1.0) / F.min(F.when(r == 1, k)), F.lit(0.0)).alias("mrr")]
    best = F.max(total)
    for c in cuts:
        top = k <= c
        hits = F.sum(F.when(top, r).otherwise(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(best.cast("int"), F.lit(c)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        columns += [
            (hits / F.sum(top.cast("int"))).alias(f"p_at_{c}"),
            F.when(best > 0, hits / best).otherwise(0.0).alias(f"r_at_{c}"),
            F.when(best > 0, F.sum(F.when(top, gain).otherwise(0.0)) / ideal).otherwise(0.0).alias(f"ndcg_at_{c}"),
        ]
    return rankings.groupBy(group).agg(*columns)


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str, most_words: int = PHRASE_WORDS) -> DataFrame:
    """key, phrase: the phrases, as runs of whole words, that each text holds.

    One pass over the texts: each task walks an automaton of all phrases. Phrases of more than
    `most_words` words together are dealt over several automata, each with a pass of its own.
    """
    ship(docs.sparkSession)
    known = settled(phrases.select(F.col(phrase).alias("phrase")).filter(F.col("phrase") != "").distinct())
    words = known.agg(F.sum(F.size(F.split("phrase", " ")))).first()[0] or 0
    parts = max(1, -(-words // most_words))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def searched(shared):
        def run(batches):
            automaton = shared.value
            for batch in batches:
                found = automaton.find(batch.column(1))
                at = [i for i, hits in enumerate(found) for _ in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([automaton.phrases[n] for hits in found for n in sorted(hits)], pa.string())], ["key", "phrase"])

        return run

    out = []
    for p in range(parts):
        mine = known if parts == 1 else known.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == p)
        shared = docs.sparkSession.sparkContext.broadcast(PhraseAutomaton([r.phrase for r in mine.collect()]))  # most_words words, about
        out.append(rows.mapInArrow(searched(shared), rows.select("key", F.lit("").alias("phrase")).schema))
    return reduce(DataFrame.unionByName, out).select(F.col("key").alias(key), F.col("phrase").alias(phrase))


def phrase_screen(docs: DataFrame, phrases: DataFrame, key: str, text: str, group: str, phrase: str, most_words: int = PHRASE_WORDS) -> DataFrame:
    """group, key, score: how many of a group's phrases each text holds."""
    owners = phrases.select(group, phrase).distinct()
    hits = phrase_hits(docs, phrases, key, text, phrase, most_words)
    return hits.join(maybe_broadcast(owners), phrase).groupBy(group, key).agg(F.count_distinct(phrase).alias("score"))


#: Profiles whose zero scores may be asked for.
MOST_PROFILES = 1000


def profile_scores(docs: DataFrame, profiles: DataFrame, key: str, tokens: str, profile: str, terms: str, zeros: bool = False) -> DataFrame:
    """key, profile, score: how many of a profile's terms a document has; pairs without any only if `zeros` asks for all pairs.

    Documents and profiles meet by term, so that a pair without a common term costs nothing. key names one row.
    """
    filed = profiles.select(profile, F.explode(F.array_distinct(terms)).alias("__t"))
    held = docs.select(key, F.explode(F.array_distinct(tokens)).alias("__t"))
    some = held.join(maybe_broadcast(filed), "__t").groupBy(key, profile).agg(F.count("*").alias("score"))
    if not zeros:
        return some
    names = [r[0] for r in profiles.select(profile).distinct().limit(MOST_PROFILES + 1).collect()]
    if len(names) > MOST_PROFILES:
        raise ValueError(f"zero scores of more than {MOST_PROFILES} profiles")
    every = docs.select(key, F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")).alias(profile))
    return every.join(some, [key, profile], "left").select(key, profile, F.coalesce("score", F.lit(0)).alias("score"))


def profiles(docs: DataFrame, domain: str, skills: str, most: int = 12) -> DataFrame:
    """The skills that tell a domain: prevalence in it times ln((N+1)/(df+1)); `most` a domain, ties by df falling, then skill.

    Each document has one domain and an array of skills, so one count by domain and skill is
    enough: frequencies over all domains are sums of it.
    """
    held = docs.filter(F.size(skills) > 0)
    size = held.groupBy(domain).agg(F.count("*").alias("size"))
    n = held.agg(F.count("*").alias("n"))
    per = held.select(domain, F.explode(F.array_distinct(skills)).alias("skill")).groupBy(domain, "skill").agg(F.count("*").alias("c"))
    df = per.groupBy("skill").agg(F.sum("c").alias("df"))
    scored = per.join(df, "skill").join(size, domain).join(F.broadcast(n))  # n is one row
    scored = scored.withColumn("score", F.col("c") / F.col("size") * F.ln((F.col("n") + 1) / (F.col("df") + 1)))
    w = Window.partitionBy(domain).orderBy(F.round("score", 9).desc(), F.col("df").desc(), F.col("skill"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(domain, "skill", "df", "score", "rank")
