"""Bounded ranking and phrase screens against plain forms, and what they shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions.automaton import PhraseAutomaton
from quillon.operators import ranking as K
from quillon.operators import retrieval as R


def tokens(seed, n, words=60, size=40):
    r = np.random.default_rng(seed)
    return [[f"t{int(x)}" for x in words * r.random(int(r.integers(0, size))) ** 2] for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = tokens(1, 600)
    texts[300:330] = texts[:30]  # copies: equal scores
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, ["t1"]), (9000, None)], "doc_id bigint, tokens array<string>").repartition(5, "doc_id").cache()
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(tokens(2, 20, size=9))] + [(90, ["t1", "t1", "t2"]), (91, ["absent"]), (92, None), (93, [])], "query_id bigint, tokens array<string>")
    return docs.filter("doc_id IS NOT NULL AND tokens IS NOT NULL"), queries, docs


def plain(docs, queries, k):
    got = R.ranked(R.bm25(docs, queries), "query_id", "doc_id", most=k).collect()
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in got)


@pytest.mark.parametrize("query_terms", [10**6, 7])
@pytest.mark.parametrize("k", [1, 5, 50, 10_000])
def test_top_documents_equal_the_full_ranking(corpus, k, query_terms):
    docs, queries, _ = corpus
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in K.top_documents(docs, queries, k, query_terms=query_terms).collect())
    assert got == plain(docs, queries, k) and got


def test_no_more_than_k_rows_a_query_and_task_are_shuffled(corpus):
    docs, queries, _ = corpus
    for k in (1, 5):
        out = K.top_candidates(docs, queries, k).withColumn("task", F.spark_partition_id())
        assert out.groupBy("task", "query_id").count().filter(F.col("count") > k).isEmpty()
        assert out.count() <= k * docs.rdd.getNumPartitions() * queries.count()


def test_blocks_below_the_bound_are_not_scored():
    idf = {"rare": 5.0, "common": 0.1}
    m = K.Model([(1, [("rare", 1), ("common", 1)])], idf, 10.0)
    lists = pa.array([["common"] * 3] * 2000 + [["rare", "common"]] * 10 + [["common", "x", "y", "z"]] * 2000)
    least, scored = np.full(1, -np.inf), 0
    for _, _, s in m.scored(lists, least):
        scored += 1
        least[0] = max(least[0], np.sort(s)[-3])
    assert scored <= 3 < len(lists) // K.BLOCK


def test_rows_without_key_or_tokens(corpus):
    docs, queries, every = corpus
    assert K.top_documents(every.filter("doc_id IS NULL OR tokens IS NULL"), queries, 3).count() == 0
    assert K.top_documents(docs.limit(0), queries, 3).count() == 0 == K.top_documents(docs, queries.limit(0), 3).count()


def test_first_ranks_without_a_ranking(corpus):
    docs, queries, _ = corpus
    wanted = docs.filter("doc_id % 37 = 5").select("doc_id")
    full = R.ranked(R.bm25(docs, queries), "query_id", "doc_id").join(wanted, "doc_id").groupBy("query_id").agg(F.min("rank").alias("first"))
    assert sorted(map(tuple, K.first_ranks(docs, queries, wanted).collect())) == sorted((r.query_id, r.first) for r in full.collect())
    assert K.first_ranks(docs, queries, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("query_terms", [10**6, 7])
def test_first_ranks_by_group_with_zeros(spark, corpus, query_terms):
    docs, queries, _ = corpus
    grouped = docs.withColumn("g", F.concat(F.lit("g"), (F.col("doc_id") % 61).cast("string")))
    asked = queries.filter("tokens IS NOT NULL AND size(tokens) > 0").withColumn("g", F.concat(F.lit("g"), (F.col("query_id") % 7).cast("string"))).union(spark.createDataFrame([(500, ["t0"], "absent"), (501, ["t0", "nothing"], "g60")], "query_id bigint, tokens array<string>, g string"))
    scores = {(r.query_id, r.doc_id): round(r.score, 9) for r in R.bm25(docs, asked).collect()}
    ids = {r.doc_id: r.g for r in grouped.collect()}
    want = {}
    for q in asked.collect():
        order = sorted(ids, key=lambda d: (-scores.get((q.query_id, d), 0), d))
        want |= {q.query_id: n for n, d in reversed(list(enumerate(order, 1))) if ids[d] == q.g}
    got = {r.query_id: r.first_rank for r in K.first_ranks(grouped, asked, group="g", zeros=True, query_terms=query_terms).collect()}
    assert got == want and 500 not in got and max(got.values()) > 10


PHRASES = ["a b", "b", "a b c", "b c", "c a b a", "x", "a a", "a a a", "long one here"]


def test_automaton_finds_overlapping_and_nested_phrases():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(list("abcxyz"), int(r.integers(0, 30)))) for _ in range(300)] + [None, "", "a", "ab", "a b", "long one", "here long one here"]
    m = PhraseAutomaton(PHRASES + PHRASES)
    assert len(m.phrases) == len(PHRASES)
    for text, found in zip(texts, m.find(pa.array(texts, pa.string())), strict=True):
        assert {m.phrases[n] for n in found} == {p for p in PHRASES if f" {p} " in f" {text or ''} "}


@pytest.mark.parametrize("most_words", [10**6, 4])
def test_phrase_screen(spark, most_words):
    r = np.random.default_rng(4)
    texts = [(i // 2, " ".join(r.choice(list("abcxyz"), 12))) for i in range(60)] + [(None, "a b"), (77, None)]  # two rows a key
    docs = spark.createDataFrame(texts, "id bigint, body string").repartition(3)
    owners = [(g, p) for g in range(3) for n, p in enumerate(PHRASES) if n % 3 <= g] + [(5, ""), (6, None), (0, "b")]
    phrases = spark.createDataFrame(owners, "g int, p string")
    got = sorted((str(x.g), str(x.id), x.score) for x in R.phrase_screen(docs, phrases, "id", "body", "g", "p", most_words).collect())
    held = {}
    for g, p in set(owners):
        for i, t in texts:
            if p and f" {p} " in f" {t or ''} ":
                held.setdefault((str(g), str(i)), set()).add(p)
    assert got == sorted((g, i, len(s)) for (g, i), s in held.items())


def test_texts_are_neither_exploded_nor_joined(spark):
    docs = spark.createDataFrame([(1, "a b c")], "id bigint, body string")
    plan = R.phrase_hits(docs, spark.createDataFrame([("a b",)], "p string"), "id", "body", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
