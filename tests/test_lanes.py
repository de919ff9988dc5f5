"""Predicted documents as search results against whole rankings by hand."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from quillon.operators import lanes as L
from quillon.operators import relations as R
from quillon.plans.catalog import QUERIES
from tests.conftest import SMALL

PROFILES = "profile_id string, domain string, phrases array<string>"


def metrics(order, own, domain, scores, cuts):
    rel = [int(own[d] == domain) for d in order]
    total = sum(rel)
    out = {"mrr": 1 / (rel.index(1) + 1) if total else 0.0}
    for k in cuts:
        top = rel[:k]
        ideal = sum(1 / math.log2(i + 2) for i in range(min(total, k)))
        out |= {f"p_at_{k}": sum(top) / min(k, len(rel)), f"r_at_{k}": sum(top) / total if total else 0.0, f"ndcg_at_{k}": sum(r / math.log2(i + 2) for i, r in enumerate(top)) / ideal if ideal else 0.0}
    return out


def plain(docs, profiles, cuts):
    """Both methods by ranking every document."""
    tokens = {d: t.split() for d, _, t in docs}
    own = {d: g for d, g, _ in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = {}
    for pid, domain, phrases in profiles:
        boolean = {d: sum(f" {p} " in f" {t} " for p in phrases) for d, _, t in docs}
        query, bm25 = " ".join(phrases).split(), {}
        for d, t in tokens.items():
            tf = Counter(t)
            bm25[d] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query if tf[w])
        for method, scores in (("boolean", boolean), ("bm25", bm25)):
            order = sorted(tokens, key=lambda d: (-round(scores[d], 9), d))
            out[pid, method] = metrics(order, own, domain, scores, cuts)
        relevant = [d for d in own if own[d] == domain]
        out[pid, "boolean"]["false_rejection_rate"] = sum(boolean[d] == 0 for d in relevant) / len(relevant) if relevant else 0.0
    return out


@pytest.mark.parametrize("size", [12, 150])
def test_metrics_are_those_of_whole_rankings(spark, size):
    r = random.Random(size)
    docs = [(i, r.choice("xyz"), " ".join(f"w{int(40 * r.random() ** 2)}" for _ in range(r.randint(0, 25)))) for i in range(size)] + [(1000, "only", "nothing of it"), (5000, "x", "")]
    profiles = [("p1", "x", ["w1", "w2 w3", "w30"]), ("p2", "y", ["w39", "w38"]), ("p3", "nowhere", ["w0"]), ("p4", "only", ["w0", "w1"]), ("p5", "z", ["absent", "missing words"])]
    cuts = (3, 10, 50)
    d = spark.createDataFrame(docs, "doc_id long, domain string, text string").repartition(4)
    got = {(x.profile_id, x.method): x.asDict() for x in L.evaluate_lane(d, spark.createDataFrame(profiles, PROFILES), cuts).collect()}
    want = plain(docs, profiles, cuts)
    assert set(got) == set(want)
    for k, m in want.items():
        assert {c: got[k][c] for c in m} == pytest.approx(m), k
    assert got["p1", "bm25"]["false_rejection_rate"] is None
    m = {x.method: x for x in L.mean_metrics(L.evaluate_lane(d, spark.createDataFrame(profiles, PROFILES), cuts)).collect()}
    assert m["bm25"].queries == 5 and m["bm25"].mrr == pytest.approx(sum(v["mrr"] for (_, k), v in want.items() if k == "bm25") / 5)


def test_profiles_are_frozen(spark):
    rows = [("a", "x", ["p", "q"]), ("b", "y", [])]
    p = spark.createDataFrame(rows, PROFILES)
    digest = L.profiles_digest(p)
    assert digest == L.profiles_digest(spark.createDataFrame(rows[::-1], PROFILES))
    manifest = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, domain string")
    texts = spark.createDataFrame([(1, "p q"), (2, "z")], "doc_id long, text string")
    assert L.compare_on_profiles(manifest, texts, p, digest).count() == 4
    for other in ([("a", "x", ["p"]), rows[1]], rows[:1], [("a", "z", ["p", "q"]), rows[1]], [("a", "x", ["q", "p"]), rows[1]]):
        with pytest.raises(L.ProfilesChanged):
            L.compare_on_profiles(manifest, texts, spark.createDataFrame(other, PROFILES), digest)
    with pytest.raises(R.KeyMismatch):
        L.compare_on_profiles(manifest, texts.filter("doc_id = 1"), p, digest)
    with pytest.raises(ValueError, match="unique"):
        L.profiles_digest(p.union(p))


def test_query_over_all_documents(spark):
    got = QUERIES["c24_lanes_on_frozen_profiles"](spark, SMALL).collect()
    langs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang").distinct().count()
    assert len(got) == 2 * langs and all(0 <= r.mrr <= 1 and 0 <= r.ndcg_at_50 <= 1 + 1e-9 for r in got)
    assert max(r.mrr for r in got) > 0.2
