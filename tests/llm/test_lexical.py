from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string"


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=50):
    """Scores by the formula, in Python integers."""
    d = [(i, Counter(terms(t))) for i, t in docs]
    d = [(i, c, sum(c.values())) for i, c in d if c]
    n, total = len(d), sum(x[2] for x in d)
    df = Counter(t for _, c, _ in d for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        scores = []
        for i, c, size in d:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("x"), "term": F.lit("y"), "rank": F.lit(1)})
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    return sorted((tuple(r) for r in L.search(d, q, **options).collect()), key=str)


def corpus(seed, n=400, words=300):
    r = np.random.default_rng(seed)
    draw = lambda size: " ".join(f"W{int(x)}" for x in words * r.random(size) ** 3)
    return [(int(i), draw(int(r.integers(1, 60)))) for i in r.permutation(n)], [(i, draw(6)) for i in range(12)]


@pytest.mark.parametrize("options", [{}, {"shard_docs": 40}, {"query_terms": 5, "shard_docs": 90}, {"k": 3}])
def test_equals_brute_force(spark, options):
    docs, items = corpus(1)
    assert found(spark, docs, items, **options) == plain(docs, items, options.get("k", 50))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "One TWO"), (4, "one two"), (4, "one two"), (None, "one two"), (None, "one"), (5, "éÉ 日本語 one"), (6, "one " * 70_000 + "two"), (7, "É"), (8, "x-y_z")]
    items = [(1, "ONE two"), (1, "é"), (2, None), (3, "!!"), (4, "É 日本語"), (None, "y"), (5, "one one one"), (6, "missing")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] == found(spark, docs, [])


def lists_of(r, docs, dfs, top, within=None):
    length = r.integers(1, 200, docs)
    out = []
    for df in dfs:
        places = np.sort(r.choice(within if within and df <= within else docs, df, replace=False))
        tf = np.minimum(r.geometric(0.6, df), top)
        cut = range(0, df, L.BLOCK)
        pairs = [L.competitive(tf[i : i + L.BLOCK], length[places[i : i + L.BLOCK]]) for i in cut]
        most = [int(L.impact(x[:, 0], L.norms(x[:, 1], docs, int(length.sum()))).max()) for x in pairs]
        out.append((L.Postings([int(places[i : i + L.BLOCK][-1]) for i in cut], most, [len(places[i : i + L.BLOCK]) for i in cut], [L.pack(places[i : i + L.BLOCK], tf[i : i + L.BLOCK]) for i in cut], L.norms(length, docs, int(length.sum()))), places, tf))
    return out, length


def test_wand_is_exact_and_skips_blocks():
    r = np.random.default_rng(8)
    for trial in range(30):
        docs, near = 20_000, 2_000 if trial % 3 == 0 else None  # rare terms all over, or in a tenth of the documents
        dfs = [int(x) for x in (docs * 0.5, docs * 0.3, docs * 0.1, 400, 60, 7)]
        lists, _ = lists_of(r, docs, dfs, 1 if trial % 5 == 0 else 9, near)  # with equal frequencies many scores tie
        weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in dfs]
        sums = np.zeros(docs, np.int64)
        for w, (p, places, tf) in zip(weights, lists, strict=True):
            sums[places] += w * L.impact(tf, p.length[places])
        want = sorted(np.flatnonzero(sums).tolist(), key=lambda i: (-sums[i], i))[:10]
        top, score = L.best([p for p, _, _ in lists], weights, docs, 10, stride=(1, 64, 512)[trial % 3 if not near else 2])
        assert sorted(zip((-score).tolist(), top.tolist(), strict=True)) == [(-int(sums[i]), i) for i in want]
        if near:  # most blocks of the frequent terms were never decompressed
            assert sum(len(p.opened) for p, _, _ in lists) < 0.35 * sum(len(p.last) for p, _, _ in lists)


def test_short_lists_end_before_long_ones():
    r = np.random.default_rng(10)
    for _ in range(300):
        docs = int(r.integers(1, 700))
        dfs = [int(x) for x in r.integers(1, docs + 1, int(r.integers(1, 7)))]
        lists, _ = lists_of(r, docs, dfs, 5)
        weights = [int(x) for x in r.integers(1, 9000, len(dfs))]
        sums = np.zeros(docs, np.int64)
        for w, (p, places, tf) in zip(weights, lists, strict=True):
            sums[places] += w * L.impact(tf, p.length[places])
        k = int(r.integers(1, 30))
        want = sorted(np.flatnonzero(sums).tolist(), key=lambda i: (-sums[i], i))[:k]
        top, score = L.best([p for p, _, _ in lists], weights, docs, k, stride=int(r.integers(1, 40)))
        assert sorted(zip((-score).tolist(), top.tolist(), strict=True)) == [(-int(sums[i]), i) for i in want]


def test_blocks_round_trip():
    r = np.random.default_rng(9)
    for top in (1, 300, 70_000, 2**33):
        places = np.sort(r.choice(10**6, 128, replace=False))
        tf = r.integers(1, top + 1, 128)
        a, b = L.unpack(L.pack(places, tf), 128)
        assert (a == places).all() and (b == tf).all()
        length = r.integers(1, 50, 128)
        pairs, m = L.competitive(tf, length), lambda x: L.norms(x, 1000, 20_000)
        assert L.impact(pairs[:, 0], m(pairs[:, 1])).max() == L.impact(tf, m(length)).max()
    assert L.norms(np.array([2**40]), 2**40, 2**50).tolist() == [50 + 50 * 2**30]
