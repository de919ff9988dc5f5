"""Draws by weight, intervals by resampling, and trees of digests."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import manifest as H
from quillon.operators import resampling as B


def test_draws_are_places_on_the_cumulated_weights(spark):
    r = random.Random(1)
    rows = [(k, float(r.choice([0, 1, 2, 5]))) for k in range(300)] + [(300, 400.0), (301, None), (302, 0.0), (303, -1.0)]
    df = spark.createDataFrame(rows, "id long, w double").repartition(4)
    n = 5000
    got = {x.draw: x.id for x in B.weighted_draws(df, "id", "w", n, "s").collect()}
    kept = [(k, w) for k, w in rows if w and w > 0]
    ends = list(itertools.accumulate(w for _, w in kept))
    for d in range(n):
        x = int(hashlib.sha256(f"s:{d}".encode()).hexdigest()[:13], 16) / 16**13 * ends[-1]
        assert got[d] == kept[bisect.bisect_right(ends, x)][0]
    # frequencies: the chi-square of 300 rows and more lies near its degrees of freedom
    seen = np.bincount(list(got.values()), minlength=304)
    expected = np.array([n * w / ends[-1] for _, w in kept])
    square = float(((seen[[k for k, _ in kept]] - expected) ** 2 / expected).sum())
    freedom = len(kept) - 1
    assert abs(square - freedom) < 5 * (2 * freedom) ** 0.5 and seen[300] > 0.2 * n
    assert B.weighted_draws(df.filter("id > 300"), "id", "w", 10, "s").count() == 0


def test_no_nested_loop_over_draws(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, w double")
    plan = B.weighted_draws(df, "id", "w", 100, "s")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def by_the_library(values, resamples, seed, alpha):
    g = random.Random(seed)
    means = sorted(sum(values[g.randrange(len(values))] for _ in values) / len(values) for _ in range(resamples))
    return means[int(alpha / 2 * (resamples - 1))], means[int((1 - alpha / 2) * (resamples - 1))]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 257])
def test_exact_intervals_are_those_of_one_stream(n):
    values = np.round(np.random.default_rng(n).random(n), 3)
    got = B.mersenne_interval(values, 300, 20260609, 0.1)
    assert got == pytest.approx(by_the_library(values.tolist(), 300, 20260609, 0.1), abs=1e-12)


def test_known_answers_of_two_thousand_resamples():
    assert B.mersenne_interval(np.array([0.0, 1.0])) == (0.0, 1.0) == B.mersenne_interval(np.array([0.0, 1.0]), 100)
    assert B.mersenne_interval(np.zeros(0)) == (0.0, 0.0)
    values = [0.0] * 30 + [1.0] * 10
    assert B.mersenne_interval(np.array(values)) == pytest.approx(by_the_library(values, 2000, 20260609, 0.05))


def test_intervals_by_group(spark):
    rows = [(f"g{k % 3}", k, float(k % 7)) for k in range(90)] + [("one", 1, 2.0), (None, 5, 1.0), ("gap", 1, None)]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(5)
    got = {r.g: r for r in B.exact_intervals(df, "v", "id", "g", resamples=200).collect()}
    assert set(got) == {"g0", "g1", "g2", "one", None} and (got["one"].low, got["one"].high) == (2.0, 2.0)
    want = by_the_library([float(k % 7) for k in range(0, 90, 3)], 200, B.SEED, B.ALPHA)
    assert (got["g0"].low, got["g0"].high) == pytest.approx(want)
    with pytest.raises(ValueError, match="exact resampling takes 10"):
        B.exact_intervals(df, "v", "id", "g", most=10)


def test_poisson_intervals_agree_with_exact_ones_and_reruns(spark):
    values = np.random.default_rng(5).gamma(2.0, 3.0, 4000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    got = B.poisson_intervals(df.repartition(5), "v", "id").first()
    low, high = B.mersenne_interval(values)
    spread = values.std() / len(values) ** 0.5
    assert got.n == 4000 and got.mean == pytest.approx(values.mean()) and abs(got.low - low) < 0.2 * spread and abs(got.high - high) < 0.2 * spread
    again = B.poisson_intervals(df.coalesce(1), "v", "id").first()
    assert (again.low, again.high) == pytest.approx((got.low, got.high))
    assert B.poisson_intervals(df.limit(0), "v", "id").count() == 0
    tasks = B.poisson_intervals(df.repartition(5), "v", "id", resamples=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert tasks.count("Generate") == 1  # arrays of tasks are taken apart, rows never are


def test_poisson_weights_have_their_distribution():
    w = B._weights(np.arange(3000), 500, 7)
    shares = np.bincount(w.astype(int).ravel(), minlength=6)[:6] / w.size
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153, 0.0031], abs=2e-3)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


LEAF = "sha2(concat_ws('|', cast(id AS string), t), 256)"


def test_a_change_renews_one_path(spark):
    ids = [*range(50), 4096, 2**40, 2**62, -1]
    rows = [(g, i, f"t{i}") for g in ("a", "b") for i in ids]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    old = H.merkle_nodes(df, "g", "id", F.expr(LEAF), bits=4).cache()
    again = H.merkle_nodes(df.repartition(7), "g", "id", F.expr(LEAF), bits=4)
    assert H.changed(old, again).count() == 0
    for i in (3, 2**40, -1):
        new = H.merkle_nodes(df.withColumn("t", F.when((F.col("g") == "b") & (F.col("id") == i), "other").otherwise(F.col("t"))), "g", "id", F.expr(LEAF), bits=4)
        diff = H.changed(old, new).collect()
        assert sorted(r.level for r in diff) == list(range(1, 17)) and {r.g for r in diff} == {"b"}
    gone = H.merkle_nodes(df.filter("NOT (g = 'a' AND id = 7)"), "g", "id", F.expr(LEAF), bits=4)
    assert {r.g for r in H.changed(old, gone).collect()} == {"a"}
    a, b = {r.g: r.digest for r in H.roots(old).collect()}, {r.g: r.digest for r in H.roots(gone).collect()}
    assert a["a"] != b["a"] and a["b"] == b["b"]


def test_a_tree_by_hand(spark):
    df = spark.createDataFrame([("a", i, "x") for i in (0, 1, 5)], "g string, id long, t string")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = {i: h(f"{i}|x") for i in (0, 1, 5)}
    nodes = {(r.level, r.block): r.digest for r in H.merkle_nodes(df, "g", "id", F.expr(LEAF), bits=2).collect()}
    assert nodes[1, 0] == h(f"0:{leaf[0]}\n1:{leaf[1]}") and nodes[1, 1] == h(f"5:{leaf[5]}") and nodes[2, 0] == h(f"0:{nodes[1, 0]}\n1:{nodes[1, 1]}") and nodes[3, 0] == h(f"0:{nodes[2, 0]}")
