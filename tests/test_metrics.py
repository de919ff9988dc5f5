"""Metrics over ranges of scores, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics as M
from quillon.operators import sequences as Q

SCHEMA = "g string, y int, s double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.randint(0, 60) / 60) for _ in range(900)] + [("one class", 1, 0.5)]


def _auc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_of_groups_and_of_all(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: r["auc"] for r in M.auc(df, "y", "s", ["g"]).collect()}
    assert got == {g: pytest.approx(_auc([r for r in rows if r[0] == g])) for g in {r[0] for r in rows}}
    assert M.auc(df, "y", "s").first()["auc"] == pytest.approx(_auc(rows))
    assert M.auc(df.limit(0), "y", "s").first()["auc"] == 0.5


def test_running_sums_cross_the_ranges(spark):
    df = spark.range(500).select("id", F.lit(2).alias("two"))
    got = M.running(df, [F.col("id").desc()], {"upto": "two"}, ahead=("id",)).collect()
    assert {(r["id"], r["upto"], r["next_id"]) for r in got} == {(i, 2 * (500 - i), i - 1 if i else None) for i in range(500)}


def test_quantiles_of_groups_and_of_all(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    at = lambda v, q: sorted(v)[min(int(len(v) * q), len(v) - 1)]
    for r in M.picked_quantiles(df, "s", ["g"]).collect():
        v = [s for g, _, s in rows if g == r["g"]]
        assert (r["p50"], r["p95"]) == (at(v, 0.5), at(v, 0.95))
    r = M.picked_quantiles(df, "s").first()
    assert (r["p50"], r["p95"]) == (at([s for *_, s in rows], 0.5), at([s for *_, s in rows], 0.95))


def test_roc_of_one_class_has_no_rates(spark):
    points = M.roc_points(spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4)], SCHEMA), "y", "s").collect()
    assert all(p["fpr"] is None and p["tpr"] is not None for p in points)


def test_graph_issues(spark):
    graphs = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "doc int, oracle boolean")
    units = spark.createDataFrame([(1, "a", [0, 0, 10, 1000]), (2, "a", [0, 0, 1, 1]), (3, "a", [-1, 0, 1, 1]), (3, "a", [0, 0, 1001, 1])], "doc int, unit string, box array<int>")
    found = lambda ok: {tuple(r) for r in Q.graph_issues(graphs, units, "doc", "unit", "box", "oracle", ok).collect()}
    rest = {(3, "repeated ids", 1), (3, "box out of bounds", 2), (4, "no units", 1)}
    assert found(False) == rest | {(2, "oracle evidence", 1)}
    assert found(True) == rest
