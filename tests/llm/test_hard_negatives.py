from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, vector array<bigint>"


def plain(rows, every=50, positives=5, negatives=3):
    """Brute force over Python integers."""
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        score = {b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(va, vb, strict=False)))) for b, (_, vb) in best.items() if b != a}
        first = lambda ids, k: sorted(ids, key=lambda b: (-score[b], b))[:k]  # noqa: E731, B023
        for p in first([b for b in score if best[b][0] == la], positives):
            inside = [b for b in score if best[b][0] != la and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(first(inside, negatives), 1)]
    return sorted(out)


def mined(spark, rows, every=50, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(0), "id": F.lit(1), "label2": F.lit(1)})
    return sorted(tuple(r) for r in H.mine(df, f"id % {every} = 0", **options).collect())


def random_rows(r, n, dims=6, most=40, labels=4):
    return [(r.randint(-50, 400) * 5, r.randrange(labels), [r.randint(-most, most) for _ in range(dims)]) for _ in range(n)]


@pytest.mark.parametrize("cells", [(7, 5), (512, 1024)])
def test_equals_brute_force(spark, cells):
    r = random.Random(4)
    rows = random_rows(r, 250)
    got = mined(spark, rows, rows_a_cell=cells[0], anchors_a_cell=cells[1])
    assert got == plain(rows) and len(got) > 50


def test_ties_are_broken_by_id_over_many_rounds(spark):
    """A third of the rows and more are one vector, with ids far apart, so that the bits of ids decide."""
    r = random.Random(5)
    ids = sorted({r.randint(-(2**62), 2**62) for _ in range(120)})
    rows = [(i - i % 50 if k % 9 == 0 else i | 1, k % 2, [3, 4] if k % 3 else [r.randint(0, 4), r.randint(0, 4)]) for k, i in enumerate(ids)]
    rows += [(2**63 - 1, 0, [3, 4]), (-(2**63), 1, [3, 4])]
    got = mined(spark, rows, rows_a_cell=11, anchors_a_cell=4)
    assert got == plain(rows) and got


def test_odd_rows(spark):
    r = random.Random(6)
    rows = random_rows(r, 60) + [(None, 1, [1, 2]), (100, None, [1, 2]), (150, 1, None), (200, 2, [None, 1]), (250, 1, []), (300, 1, [5]), (350, 0, [9] * 9), (350, 0, [9] * 9), (350, 1, [8] * 9)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] == mined(spark, [(50, 1, [1])])
    big = 2**27
    huge = [(50 * k, k % 2, [big * (k + 1), -big + k, 3]) for k in range(12)]
    assert mined(spark, huge) == plain(huge) and len(plain(huge)) > 5
    beyond = [(i, k, [x * 2**20 for x in v]) for i, k, v in huge]
    assert mined(spark, beyond) == plain(beyond)


def test_quantised_components(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([1e30],)], "v array<float>")
    assert [r[0] for r in df.select(H.quantised(F.col("v"))).collect()] == [[128, -1], None, None, None, None, [2**63 - 1]]


def test_no_more_than_k_buckets_leave_a_cell(spark):
    """Histograms are cut where the cell alone has enough rows, and sums are all that is shuffled by window."""
    r = random.Random(7)
    rows = random_rows(r, 400, labels=2)
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), "label", F.col("vector").alias("v")).dropDuplicates(["id"])
    grid = H._Grid(df, "id % 50 = 0", 64, 8)
    bound = (F.col("norm") * grid.norm + 1).cast("bigint")
    state = grid.anchors.select("aid", F.col("aid").alias("win"), *H._window(True, -bound, bound, 5))
    cells = grid.met(state, H._histogram, H._HIST)
    assert cells.count() <= 5 * state.count() * grid.row_blocks
    assert cells.groupBy("aid").agg(F.sum("n").alias("n")).filter("n < 5").count() == 0
