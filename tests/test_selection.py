"""Selection by hashes against plain ordering, with a stratum that holds most rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import selection as S


@pytest.fixture(scope="module")
def rows(spark):
    """62 of a hundred rows in one stratum, one stratum null, one of a single row."""
    big = [(i, "big") for i in range(1240)]
    rest = [(10_000 + i, f"s{i % 7}") for i in range(740)] + [(20_000 + i, None) for i in range(19)] + [(30_000, "one")]
    return spark.createDataFrame(big + rest, "id long, g string").repartition(5).cache()


def digest():
    return F.sha2(F.col("id").cast("string"), 256)


def plain(df, by, cuts):
    """The least cut whose first k rows hold a row, by one window a stratum."""
    placed = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(digest(), "id")))
    k = {}
    for r in cuts.collect():
        k.setdefault(tuple(r[c] for c in by), []).append((r.cut, r.k))
    return {r.id: min((c for c, n in k.get(tuple(r[c] for c in by), []) if r.n <= n), default=None) for r in placed.collect()}


@pytest.mark.parametrize(("digits", "cell_rows"), [(4, 100_000), (1, 100_000), (1, 3), (2, 1), (1, 1)])
def test_cuts_equal_an_ordered_stratum(rows, digits, cell_rows):
    for by, cuts in ((["g"], S.share_cuts(rows, ["g"], [0.1, 0.7, 0.85])), (["g"], S.tile_cuts(rows, ["g"], 4)), ([], S.share_cuts(rows, [], [0.33]))):
        got = {r.id: r.cut for r in S.cut_by_hash(rows, "id", by, digest(), cuts, digits=digits, cell_rows=cell_rows).collect()}
        assert got == plain(rows, by, cuts) and len(got) == 2000


def test_quotas_of_zero_and_beyond_the_stratum(spark, rows):
    cuts = spark.createDataFrame([("big", 1, 0), ("big", 2, 5), ("s1", 1, 10_000), (None, 1, 3), ("absent", 1, 4)], "g string, cut int, k long")
    got = S.cut_by_hash(rows, "id", ["g"], digest(), cuts, cell_rows=2, digits=1).groupBy("g", "cut").count().collect()
    held = {(r.g, r.cut): r["count"] for r in got}
    assert ("big", 1) not in held and held["big", 2] == 5 and ("s1", None) not in held and held[None, 1] == 3 and held[None, None] == 16
    assert S.cut_by_hash(rows.limit(0), "id", ["g"], digest(), cuts).count() == 0


def test_tiles_are_those_of_ntile(rows):
    want = {r.id: r.t for r in rows.select("id", F.ntile(4).over(Window.partitionBy("g").orderBy(digest(), "id")).alias("t")).collect()}
    got = S.cut_by_hash(rows, "id", ["g"], digest(), S.tile_cuts(rows, ["g"], 4)).select("id", F.coalesce("cut", F.lit(4)).alias("t"))
    assert {r.id: r.t for r in got.collect()} == want


def test_only_boundary_cells_are_ordered(spark):
    """Among 4,000 rows of one stratum the ordered cell has no more than cell_rows."""
    df = spark.range(4000)
    h = digest()
    cuts = spark.createDataFrame([(1, 1000), (2, 3000)], "cut int, k long")
    ends = {r.cut: (r.d, r.key) for r in S.boundaries(df, "id", [], h, cuts, digits=1, cell_rows=20).collect()}
    order = sorted((hashlib.sha256(str(i).encode()).hexdigest(), i) for i in range(4000))
    assert ends == {1: order[999], 2: order[2999]}
    for d, _ in ends.values():
        assert sum(x.startswith(d[:3]) for x, _ in order) <= 20  # 16^3 cells: what the last round tells apart


def test_shares_are_decimals(spark):
    sizes = (90, 170, 180, 330, 340, 77)  # 0.7 * 90 is 62.99... in doubles
    df = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in sizes])).alias("g")).select("g", F.explode(F.sequence(F.lit(1), "g")).alias("i"))
    got = {(r.g, r.cut): r.k for r in S.share_cuts(df, ["g"], [0.7, 0.85]).collect()}
    assert got == {(n, c): n * s // 100 for n in sizes for c, s in ((1, 70), (2, 85))}
