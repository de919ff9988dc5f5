"""The first rows of each stratum in an order of hashes, without ordering a stratum: histograms of prefixes, exact order in boundary cells only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.operators.relations import maybe_broadcast, quotas, settled

#: Hex digits that a round of histograms tells apart.
DIGITS = 4
#: A cell with no more rows than this is ordered; larger ones are told apart by their next digits.
CELL_ROWS = 100_000


def _stratum(by: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")


def boundaries(df: DataFrame, key: str, by: list[str], digest: Column, cuts: DataFrame, digits: int = DIGITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """s, cut, d, key: the k-th row of each stratum by (digest, key), for each of its cuts (by, cut, k); the last row where k is beyond it.

    A round sums a histogram of the next digits of each stratum, of which there are 16^digits cells at
    most, and keeps the cell of each cut. Only rows of those cells are looked at again, and only cells
    within `cell_rows` are ordered. digest: hexadecimal, and so spread that equal ones are rare.
    """
    rows = df.select(_stratum(by).alias("s"), digest.alias("d"), F.col(key).alias("key"))
    sizes = rows.groupBy("s").agg(F.count("*").alias("c"))
    left = cuts.select(_stratum(by).alias("s"), "cut", F.col("k").cast("bigint").alias("k")).join(sizes, "s")
    left = left.select("s", "cut", F.least("k", "c").alias("k"), F.lit("").alias("p")).filter("k > 0")
    left = settled(left.withColumn("c", F.lit(cell_rows + 1).cast("bigint")))
    depth, whole = 0, 64
    done = left.filter("c <= 0")
    while depth < whole and not (wide := left.filter(F.col("c") > cell_rows)).isEmpty():
        cells = wide.select("s", "p").distinct()
        near = rows.withColumn("p", F.substring("d", 1, depth)).join(maybe_broadcast(cells), ["s", "p"])
        histogram = near.groupBy("s", "p", F.substring("d", 1, depth + digits).alias("q")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s", "p").orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
        found = wide.join(histogram.withColumn("upto", upto), ["s", "p"]).filter((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n")))
        found = found.select("s", "cut", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k"), F.col("q").alias("p"), F.col("n").alias("c"))
        done = done.unionByName(left.filter(F.col("c") <= cell_rows))
        left = settled(found)
        depth += digits
    ends = settled(done.unionByName(left))
    size = F.length("p")
    depths = [r[0] for r in ends.select(size.alias("n")).distinct().collect()]  # one a round
    out = None
    for n in depths:
        mine = ends.filter(size == n)
        near = rows.withColumn("p", F.substring("d", 1, n)).join(maybe_broadcast(mine.select("s", "p").distinct()), ["s", "p"])
        placed = near.withColumn("at", F.row_number().over(Window.partitionBy("s", "p").orderBy("d", "key")))
        one = placed.join(maybe_broadcast(mine.select("s", "p", "cut", "k")), ["s", "p"]).filter("at = k").select("s", "cut", "d", "key")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select("s", F.lit(0).alias("cut"), "d", "key").limit(0)


def cut_by_hash(df: DataFrame, key: str, by: list[str], digest: Column, cuts: DataFrame, name: str = "cut", digits: int = DIGITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with `name`: the first cut (by, cut, k; k rises with cut) whose first k rows of the stratum hold the row, null beyond all.

    Rows are in the order of (digest, key); keys are unique. Every row is compared with its stratum's
    boundary rows, of which there is one a cut.
    """
    ends = boundaries(df, key, by, digest, cuts, digits, cell_rows)
    ends = ends.groupBy(F.col("s").alias("__s")).agg(F.array_sort(F.collect_list(F.struct("cut", "d", "key"))).alias("__ends"))
    joined = df.withColumns({"__s": _stratum(by), "__d": digest}).join(maybe_broadcast(settled(ends)), "__s", "left")
    here = F.struct(F.col("__d").alias("d"), F.col(key).alias("key"))
    first = F.get(F.filter("__ends", lambda e: F.struct(e["d"].alias("d"), e["key"].alias("key")) >= here), F.lit(0))["cut"]
    return joined.withColumn(name, first).drop("__s", "__d", "__ends")


def share_cuts(df: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Cuts 1, 2, ... at the whole parts of cumulated shares of each stratum's size, taken as the decimals that they are written as: 0.7 of 90 is 63."""
    each = F.array(*[F.struct(F.lit(i).alias("cut"), F.floor(F.col("c") * F.lit(Decimal(str(s)))).cast("bigint").alias("k")) for i, s in enumerate(shares, 1)])
    return df.groupBy(*by).agg(F.count("*").alias("c")).select(*by, F.explode(each).alias("x")).select(*by, "x.*")


def tile_cuts(df: DataFrame, by: list[str], tiles: int) -> DataFrame:
    """Cuts of equal tiles, the first ones with a row more where they don't come out even; the last tile has none."""
    c = F.col("c")
    each = F.transform(F.sequence(F.lit(1), F.lit(tiles - 1)), lambda i: F.struct(i.alias("cut"), (F.floor(c / tiles) * i + F.least(i, c % tiles)).alias("k")))
    return df.groupBy(*by).agg(F.count("*").alias("c")).select(*by, F.explode(each).alias("x")).select(*by, "x.*")


def stratified_split(df: DataFrame, key: str, stratum: str, total: int, seed: str) -> DataFrame:
    """df with selected: the quota of each stratum, the rows with the smallest stable hashes."""
    q = quotas(df.groupBy(stratum).agg(F.count("*").alias("size")), "size", total, stratum)
    cuts = q.select(stratum, F.lit(1).alias("cut"), F.col("quota").alias("k"))
    return cut_by_hash(df, key, [stratum], stable_hash(F.col(key), seed=seed), cuts, "selected").withColumn("selected", F.col("selected").isNotNull())
