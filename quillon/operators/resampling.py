"""Draws by weight, and confidence intervals of means by resampling."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metrics import running
from quillon.operators.relations import settled
from quillon.shipping import ship

RESAMPLES = 2000
ALPHA = 0.05
#: Fixed value: the seed of intervals that must repeat.
SEED = 20260609
#: Values that one exact resampling may have; more go by Poisson weights.
MOST_VALUES = 200_000


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """draw (0 to n-1) and key of n draws with replacement, each row as likely as its share of the weights.

    A draw is a hashed number on the cumulated weights in the order of keys. Rows and draws are dealt
    into ranges of that line together, so that a row with most of the weight is drawn in many tasks; in a
    range each draw takes the last row that begins before it, the first ones that of the range
    before. Rows with a null weight or none are never drawn; without weights there are no draws.
    """
    rows = df.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).filter("w > 0")
    ends = settled(running(rows, [F.col("key")], {"hi": "w"}).select("key", (F.col("hi") - F.col("w")).alias("x"), "hi"))
    total = ends.agg(F.max("hi").alias("total")).filter("total IS NOT NULL")
    digits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), 256), 1, 13), 16, 10)
    draws = df.sparkSession.range(n).join(F.broadcast(total)).select(F.col("id").alias("draw"), (digits.cast("double") / float(16**13) * F.col("total")).alias("x"))
    line = ends.select("x", "key", F.lit(None).cast("bigint").alias("draw")).unionByName(draws.select("x", F.lit(None).cast(ends.schema["key"].dataType).alias("key"), "draw"))
    order = [F.col("x"), F.col("draw").asc_nulls_first()]
    dealt = settled(line.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.last("key", ignorenulls=True).over(before))
    last = dealt.groupBy("part").agg(F.max_by("key", F.when(F.col("draw").isNull(), F.col("x"))).alias("last"))  # one row a range
    carried = last.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return found.filter("draw IS NOT NULL").join(F.broadcast(carried), "part").select("draw", F.coalesce("own", "carried").alias(key))


def _indices(n: int, size: int, stream: np.random.MT19937):
    """Yield `size` numbers below n at a time, as random.Random draws them: leading bits of each 32, those from n on passed over."""
    shift, left = np.uint64(32 - n.bit_length()), np.zeros(0, np.int64)
    while True:
        while len(left) < size:
            raw = stream.random_raw(max(1024, 2 * (size - len(left)))) >> shift
            left = np.concatenate([left, raw[raw < n].astype(np.int64)])
        yield left[:size]
        left = left[size:]


def mersenne_interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> tuple[float, float]:
    """Bounds of the resampled means of values, in their order; (0, 0) of none. The draws are those of random.Random(seed)."""
    n = len(values)
    if not n:
        return 0.0, 0.0
    _, words, _ = random.Random(seed).getstate()
    stream = np.random.MT19937()
    stream.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[:-1], np.uint32), "pos": words[-1]}}
    drawn = _indices(n, n, stream)
    means = np.sort([values[next(drawn)].mean() for _ in range(resamples)])
    return float(means[int(alpha / 2 * (resamples - 1))]), float(means[int((1 - alpha / 2) * (resamples - 1))])


def exact_intervals(rows: DataFrame, value: str, key: str, by: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, most: int = MOST_VALUES) -> DataFrame:
    """by, n, mean, low, high of each group, resampled exactly in the order of key; an error where a group has more than `most` values."""
    ship(rows.sparkSession)
    held = rows.select(F.col(by).alias("by"), F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    wide = held.groupBy("by").count().filter(F.col("count") > most).take(1)
    if wide:
        raise ValueError(f"{by}={wide[0]['by']!r} has {wide[0]['count']} values; exact resampling takes {most}")

    def interval(table: pa.Table) -> pa.Table:
        v = np.asarray(table.sort_by("key")["v"])
        low, high = mersenne_interval(v, resamples, seed, alpha)
        return pa.table([table["by"].slice(0, 1), pa.array([len(v)], pa.int64()), *[pa.array([x], pa.float64()) for x in (v.mean(), low, high)]], ["by", "n", "mean", "low", "high"])

    kind = held.schema["by"].dataType.simpleString()
    return held.groupBy("by").applyInArrow(interval, f"by {kind}, n bigint, mean double, low double, high double").withColumnRenamed("by", by)


# The Poisson distribution of mean 1, cumulated.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def _weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """A Poisson weight of each row in each resample, from a hash of both."""
    x = (keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(resamples, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    out = np.zeros(x.shape, np.float64)
    for cut in _POISSON:
        out += x >= np.uint64(int(cut * 2**64))
    return out


def poisson_intervals(rows: DataFrame, value: str, key: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """n, mean, low, high of any number of values: every row has its own Poisson weight in each resample.

    A task sums weights and weighted values in arrays of one number a resample, and emits one row;
    the arrays are added up place by place. key (64 bits) decides on the weights, so reruns agree.
    """
    ship(rows.sparkSession)
    held = rows.select(F.xxhash64(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")

    def summed(batches):
        n, total, w, wv = 0, 0.0, np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            keys, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            n, total = n + len(v), total + float(v.sum())
            for i in range(0, len(v), 256):
                weight = _weights(keys[i : i + 256], resamples, seed)
                w += weight.sum(0)
                wv += v[i : i + 256] @ weight
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total]), pa.array([w.tolist()]), pa.array([wv.tolist()])], ["n", "total", "w", "wv"])

    tasks = held.mapInArrow(summed, "n bigint, total double, w array<double>, wv array<double>").filter("n > 0")
    flat = tasks.select("n", "total", F.posexplode(F.arrays_zip("w", "wv")).alias("r", "x"))  # one row a task and resample
    per = flat.groupBy("r").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("x.wv") / F.nullif(F.sum("x.w"), F.lit(0.0))).alias("m"))
    means = per.agg(F.max("n").alias("n"), F.max("total").alias("total"), F.array_sort(F.collect_list("m")).alias("m"))  # resamples numbers
    place = lambda share: F.get("m", F.floor(F.lit(share) * (F.size("m") - 1)).cast("int"))
    return means.filter("n IS NOT NULL").select("n", (F.col("total") / F.col("n")).alias("mean"), place(alpha / 2).alias("low"), place(1 - alpha / 2).alias("high"))


def chi_square(observed: Column, expected: Column) -> Column:
    """An aggregate: the sum of squared differences over what was expected."""
    return F.sum((observed - expected) * (observed - expected) / expected)
