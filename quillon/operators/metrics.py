"""Metrics of binary scores and of score sequences, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relations import maybe_broadcast, settled


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], ahead: tuple[str, ...] = ()) -> DataFrame:
    """rows with running sums (new name: column) in a global order, and next_<column> for those in `ahead`.

    Rows are dealt into ranges and written, as range bounds are sampled; a range is summed on its own
    and shifted by the totals of the ranges before it, of which there is one row a partition.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select("*", *[F.sum(c).over(run).alias(f"__{k}") for k, c in sums.items()], *[F.lead(c).over(w).alias(f"__next_{c}") for c in ahead])
    placed = dealt.withColumn("__n", F.row_number().over(w)) if ahead else dealt
    ends = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()], *[F.min_by(c, "__n").alias(f"__f_{c}") for c in ahead])
    parts = Window.orderBy("__part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums], *[F.lead(f"__f_{c}").over(parts).alias(f"__a_{c}") for c in ahead])
    out = inner.join(F.broadcast(shift), "__part")
    return out.select(*rows.columns, *[(F.col(f"__{k}") + F.col(f"__b_{k}")).alias(k) for k in sums], *[F.coalesce(f"__next_{c}", f"__a_{c}").alias(f"next_{c}") for c in ahead])


def auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ROC AUC by rank sums with mean ranks for ties, 0.5 without both classes.

    Rows are counted per score first; distinct scores are ordered in ranges, and a group's own sums
    are those of the whole order less what stands before the group.
    """
    by = by or []
    per = rows.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    r = running(per, [F.col(c) for c in [*by, "s"]], {"upto": "neg"})
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    twice = F.sum(exact(F.col("pos"), 18) * exact(2 * F.col("upto") - F.col("neg"), 19))
    start = exact(2 * F.min(F.col("upto") - F.col("neg")), 19)
    p, n = F.sum("pos"), F.sum("neg")
    wins = (twice - start * exact(p, 18)).cast("double") / 2
    return r.groupBy(*by).agg(F.when((p > 0) & (n > 0), wins / (p.cast("double") * n)).otherwise(F.lit(0.5)).alias("auc"))


def roc_points(rows: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr over falling distinct scores, from the point (0, 0); collinear inner points dropped."""
    per = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    cum = running(per, [F.col("threshold").desc()], {"tp": "p", "fp": "q"}, ahead=("p", "q"))
    bend = (F.col("p") != F.col("next_p")) | (F.col("q") != F.col("next_q"))
    kept = cum.filter(F.coalesce(bend, F.lit(True))).select("threshold", "tp", "fp")
    first = rows.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = first.union(kept)
    ends = points.agg(F.nullif(F.max("tp"), F.lit(0)).alias("__p"), F.nullif(F.max("fp"), F.lit(0)).alias("__q"))
    return points.join(F.broadcast(ends)).select("threshold", "tp", "fp", (F.col("tp") / F.col("__p")).alias("tpr"), (F.col("fp") / F.col("__q")).alias("fpr"))


def equal_error_rate(points: DataFrame) -> DataFrame:
    """False positive rate where it is nearest to the false negative rate, the first such point."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    return points.agg(F.min(F.struct(F.round(gap, 12).alias("gap"), (-F.col("threshold")).alias("t"), "fpr", "tpr")).alias("b")).select(F.col("b.fpr").alias("eer"), ((F.col("b.fpr") + 1 - F.col("b.tpr")) / 2).alias("eer_mean"))


def tpr_at_fpr(points: DataFrame, target: float = 0.01) -> DataFrame:
    """True positive rate at a false positive rate, between the points around it; of the first real point if that lies beyond."""
    # fpr rises as the threshold falls, so the point before the target is the lowest below it
    real, point = F.col("threshold") < float("inf"), F.struct("threshold", "fpr", "tpr")
    first = F.max(F.when(real, point))
    at = F.max(F.when(real & (F.col("fpr") >= target), point))
    last = F.min(F.when(F.col("fpr") < target, point))
    between = last["tpr"] + (at["tpr"] - last["tpr"]) * (target - last["fpr"]) / F.nullif(at["fpr"] - last["fpr"], F.lit(0.0))
    return points.agg(F.when(first["fpr"] >= target, first["tpr"]).otherwise(F.coalesce(between, at["tpr"])).alias("tpr"))


def confusion(label: str, found: str) -> list[Column]:
    y, p = F.col(label), F.col(found)
    one = lambda a, b: F.sum(((y == a) & (p == b)).cast("long"))
    tp, fp, fn, tn = one(1, 1), one(0, 1), one(1, 0), one(0, 0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    f1 = lambda a, b, c: share(2 * a, 2 * a + b + c)
    n = tp + fp + fn + tn
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), share(tp + tn, n).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("specificity"), share(f1(tp, fp, fn) * (tp + fn) + f1(tn, fn, fp) * (tn + fp), n).alias("weighted_f1")]


def calibration_error(rows: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean gap of score and label over equal bins, weighted by their rows; the last bin is closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def sequence_scores(rows: DataFrame, by: str, at: str, score: str) -> DataFrame:
    """by, mean_score, gated_score (steady sequences count 0.7 at least), drift_score (sigmoid of mean and rising slope)."""
    g = rows.groupBy(by).agg(F.count("*").alias("frames"), F.avg(score).alias("m"), F.stddev_pop(score).alias("sd"), F.regr_slope(F.col(score).cast("double"), F.col(at).cast("double")).alias("k"))
    gated = F.when((F.col("frames") >= 2) & (F.col("sd") < 0.1), F.greatest("m", F.lit(0.7))).otherwise(F.col("m"))
    drift = F.when(F.col("frames") < 2, F.col("m")).otherwise(1 / (1 + F.exp(-(F.col("m") + 3 * F.greatest(F.lit(0.0), F.coalesce("k", F.lit(0.0)))))))
    return g.select(by, "frames", F.col("m").alias("mean_score"), gated.alias("gated_score"), drift.alias("drift_score"))


STRATEGIES = {"mean": "mean_score", "variance": "gated_score", "drift": "drift_score"}


def picked_quantiles(rows: DataFrame, value: str, by: list[str] | None = None, quantiles=(0.5, 0.95)) -> DataFrame:
    """The values at place int(q * n) of the ordered values, not interpolated."""
    by = by or []
    keys = {c: f"__k{i}" for i, c in enumerate(by)}
    per = rows.groupBy(*[F.col(c).alias(k) for c, k in keys.items()], F.col(value).alias("v")).agg(F.count("*").alias("c"))
    r = running(per, [F.col(k) for k in [*keys.values(), "v"]], {"upto": "c"})
    # places of the whole order, counted from where the group starts
    groups = r.groupBy(*[F.col(k).alias(f"g{k}") for k in keys.values()]).agg(F.min(F.col("upto") - F.col("c")).alias("start"), F.sum("c").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"g{k}")) for k in keys.values()]
    j = r.join(maybe_broadcast(groups), same or None).select(*[F.col(k).alias(c) for c, k in keys.items()], "v", (F.col("upto") - F.col("start")).alias("to"), "c", "n")
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    return j.groupBy(*by).agg(*[F.max(F.when((F.col("to") - F.col("c") <= at(q)) & (at(q) < F.col("to")), F.col("v"))).alias(f"p{round(q * 100)}") for q in quantiles])

