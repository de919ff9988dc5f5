"""Connected components of an edge table: hook to the least neighbour, jump to the root, contract the edges; each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import materialize

#: Rounds before the input counts as broken; every round leaves at most half of the nodes of a component that has edges.
ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node reachable) for every node of the edges.

    A node that hooks to its least neighbour is no root, and no two roots are neighbours, so the
    edges between roots, which the next round works on, dwindle. A hub with many edges is spread by
    partial minima on its own side, and on the other side its label travels by a join that AQE
    splits. Nothing is gathered on the driver but whether anything is left.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(ROUNDS):
        near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        roots = _roots(materialize(near.select("node", F.least("node", "m").alias("label")), "hooks"))
        low = roots.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        if labels is None:
            labels = roots
        else:
            labels = materialize(labels.join(low, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label")), "labels")
        one, two = (roots.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        left = e.join(one, "a").join(two, "b").filter("la <> lb")
        e = materialize(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if e.isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")


def _roots(hooks: DataFrame) -> DataFrame:
    """node and the root of its tree, for hooks (node, label) of each node to a smaller one or itself: the way to go halves with each jump."""
    while True:
        up = hooks.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        jumped = materialize(hooks.join(up, F.col("label") == F.col("__n")).select("node", F.col("label").alias("old"), F.col("__l").alias("label")), "hooks")
        hooks = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return hooks
