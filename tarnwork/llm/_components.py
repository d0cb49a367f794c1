"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Each round hooks every vertex to the neighbour of smallest random priority and
    contracts the graph; stars vanish in two rounds and long chains in a number of
    rounds logarithmic in their length.  The priority ``xxhash64`` of one long is a
    bijection, so no two nodes are ever mixed up.  Only pre-aggregated minima and
    skew-splittable joins are shuffled; nothing goes to the driver but whether edges
    are left.  Self-loops make one-node components; rows with a null are no edges.
    """
    raw = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    raw = shared_table(raw.distinct(), "edges")
    nodes = raw.select(F.col("a").alias("node")).union(raw.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.xxhash64("node").alias("label"))
    now = raw.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).where("u <> v")
    while not now.isEmpty():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        hook = shared_table(hook, "hooks")
        left, right = hook.toDF("u", "pu"), hook.toDF("v", "pv")
        now = now.join(left, "u").join(right, "v").where("pu <> pv")
        now = now.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        now = shared_table(now, "contracted")
        step = hook.toDF("label", "next")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = shared_table(labels, "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
