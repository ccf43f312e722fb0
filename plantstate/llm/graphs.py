"""Connected components by contraction, on Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import stage


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: every node of edges (a, b) with the smallest node of its component.

    Each round every node points to the smallest of its neighbours and itself, pointers are
    doubled, and edges are redrawn between the nodes pointed to; their number shrinks by a
    constant factor. Minima are taken before the shuffle, so hubs are no bottleneck."""
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    label = stage(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    for _ in range(most):
        if e.isEmpty():
            return label
        up = e.select("a", "b").union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        up = stage(up, "up")
        for _ in range(2):
            over = up.select(F.col("a").alias("low"), F.col("low").alias("lower"))
            up = up.join(over, "low").select("a", F.col("lower").alias("low"))
        up = stage(up, "up")
        to = up.select(F.col("a").alias("root"), "low")
        label = stage(label.join(to, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "roots")
        a, b = up.select("a", F.col("low").alias("x")), up.select(F.col("a").alias("b"), F.col("low").alias("y"))
        moved = e.join(a, "a").join(b, "b").where("x <> y")
        e = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise ValueError(f"components still grow after {most} rounds")
