"""Connected components of a graph given as a DataFrame of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that it is linked with, itself included.

    Each round is one aggregate and one join on narrow rows, and its result is written to the shared folder, so the lineage stays
    short and a lost executor costs one round. Rounds grow with the logarithm of a component's size.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: each larger neighbour of u is linked to the smallest node around u.
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-min")
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialize(large, "cc-large")
        # Small star: each smaller neighbour of u, and u, are linked to the smallest of them.
        least = materialize(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "cc-least")
        small = large.join(least, large["b"] == least["u"]).select(F.col("m"), "a", "b")
        linked = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        after = materialize(linked, "cc-edges")
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        for old in (now, low, large, least):
            forget(old.sparkSession, old)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
