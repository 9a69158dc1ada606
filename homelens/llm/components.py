"""Connected components by alternating large-star and small-star rounds on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.llm import storage


def _lowest(pairs: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each u, as a table of its own: joins with it can then split hot nodes."""
    return storage.materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node points to one other that points nowhere: then the edges are the components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).filter("out + met > 1").isEmpty()


def connected_components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); a component is named by its smallest node.

    Each round makes two tables of at most as many edges as before; it ends when the edges are stars.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    a, b = edges.columns
    flat = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = storage.materialize(flat, "edges")
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "large-star").withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = storage.materialize(large, "large-edges")
        low = _lowest(large, "small-star")
        joined = large.join(low, "u")
        small = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = storage.materialize(small, "small-edges")
        if _are_stars(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
