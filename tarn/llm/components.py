"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is one aggregation and one join, so no node's neighbours are ever collected together and a node with very
many edges is only a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.materialize import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type -> (u, root) for every node that has an edge and is not its own root.

    ``root`` is the smallest node of the component. Self-loops, repeated edges and nulls are dropped first.
    """
    edges = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after
