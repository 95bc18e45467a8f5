"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Loops and repeated edges are fine; edges with a null end are ignored. Each
    round sends an edge to the minimum of its end's neighbours; rows stay at one
    per edge, minima are pre-aggregated, and the edges live in the checkpoint
    folder between rounds. An empty table gives an empty result.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    edges = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(hi, lo).distinct())
    before = _sum_of(edges)
    while before[0]:
        # Large star: a node's larger neighbours move to its least neighbour. Only nodes that have a smaller one change.
        least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        moved = edges.withColumnRenamed("lo", "node").join(least, "node", "left")
        moved = moved.select("hi", F.coalesce("least", "node").alias("lo"))
        large = moved.unionByName(least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = checkpointed(small.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct())
        after = _sum_of(edges)
        if after == before:
            break
        before = after
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    )
