"""Connected components of a graph of document pairs, by contraction, with every step a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` for every vertex of ``edges`` (a, b: bigint); root is the smallest vertex that v reaches.

    In each round every vertex joins the neighbour with the smallest hash, itself included, and the graph of what they
    joined is next. Hashed order makes the graph shrink by a constant factor a round in expectation, chains included.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not maps or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy("a").agg(F.min(key("b")).alias("_m")).select(F.col("a").alias("v"), F.least(F.col("_m"), key("a"))["v"].alias("p"))
        maps.append(joined := materialize(joined))
        # no join reads an aggregate, so a vertex with very many edges is split like any skewed key
        left = edges.join(joined.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").select("b", "pa")
        edges = left.join(joined.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    root = maps.pop()
    while maps:
        upper, root = root.select(F.col("v").alias("p"), F.col("p").alias("_up")), maps.pop()
        root = root.join(upper, "p", "left").select("v", F.coalesce("_up", "p").alias("p"))
    root = materialize(root)
    smallest = materialize(root.groupBy("p").agg(F.min("v").alias("_least")))
    return root.join(smallest, "p").select("v", F.least("_least", "p").alias("root"))
