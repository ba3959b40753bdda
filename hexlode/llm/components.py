"""Connected components by contraction: every node points to its least neighbour, pointers are jumped, edges are relabelled.

Nodes are compared by hash, so chains shrink by a factor each round whatever their ids. Each round's tables are cut in the
shared folder; nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, keep, scratch


def _undirected(edges: DataFrame) -> DataFrame:
    both = edges.where("u <> v")
    return both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v), where root is one node of its component; nulls are left out."""
    with scratch(edges.sparkSession):
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        left = cut(edges.select("u", "v").where("u is not null and v is not null").distinct())
        labels = cut(left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct()).select("node", F.col("node").alias("root"))
        while not left.where("u <> v").isEmpty():
            least = _undirected(left).groupBy("u").agg(F.min(rank("v")).alias("m"))
            hop = cut(least.select(F.col("u").alias("node"), F.least(rank("u"), F.col("m"))["id"].alias("to")))
            for _ in range(2):
                far = hop.select(F.col("node").alias("to"), F.col("to").alias("far"))
                hop = hop.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
            hop = cut(hop)
            to = lambda df, c: df.join(hop.select(F.col("node").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
            labels = cut(to(labels, "root"))
            left = to(to(left.where("u <> v"), "u"), "v").where("u <> v")
            left = cut(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        return keep(labels)
