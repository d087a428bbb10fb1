"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node it is connected with.

    Each round hooks every node of the remaining graph to its smallest neighbour, halves the pointers until all lead to a root
    and contracts the edges to those between different trees; a tree's root is smaller than its nodes, so the last root is the
    minimum. A node with a smaller neighbour vanishes in its round, so chains and stars in any order take two or three; halving
    takes the logarithm of a tree's depth. Each step is checkpointed; rounds end when no edge is left.
    Neighbours are reduced by a map-side minimum; the joins have one side with a row per node, which Spark can split on the
    other side where a node is hot. NULL ends are ignored; loops give a node its own root.
    """
    edges = cut_lineage(edges.select("u", "v").dropna())
    labels = cut_lineage(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")))
    edges = edges.where("u <> v")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        moving = True
        while moving:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = cut_lineage(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")))
            moving = not parent.where("moved").isEmpty()
            parent = parent.drop("moved")
        to_u = parent.select("u", F.col("p").alias("pu"))
        to_v = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        joined = edges.join(to_u, "u").join(to_v, "v").where("pu <> pv")
        edges = cut_lineage(joined.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        moved = parent.select(F.col("u").alias("root"), F.col("p").alias("up"))
        labels = cut_lineage(labels.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return labels
