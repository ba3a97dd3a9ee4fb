"""Connected components of an edge table by alternating star operations; every step is an aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veridoc.llm.common import store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that a node can reach, for every node of an edge between two nodes.

    Large star: each node links its larger neighbours to the smallest node it knows. Small star: each node links its
    smaller neighbours to the smallest of them. Both keep the components, and repeated they end in one star per component
    after few rounds. Smallest neighbours are partial aggregates, so a node with very many links is no single task; joins
    on it can be split. Each round is stored in the shared folder.
    """
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = store(edges.filter(u != v).select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).distinct(), "links")
    while True:
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # All links now go from a larger to a smaller node; the smallest neighbour takes the others of each node.
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(
            F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).distinct()
        after = store(small, "links")
        # A star: no node is both above and below another.
        if after.select("x").join(after.select(F.col("y").alias("x")), "x", "left_semi").isEmpty() and \
                after.groupBy("x").count().filter("count > 1").isEmpty():
            break
        links = after
    return after.select(F.col("x").alias("node"), F.col("y").alias("component")).union(after.select("y", "y").distinct())
