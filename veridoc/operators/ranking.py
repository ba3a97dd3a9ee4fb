"""Ranks inside groups of any size, and one-to-one matching over edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veridoc.session import cut, written

# Above this many rows a single group is ranked by several tasks.
GROUP_LIMIT = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn",
                  limit: int | None = None) -> DataFrame:
    """Number the rows 1.. inside each group; `order` must be total.

    Groups below the limit use a plain window. Otherwise rows are range-sorted by (keys, order),
    so that one hot group is spread over many tasks, and each slice is shifted by the row counts
    of the slices before it.
    """
    limit = GROUP_LIMIT if limit is None else limit
    if largest_group(df, keys) <= limit:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    by = [F.col(k) for k in keys] + list(order)
    slices = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id()))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (slices.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
              .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    return (slices.join(starts.drop("_n"), [*keys, "_part"])
            .withColumn(name, F.col("_shift") + F.col("_at") - F.col("_first") + 1)
            .drop("_part", "_at", "_first", "_shift"))


def kth_with_kth(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column],
                 right_order: list[Column], how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join the k-th left row of a key with the k-th right row of the same key."""
    ranked = rank_in_group(left, keys, left_order, limit=limit)
    return ranked.join(rank_in_group(right, keys, right_order, limit=limit), [*keys, "rn"], how)


def greedy_one_to_one(edges: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """Greedy matching: walk the edges by `order` (ascending), use each endpoint once.

    `order` plus the endpoints is a total order, so repeatedly taking every edge that is the best
    one at both of its ends gives the same matching as the sequential walk. The best edge of an
    endpoint is a partial `min` aggregate, so a hot endpoint never sits in one task.
    """
    rank = F.struct(*dict.fromkeys([*order, *left, *right]))
    open_edges = cut(edges.withColumn("_rank", rank))
    taken = None
    while True:
        best_left = open_edges.groupBy(*left).agg(F.min("_rank").alias("_best")).select("_best")
        best_right = open_edges.groupBy(*right).agg(F.min("_rank").alias("_best")).select("_best")
        found = cut(best_left.join(best_right, "_best").select("_best.*"))
        if found.isEmpty():
            break
        taken = found if taken is None else taken.unionByName(found)
        open_edges = cut(open_edges.join(found.select(*left), left, "left_anti")
                         .join(found.select(*right), right, "left_anti"))
    if taken is None:
        taken = open_edges.select(*dict.fromkeys([*order, *left, *right])).limit(0)
    return taken.select(*left, *right, *[c for c in order if c not in left + right])


def match_by_size(left: DataFrame, right: DataFrame, keys: list[str], reach: int = 50) -> DataFrame:
    """(s, t, gap): greedy matching of `left(*keys, s, n)` and `right(*keys, t, n)` with equal keys and sizes `n` at most `reach` apart.

    The closest sizes come first, then names. Edges of equal sizes come before all others, and where no name of such a class stands
    in another class too, the walk gives the k-th name on one side the k-th on the other: no edge of a class is built, however many
    files have one size. Only what is left, and classes that share names, become edges.
    """
    cls = [*keys, "n"]
    known = lambda side, name: written(side.where(" and ".join(f"{c} is not null" for c in cls)).select(*cls, name).distinct())
    left, right = known(left, "s"), known(right, "t")
    shared = lambda side, name: side.join(side.groupBy(name).count().where(f"count > 1 or {name} is null").select(
        F.col(name).alias("_name")), F.col(name).eqNullSafe(F.col("_name")), "left_semi").select(*cls)
    mixed = written(shared(left, "s").union(shared(right, "t")).distinct())
    alone = lambda side: side.join(mixed, cls, "left_anti")
    equal = written(kth_with_kth(alone(left), alone(right), cls, [F.col("s")], [F.col("t")]).select("s", "t", F.lit(0).alias("gap")))
    left = left.join(equal.select("s"), "s", "left_anti").withColumnRenamed("n", "ns")
    right = right.join(equal.select("t"), "t", "left_anti").withColumnRenamed("n", "nt")
    near = left.withColumn("band", F.explode(F.expr(f"sequence(ns div {reach} - 1, ns div {reach} + 1)"))).join(
        right.withColumn("band", F.expr(f"nt div {reach}")), [*keys, "band"]).where(f"abs(ns - nt) <= {reach}")
    return equal.union(greedy_one_to_one(near.select("s", "t", F.abs(F.col("ns") - F.col("nt")).alias("gap")), ["s"], ["t"], ["gap"]))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`node -> component` (smallest node id of the component).

    `nodes(node)`, `edges(a, b)`. Alternates the large-star and small-star steps: every round hangs
    nodes on the smallest neighbour seen, so the number of rounds grows with the logarithm of the
    longest chain, and only minima per node are aggregated.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .where("hi <> lo").distinct())
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = cut(large.join(near, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                   .union(near.select("hi", F.col("m").alias("lo"))).distinct())
        if star.exceptAll(links).isEmpty() and links.exceptAll(star).isEmpty():
            break
        links = star
    return nodes.join(links.withColumnRenamed("hi", "node"), "node", "left").select(
        "node", F.coalesce("lo", "node").alias("component"))
