"""Mixing sources to target weights by thresholds on a hash, found from histograms of sizes by hash bucket.

A source takes every document a whole number of times and, for the rest of its target, once more each document whose hash
lies below a threshold. The threshold is found without sorting: sizes are summed by source and leading hash digit, the
running sum names the one bucket that the budget ends in, and only that bucket is summed by the next digit. Thresholds of
smaller budgets select subsets of what larger ones select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veridoc.llm.common import small, store, word_pattern

#: Fixed values of the mix: weights in order of the sources, total as a share of all sizes, most repeats of a source.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: Hexadecimal digits of the hash, and those that each histogram level reads; the last one reads the hash itself.
HASH_DIGITS = 15
LEVELS = (3, 6, HASH_DIGITS)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(word_pattern)), F.lit(0)).cast("long")


def digits(key: Column, text: Column) -> Column:
    """60 bits of a hash as hexadecimal digits; it depends on key and text only, so reruns agree."""
    whole = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(whole.cast("binary")), 1, HASH_DIGITS)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size and hash of each document."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.select(k.alias("key"), F.col(f"`{source}`").cast("string").alias("source"), words(t).alias("size"),
                       digits(k, t).alias("digits"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. A source stops at `repeats` times its size; what it leaves
    is shared by weight among the others. The sources fill up in the order of size per weight, so the level at which the
    others stand follows from running sums; sources are few beside documents and meet in one task.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), turn + 1))
    weighed = weighed.withColumn("stop", F.col("source_size") * F.lit(float(repeats)))
    filling = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    ahead = filling.rowsBetween(W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("stop").over(ahead), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))))
    # The first source that the level does not fill, and all after it, stand at that source's level.
    held = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("stop"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(W.unboundedPreceding, W.currentRow))
    return held.withColumn("at", first).select(
        "source", "source_size", F.coalesce(F.col("at") * F.col("w"), F.col("stop")).alias("target"))


def mix_plan(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): how often a source is taken whole, and the hash below which once more.

    `sizes` (see `sized`) should be a stored table. The histograms hold at most 4096 rows of a source; the last level has a
    row for each hash of the boundary bucket, one in 2**24. Documents of one hash stay together, on the side that leaves
    the sum nearer to the target (taken if both are as near).
    """
    histogram = store(_sums(sizes, LEVELS[0]), "mix-sums")
    goal = targets(histogram.groupBy("source").agg(F.sum("n").alias("source_size")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = store(goal.withColumn("times", times), "mix-goal")
    rest = goal.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("rest"))
    sums = _null_safe(histogram, rest, ["source"])
    for at, digits in enumerate(LEVELS):
        order = W.partitionBy("source").orderBy("bucket")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = sums.withColumn("before", before).filter(
            (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        if digits == LEVELS[-1]:
            break
        boundary = store(hit.select("source", "bucket", (F.col("rest") - F.col("before")).alias("rest")), "mix-boundary")
        inside = _null_safe(sizes.withColumn("bucket", F.substring("digits", 1, digits)), boundary, ["source", "bucket"])
        sums = _sums(inside, LEVELS[at + 1], "rest")
    # "g" comes after all hexadecimal digits: the boundary hash itself is then below.
    over = F.col("before") + F.col("n") - F.col("rest") <= F.col("rest") - F.col("before")
    below = hit.select("source", F.when(over, F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket")).alias("below"))
    return store(_null_safe(goal, below, ["source"], "left").withColumn("below", F.coalesce("below", F.lit(""))), "mix-plan")


def _sums(sizes: DataFrame, digits: int, *more: str) -> DataFrame:
    return sizes.groupBy("source", F.substring("digits", 1, digits).alias("bucket"), *more).agg(F.sum("size").alias("n"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null sources are equal; the right side is broadcast if its size is below the limit."""
    other = small(right.select(*(F.col(c).alias(f"{c}_") if c in keys else F.col(c) for c in right.columns)))
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"{k}_"])
    return left.join(other, on, how).drop(*(f"{k}_" for k in keys))


def _repeats() -> Column:
    return F.col("times") + (F.col("digits") < F.col("below")).cast("long")


def taken(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """`sizes` with the plan's columns, repeats (how often a document is taken) and taken (its words, repeats counted)."""
    return _null_safe(sizes, plan, ["source"]).withColumn("repeats", _repeats()).withColumn("taken", F.col("size") * F.col("repeats"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, repeats, taken) of every row; other columns are not read.

    A null text has size 0; null keys and null sources are values like others. Rows equal in key and text share a hash and
    are taken alike. A source without words has target 0 and takes nothing. An empty table gives an empty one.
    """
    sizes = store(sized(docs, key, text, source), "mix-sizes")
    return taken(sizes, mix_plan(sizes)).select("key", "source", "size", "source_size", "target", "repeats", "taken")


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: not, once or twice."""
    plan = mix_plan(store(sized(docs, key, text, source), "mix-sizes"))
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(f"`{source}`").cast("string").alias("source"), digits(k, t).alias("digits"))
    copies = F.explode(F.array_repeat(F.lit(1), _repeats().cast("int")))
    return _null_safe(rows, plan, ["source"]).select("row", copies).select("row.*")
