"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a hash for a key, and the key goes to the shard whose draw, scaled by its weight, is best. Draws of one
shard do not depend on the others, so a further shard takes records from all of them and moves none between them. Inside its
shard a record has a slot: buckets of the key's digest are counted, running sums give where a bucket starts, and rows are
numbered inside buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from veridoc.llm.common import place, small, store, stored

#: Bytes that a record takes beside its text.
FRAME_BYTES = 16
#: Repeated rows that one row of the expansion carries.
COPIES_PER_ROW = 10_000


def key_text(key: Column) -> Column:
    """The key as text; a null key is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """log(u) / weight with u in (0, 1) from 52 bits of a digest of shard and key: the largest draw wins."""
    bits = F.conv(F.substring(F.md5(F.concat(shard.cast("string"), F.lit(":"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def best(key: Column, weights: dict[int, float]) -> Column:
    """(draw, shard) of the winner among shards with weights above zero; the smaller shard wins a tie."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights above zero are needed")
    table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(weights.items())))
    top = F.array_max(F.transform(table, lambda x: F.struct(draw(key, x["s"], x["w"]).alias("draw"), (-x["s"]).alias("back"))))
    return F.struct(top["draw"].alias("draw"), (-top["back"]).cast("int").alias("shard"))


def assign(docs: DataFrame, weights: dict[int, float], more: dict[int, float] | None = None, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard) of every row; nothing is shuffled.

    size is the bytes of the text and of a frame. grown_shard is the shard once those of `more` are added (the same shard if
    none): one of them or the former one. A null text has no bytes; a null key is placed like the empty text.
    """
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    body = F.coalesce(t, F.lit("")).cast("binary")
    rows = docs.select(k.alias("key"), (F.octet_length(body) + FRAME_BYTES).cast("long").alias("size"),
                       F.crc32(body).cast("long").alias("text_crc32"), key_text(k).alias("name"))
    rows = rows.withColumn("now", best(F.col("name"), weights))
    grown = F.col("now.shard")
    if more:
        rows = rows.withColumn("then", best(F.col("name"), more))
        better = (F.col("then.draw") > F.col("now.draw")) | ((F.col("then.draw") == F.col("now.draw")) & (F.col("then.shard") < F.col("now.shard")))
        grown = F.when(better, F.col("then.shard")).otherwise(grown)
    return rows.select("key", "size", "text_crc32", F.col("now.shard").alias("shard"), grown.alias("grown_shard"))


def slot_order(key: Column, crc: Column, size: Column) -> list[Column]:
    """Order of the records of a shard; the first column is the bucket, one of 4096. A key in very many records has 16 of them."""
    digest = F.md5(key_text(key).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") * 16 + F.shiftright(crc, 28).cast("int")
    return [bucket, digest, crc, size, key.asc_nulls_first()]


def slots(rows: DataFrame) -> DataFrame:
    """`rows` of `assign` with `slot`, gapless from 0 in each shard and the same for the same records however they lie.

    Equal rows are counted first, so a record that is a third of all is one row until it is expanded again, in parts.
    """
    names = rows.columns
    bucket, *order = slot_order(F.col("key"), F.col("text_crc32"), F.col("size"))
    groups = store(rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("bucket", bucket), "shard-groups")
    counts = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = store(counts.select("shard", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start")), "shard-starts")
    inside = W.partitionBy("shard", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.join(small(starts), ["shard", "bucket"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    one = placed.filter("n = 1").select(*names, F.col("start").alias("slot"))
    part = F.expr(f"explode(sequence(0L, n - 1, {COPIES_PER_ROW}L))")
    parts = placed.filter("n > 1").select(*names, "start", "n", part.alias("part")).repartition(*names, "part")
    last = F.col("start") + F.least(F.col("n"), F.col("part") + COPIES_PER_ROW) - 1
    many = parts.select(*names, F.explode(F.sequence(F.col("start") + F.col("part"), last)).alias("slot"))
    return one.unionByName(many)


def shard(docs: DataFrame, weights: dict[int, float], more: dict[int, float] | None = None, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of every row; other columns are not read.

    Repeated rows lie in one shard on neighbouring slots; rows of one key share a shard whatever their texts. An empty table
    gives an empty one. A key that is a third of all rows fills its shard, as its place may depend on nothing else; its rows
    are still numbered by many tasks.
    """
    return slots(assign(docs, weights, more, key, text))


def write_shards(docs: DataFrame, folder: str, weights: dict[int, float], key: str = "doc_id", text: str = "text") -> None:
    """Write all columns of `docs` (as struct `row`) to Parquet folders `shard=n`, files and rows in the order of the slots.

    Range partitions follow the slot order and, for equal records, their places, so no record is bound to one task.
    """
    docs = stored(docs)
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    body = F.coalesce(t, F.lit("")).cast("binary")
    file, row = place(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k.alias("key"), F.crc32(body).alias("crc"),
                       F.octet_length(body).alias("size"), best(key_text(k), weights)["shard"].alias("shard"),
                       F.xxhash64(file, row).alias("at"))
    bucket, *order = slot_order(F.col("key"), F.col("crc"), F.col("size"))
    by = [F.col("shard"), bucket, *order, F.col("at")]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("row", "shard").write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the written rows, and `shard` and place behind them under names that the rows may not have."""
    rows = spark.read.parquet(folder)
    hidden = rows.metadataColumn("_metadata")
    return rows.select("row", "shard", hidden.getField("file_name").alias("file"), hidden.getField("row_index").alias("at"))
