"""Merkle fixity audit of archived records: hash trees over ordered offset ranges, compared from the roots down.

A leaf is the digest of one record. A range of `RANGE_BYTES` offsets is a node over its leaves in order of offset, and every
`FANOUT` neighbouring ranges are a node above, up to one root per archive. Replicas are compared by roots; only children of
nodes that differ are read further, down to the records. No node has more children than fit its range, so no group grows
with an archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veridoc.llm.common import small, store

RANGE_BYTES = 1 << 16
FANOUT = 16


def record(url: Column, identifier: Column, body: Column) -> Column:
    """A response record as text: head lines, an empty line, the body and two line ends; null parts count as empty."""
    content = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(identifier.cast("string"), F.lit("")),
                    F.lit(">\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(replica, archive, offset, state, high, node): one row per place; rows that repeat a place are one leaf.

    `state` names the whole bag of contents at the place: their number, least and largest digest, and sums over four parts of all
    digests, so that any change of any copy changes the leaf, while a place with very many rows needs partial sums only. `high`
    is the largest digest. A null content counts as lost. Rows with a null replica, archive or offset have no place.
    """
    placed = records.filter("replica is not null and archive is not null and offset is not null and content is not null")
    hashed = placed.select("replica", "archive", F.col("offset").cast("long").alias("offset"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    # 60 bits each; 38 digits hold the sum of any number of rows.
    parts = [F.sum(F.conv(F.substring("digest", k, 15), 16, 10).cast("decimal(28,0)")).cast("string") for k in (1, 16, 31, 46)]
    bag = hashed.groupBy("replica", "archive", "offset").agg(
        F.concat_ws(",", F.count("*").cast("string"), F.min("digest"), F.max("digest"), *parts).alias("state"), F.max("digest").alias("high"))
    return bag.withColumn("node", F.expr(f"offset div {range_bytes}"))


def _hash_of(parts: Column) -> Column:
    """Digest of sorted (place, content) children, each with its place."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", p["at"].cast("string"), p["h"])), "|").cast("binary"), 256)


def trees(placed: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the ranges to the roots: (replica, archive, node, hash); the last level has node 0 only."""
    leaf = F.struct(F.col("offset").alias("at"), F.col("state").alias("h"))
    levels = [store(placed.groupBy("replica", "archive", "node").agg(_hash_of(F.collect_list(leaf)).alias("hash")), "merkle")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        child = F.struct(F.col("node").alias("at"), F.col("hash").alias("h"))
        levels.append(store(levels[-1].groupBy("replica", "archive", F.expr(f"node div {fanout}").alias("above")).agg(
            _hash_of(F.collect_list(child)).alias("hash")).withColumnRenamed("above", "node"), "merkle"))
        top //= fanout
    return levels


def _differing(level: DataFrame, replicas: int) -> DataFrame:
    """(archive, node) that some replica has not, or has with another hash."""
    return level.groupBy("archive", "node").agg(F.count("*").alias("n"), F.min("hash").alias("a"), F.max("hash").alias("b")).filter(
        (F.col("n") < replicas) | (F.col("a") != F.col("b"))).select("archive", "node")


def audit(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(replica, archive, offset, status, found_sha256, expected_sha256) of each record that fails the audit.

    records: (replica, archive, offset, content); replicas are few. What more than half of the replicas hold at a place is
    expected there: another content is `altered`, a missing one `lost`, one where most have none `extra`. Without such a
    majority every replica's content is `disputed`, and the expected digest is null. Rows without a place are not audited;
    equal replicas and an empty table give no row. Where a place holds several
    contents, all of them count and the digests shown are the largest ones. Other columns are not read.
    """
    placed = store(leaves(records, range_bytes), "leaves")
    names = placed.select("replica").distinct()
    replicas = names.count()
    levels = trees(placed, fanout)
    wrong = store(_differing(levels[-1], replicas), "roots")
    for level in reversed(levels[:-1]):
        above = small(wrong.withColumnRenamed("node", "above"))
        children = level.withColumn("above", F.expr(f"node div {fanout}")).join(above, ["archive", "above"], "left_semi")
        wrong = store(_differing(children, replicas), "branches")
    suspects = placed.join(small(wrong), ["archive", "node"], "left_semi")
    held = suspects.select("archive", "offset", "replica", "state", F.col("high").alias("digest"))
    # At most one row per replica at a place.
    voted = held.groupBy("archive", "offset", "state").agg(F.count("*").alias("votes"), F.max("digest").alias("digest"))
    present = held.groupBy("archive", "offset").agg(F.count("*").alias("n"), F.count_distinct("state").alias("states"))
    most = voted.filter(F.col("votes") * 2 > replicas).select("archive", "offset", F.col("state").alias("right"), F.col("digest").alias("expected"))
    places = present.filter((F.col("states") > 1) | (F.col("n") < replicas)).join(most, ["archive", "offset"], "left")
    absent = (F.lit(replicas) - F.col("n")) * 2 > F.lit(replicas)
    everyone = store(places.withColumn("absent", absent), "places").crossJoin(F.broadcast(names)) if replicas else \
        places.withColumn("absent", absent).withColumn("replica", F.lit(None).cast(placed.schema["replica"].dataType))
    rows = everyone.join(held, ["archive", "offset", "replica"], "left")
    status = (F.when(F.col("right").isNull() & F.col("absent"), F.when(F.col("state").isNotNull(), "extra"))
              .when(F.col("right").isNull(), "disputed")
              .when(F.col("state").isNull(), "lost")
              .when(F.col("state") != F.col("right"), "altered"))
    return rows.withColumn("status", status).filter("status is not null").select(
        "replica", "archive", "offset", "status", F.col("digest").alias("found_sha256"), F.col("expected").alias("expected_sha256"))
