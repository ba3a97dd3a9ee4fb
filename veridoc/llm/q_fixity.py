"""Query of the fixity audit: three replicas of the pages as archived records, two of them with damage, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from veridoc.llm import fixity
from veridoc.llm.common import table
from veridoc.llm.registry import query

#: Pages per archive.
ARCHIVE_PAGES = 256


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica 0 is whole; 1 has a changed letter in some records; 2 misses some and repeats the start of others."""
    pages = table(spark, sf_dir, "pages")
    rec = fixity.record(F.col("url"), F.col("page_id"), F.col("html"))
    records = pages.select("page_id", F.expr(f"page_id div {ARCHIVE_PAGES}").alias("archive"), rec.alias("r"))
    before = F.sum(F.octet_length("r")).over(W.partitionBy("archive").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1))
    placed = records.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    middle = (F.char_length("r") / 2).cast("int")
    changed = F.concat(F.substring(F.col("r"), F.lit(1), middle), F.lit("#"), F.substring(F.col("r"), middle + 2, F.char_length("r")))
    one = F.when(F.col("page_id") % 97 == 13, changed).otherwise(F.col("r"))
    two = F.when(F.col("page_id") % 89 == 7, F.lit(None)).when(F.col("page_id") % 83 == 5, F.concat(F.substring("r", 1, 40), F.col("r"))).otherwise(F.col("r"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("replica"), c.alias("content")) for i, c in enumerate((F.col("r"), one, two)))))
    return placed.select("archive", "offset", each.alias("x")).select("x.replica", "archive", "offset", "x.content")


@query("op4_merkle_audit", r"""
WITH r AS (
  SELECT page_id, page_id // 256 AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
         'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) ||
         chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
p AS (
  SELECT page_id, archive, r, length(r) // 2 AS middle,
         coalesce(sum(strlen(r)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r),
c AS (
  SELECT archive, "offset", sha256(r) AS h0,
         sha256(CASE WHEN page_id % 97 = 13 THEN substr(r, 1, middle) || '#' || substr(r, middle + 2) ELSE r END) AS h1,
         CASE WHEN page_id % 89 = 7 THEN NULL WHEN page_id % 83 = 5 THEN sha256(substr(r, 1, 40) || r) ELSE sha256(r) END AS h2
  FROM p),
s AS (
  SELECT *, CASE WHEN h0 = h1 OR h0 = h2 THEN h0 WHEN h1 = h2 THEN h1 END AS expected_sha256 FROM c
  WHERE h0 <> h1 OR h2 IS NULL OR h2 <> h0),
each AS (
  SELECT unnest([0, 1, 2]) AS replica, unnest([h0, h1, h2]) AS found_sha256, archive, "offset", expected_sha256 FROM s)
SELECT replica, archive, "offset", found_sha256, expected_sha256,
       CASE WHEN expected_sha256 IS NULL THEN 'disputed' WHEN found_sha256 IS NULL THEN 'lost' ELSE 'altered' END AS status
FROM each WHERE expected_sha256 IS NULL OR found_sha256 IS DISTINCT FROM expected_sha256
""")
def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(replicas(spark, sf_dir))
