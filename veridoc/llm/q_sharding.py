"""Query of the sharding operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import sharding
from veridoc.llm.common import table
from veridoc.llm.registry import query

SHARDS = 40

#: CRC-32 is computed byte by byte from the hexadecimal digits of a text, with one table row for each byte value.
SQL_SHARDS = r"""
WITH RECURSIVE bits(b, r, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(r ORDER BY b) AS step FROM bits WHERE k = 8),
records AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size, coalesce(doc_id::VARCHAR, '') AS name,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
             lambda x: ('0x' || x)::BIGINT)),
             lambda crc, x: xor(steps.step[xor(crc & 255, x) + 1], crc >> 8)), 4294967295)::BIGINT AS text_crc32
  FROM documents, steps),
drawn AS (
  SELECT DISTINCT name, s, ln((('0x' || substr(md5(s::VARCHAR || ':' || name), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS draw
  FROM records, range(41) t(s)),
best AS (
  SELECT name, arg_max(s, (draw, -s)) FILTER (WHERE s < 40) AS shard, arg_max(s, (draw, -s)) AS grown_shard FROM drawn GROUP BY name)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(name), 1, 2))::INTEGER * 16 + (text_crc32 >> 28), md5(name),
                          text_crc32, size, doc_id NULLS FIRST) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM records JOIN best USING (name)
"""


@query("op12_rendezvous_shards", SQL_SHARDS)
def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), {s: 1.0 for s in range(SHARDS)}, {SHARDS: 1.0})
    return rows.selectExpr("key AS doc_id", "size", "text_crc32", "'key' AS law", "shard", "slot", "grown_shard")
