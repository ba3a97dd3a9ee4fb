"""Query of the exact deduplication operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import streamdedup
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op5_stream_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""")
def op5_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.exact_duplicates(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256")
