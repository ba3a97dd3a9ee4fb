"""Query of the mixing operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import mixing
from veridoc.llm.common import table
from veridoc.llm.registry import query

SQL_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 15) AS digits
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS stop,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER ahead, 0)) /
            (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) AS level
  FROM weighed
  WINDOW ahead AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (
  SELECT *, max(CASE WHEN level * w <= stop THEN stop / w END) OVER () IS NOT NULL AS any_open,
         min(CASE WHEN level * w <= stop THEN stop / w END) OVER () AS first_ratio,
         arg_min(level, (stop / w, source IS NULL, source)) FILTER (WHERE level * w <= stop) OVER () AS first_level
  FROM levels),
goals AS (
  SELECT source, source_size, CASE WHEN any_open AND (first_level * w <= stop) THEN first_level * w ELSE stop END AS target
  FROM held),
timed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM goals),
hashes AS (SELECT source, digits, sum(size)::BIGINT AS n FROM sized GROUP BY source, digits),
running AS (
  SELECT h.source, h.digits, h.n, t.target - t.times * t.source_size AS rest,
         coalesce(sum(h.n) OVER (PARTITION BY h.source ORDER BY h.digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM hashes h JOIN timed t ON h.source IS NOT DISTINCT FROM t.source),
below AS (
  SELECT source, CASE WHEN before + n - rest <= rest - before THEN digits || 'g' ELSE digits END AS below
  FROM running WHERE before <= rest AND before + n > rest)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (t.times + CASE WHEN s.digits < coalesce(b.below, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN timed t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN below b ON s.source IS NOT DISTINCT FROM b.source
"""


@query("op6_mix_sources", SQL_MIX)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).selectExpr("key AS doc_id", "size", "source_size", "target", "taken")
