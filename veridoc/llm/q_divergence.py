"""Query of the divergence audit and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import divergence
from veridoc.llm.common import table
from veridoc.llm.registry import query

SQL_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM found GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found GROUP BY ALL),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN (SELECT c.* FROM counts c JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS p,
         1 + 1000000000::HUGEINT * (all_n + 1) // (lang_total + v) AS q
  FROM (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, t.total, k.total AS all_n, l.v, l.lang_total
        FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
        LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term)
    ON x.lang = a.lang AND x.source = a.source AND y.source = b.source
  GROUP BY ALL),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranks WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", SQL_DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
