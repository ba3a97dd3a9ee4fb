"""Query of the quotation linking operator: conversations as mail-like messages with nested quotes, and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from veridoc.llm import quotes
from veridoc.llm.common import table
from veridoc.llm.registry import query


def _quoted(text: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn quotes the turn before it, and that one's quote of the turn before, in several styles."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("own"))
    order = W.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("one", F.lag("own", 1).over(order)).withColumn("two", F.lag("own", 2).over(order))
    loose = F.regexp_replace(F.translate("one", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ", "  ")
    inner = F.when(F.col("two").isNotNull(), F.concat(_quoted(F.col("two"), "> > "), F.lit("\n"))).otherwise(F.lit(""))
    quote = F.concat(F.lit("On that day somebody wrote:\n"), inner,
                     F.when(F.col("turn") % 5 == 3, _quoted(loose, ">")).otherwise(_quoted(F.col("one"), "> ")))
    body = (F.when(F.col("one").isNull(), F.col("own"))
            .when(F.col("turn") % 2 == 0, F.concat("own", F.lit("\n\n"), quote))
            .otherwise(F.concat(quote, F.lit("\n\n"), F.col("own"))))
    return turns.select("conv_id", "turn", body.alias("text"))


@query("op1_quote_links", r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(text, '') AS own, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS t,
         row_number() OVER w AS k
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (
  SELECT m.conv_id, m.turn, m.own, m.k, a.t AS t1, b.t AS t2
  FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.k = m.k - 1 LEFT JOIN m b ON b.conv_id = m.conv_id AND b.k = m.k - 2),
f AS (SELECT conv_id, t, min(turn) AS turn FROM m WHERE t <> '' GROUP BY conv_id, t),
l AS (
  SELECT q.conv_id, q.turn, q.own, coalesce(f1.turn, f2.turn) AS parent_turn,
         ((coalesce(t1, '') <> '')::BIGINT + (coalesce(t2, '') <> '')::BIGINT) AS n_quotes,
         ((f1.turn IS NOT NULL)::BIGINT + (f2.turn IS NOT NULL)::BIGINT) AS n_linked
  FROM q LEFT JOIN f f1 ON f1.conv_id = q.conv_id AND f1.t = q.t1 LEFT JOIN f f2 ON f2.conv_id = q.conv_id AND f2.t = q.t2),
d AS (
  SELECT conv_id, turn, turn AS thread_turn, 0::BIGINT AS depth FROM l WHERE parent_turn IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, d.thread_turn, d.depth + 1 FROM d JOIN l ON l.conv_id = d.conv_id AND l.parent_turn = d.turn)
SELECT l.conv_id, l.turn, trim(l.own, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS own_text, n_quotes, n_linked, CASE WHEN parent_turn IS NOT NULL THEN l.conv_id END AS parent_conv,
       parent_turn, l.conv_id AS thread_conv, thread_turn, depth,
       row_number() OVER (PARTITION BY l.conv_id, thread_turn ORDER BY depth, l.turn) AS place
FROM l JOIN d ON d.conv_id = l.conv_id AND d.turn = l.turn
""")
def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(messages(spark, sf_dir), ["conv_id", "turn"], scope="conv_id").selectExpr(
        "conv_id", "turn", "own_text", "n_quotes", "n_linked", "parent.conv_id AS parent_conv", "parent.turn AS parent_turn",
        "thread.conv_id AS thread_conv", "thread.turn AS thread_turn", "depth", "place")
