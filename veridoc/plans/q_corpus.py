"""Scan-level queries over the two derived sides."""

from pyspark.sql import functions as F

from veridoc.plans.oracle import with_
from veridoc.plans.registry import query
from veridoc.sources import corpus


@query("a1_scan_files", with_("SELECT side, doc_id, product, channel, path FROM docs", "docs"))
def scan_files(spark, sf_dir):
    both = corpus.files(spark, sf_dir, "S").unionByName(corpus.files(spark, sf_dir, "T"))
    return both.select("side", "doc_id", "product", "channel", "path")


@query("a2_scan_words", with_("""SELECT side, doc_id, page, count(*) AS n_words, min(x0) AS min_x, max(x1) AS max_x,
  min(y0) AS min_y, max(y1) AS max_y, max(md5(text || pos)) AS digest FROM words GROUP BY ALL""", "words"))
def scan_words(spark, sf_dir):
    return corpus.both_words(spark, sf_dir).groupBy("side", "doc_id", "page").agg(
        F.count("*").alias("n_words"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"),
        F.min("y0").alias("min_y"), F.max("y1").alias("max_y"),
        F.max(F.md5(F.concat("text", F.col("pos").cast("string")))).alias("digest"))
