"""The two document sides (expected = S, obtained = T) derived from the given tables.

Every derivation is one row-local expression over `documents`, so it grows with the data and needs no
shuffle of words: texts are hashed by document while they are still one row each, then expanded.
`veridoc/plans/oracle.py` states the same rules in plain SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from veridoc.session import configure, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, side: str, with_text: bool = True, paired: bool = False) -> DataFrame:
    """Files of one side.

    Documents labelled toxic are missing on the obtained side; documents labelled good quality are
    the ones whose content changes. File names on the obtained side depend on the language: the same
    name, a date suffix, another prefix with the same number, or an unrelated name. `paired` leaves out
    expected documents that are missing on the other side.
    """
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = docs.join(marks, "doc_id", "left")
    channel = F.when(F.substring("source", 4, 9).cast("int") < 7, "Broker").otherwise("Bank")
    number = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    if side == "T" or paired:
        docs = docs.where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    if side == "S":
        folder, name = F.lit("Source"), F.concat(F.lit("DOC_"), number)
    else:
        folder = F.lit("2026_R11/Target")
        name = (F.when(F.col("lang") == "fr", F.concat(F.lit("DOC_"), number, F.lit("_cible-2026-11-10")))
                .when(F.col("lang") == "de", F.concat(F.lit("ANNEX_"), number))
                .when(F.col("lang") == "es", F.concat(F.lit("Hoja "), F.translate(number, "0123456789", "abcdefghij")))
                .otherwise(F.concat(F.lit("DOC_"), number)))
    out = docs.select(
        F.lit(side).alias("side"), "doc_id", "lang", F.col("source").alias("product"), channel.alias("channel"),
        (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("edited"),
        F.concat(F.lit("/data/"), channel, F.lit("/"), F.col("source"), F.lit("/"), folder, F.lit("/"), name,
                 F.lit(".pdf")).alias("path"),
        *(["text"] if with_text else []))
    return out


def files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return documents(spark, sf_dir, side, with_text=False)


# Raw position p decides the inserted dates, amounts and the content edits of the obtained side.
_TOKENS = "filter(split(text, '\\\\s+'), x -> x <> '')"
_SOURCE_EDIT = """CASE WHEN i % 80 = 20 THEN '13/11/2026'
  WHEN i % 50 = 10 THEN concat(cast(100 + doc_id % 900 as string), ',00') ELSE x END"""
_TARGET_EDIT = """CASE WHEN i % 80 = 20 THEN '14/11/2026'
  WHEN i % 50 = 10 THEN concat(cast(100 + doc_id % 900 + CASE WHEN edited THEN doc_id % 5 ELSE 0 END as string), ',00')
  WHEN edited AND (doc_id + i) % 211 = 7 THEN concat('x', x)
  WHEN edited AND (doc_id + i) % 223 = 11 THEN '' ELSE x END"""


def tokens(docs: DataFrame) -> DataFrame:
    """Documents with `toks`, the edited token array of their side."""
    edit = f"CASE WHEN side = 'S' THEN {_SOURCE_EDIT} ELSE {_TARGET_EDIT} END"
    return docs.withColumn("toks", F.expr(f"filter(transform({_TOKENS}, (x, i) -> {edit}), x -> x <> '')")).drop("text")


def place(docs: DataFrame) -> DataFrame:
    """Expand token arrays into positioned words (12 a line, 13 where the obtained side reflows)."""
    per_line = F.when((F.col("side") == "T") & (F.col("lang") == "de"), 13).otherwise(12)
    # The outer form, as `posexplode` would have the optimiser ask for non-empty arrays below the shuffle of the texts and cut every
    # text there three more times, in the few tasks that read the files.
    words = docs.select("*", F.posexplode_outer("toks").alias("pos", "text")).where("pos is not null").drop("toks")
    words = words.withColumn("_line", F.expr("pos div CASE WHEN side = 'T' AND lang = 'de' THEN 13 ELSE 12 END").cast("int"))
    col = F.col("pos") % per_line
    return words.select(
        *[c for c in words.columns if c not in ("_line", "text", "pos", "edited")],
        F.col("pos").cast("long").alias("pos"), "text",
        (F.expr("_line div 50") + 1).cast("int").alias("page"),
        (F.col("_line") % 50).cast("int").alias("line_on_page"),
        (40.0 + 42.0 * col).alias("x0"),
        (800.0 - 15.0 * (F.col("_line") % 50)).alias("y0"),
        (40.0 + 42.0 * col + 5.0 * F.least(F.length("text"), F.lit(7))).alias("x1"),
        (810.0 - 15.0 * (F.col("_line") % 50)).alias("y1"),
        F.lit(10.0).alias("font_size"))


def words(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Positioned words of one side, hashed by document."""
    return place(tokens(spread(documents(spark, sf_dir, side), "doc_id")))


def pair_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of both sides of every pair, hashed by `pair_id` (the document number)."""
    both = documents(spark, sf_dir, "S", paired=True).unionByName(documents(spark, sf_dir, "T"))
    return place(tokens(spread(both.withColumnRenamed("doc_id", "pair_id"), "pair_id").withColumn("doc_id", F.col("pair_id")))).drop("doc_id")


def both_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir, "S").unionByName(words(spark, sf_dir, "T"))


def raw_words(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Words as a scanner would deliver them, before any filter.

    Long words arrive in two touching fragments, capitalised words are printed twice, and some tokens
    are micro print, white, rotated in the margin, off page, large print, anchors, stamps or copy mentions.
    """
    w = words(spark, sf_dir, side)
    text = (F.when(F.col("pos") % 149 == 8, F.lit("#SIGN_1#"))
            .when(F.col("pos") % 151 == 9, F.lit("SPECIMEN"))
            .when(F.col("pos") % 157 == 12, F.concat(F.lit("D000 "), F.col("text")))
            .when((F.col("pos") % 131 == 7) & (F.col("line_on_page") >= 44), "Exemplaire").otherwise(F.col("text")))
    w = w.withColumn("text", text)
    w = w.withColumn("font_size", F.when(F.col("pos") % 97 == 5, 50.0).when(F.col("pos") % 101 == 3, 1.2)
                     .when(F.col("pos") % 107 == 6, 20.0).otherwise(10.0))
    w = w.withColumn("grey", F.when(F.col("pos") % 103 == 4, 0.97).otherwise(0.0))
    w = w.withColumn("horizontal", F.col("pos") % 109 != 2)
    w = w.withColumn("x0", F.when(F.col("pos") % 109 == 2, 10.0).otherwise(F.col("x0")))
    w = w.withColumn("x1", F.when(F.col("pos") % 109 == 2, 20.0).otherwise(F.col("x1")))
    w = w.withColumn("y0", F.when(F.col("pos") % 113 == 1, -40.0).otherwise(F.col("y0")))
    w = w.withColumn("y1", F.when(F.col("pos") % 113 == 1, -30.0).otherwise(F.col("y1")))
    long_word = (F.length("text") >= 9) & ~F.col("text").contains(" ")
    twice = F.col("text").rlike("^[A-Z][a-z]+$") & (F.length("text") < 9)
    cut_at = F.col("x0") + 17.0
    part = lambda sub, txt, x0, x1: F.struct(F.lit(sub).alias("sub"), txt.alias("text"), x0.alias("x0"), x1.alias("x1"))
    parts = (F.when(long_word, F.array(part(0, F.substring("text", 1, 4), F.col("x0"), cut_at),
                                       part(1, F.expr("substring(text, 5)"), cut_at + 0.5, F.col("x1"))))
             .when(twice, F.array(part(0, F.col("text"), F.col("x0"), F.col("x1")),
                                  part(1, F.col("text"), F.col("x0") + 0.5, F.col("x1") + 0.5)))
             .otherwise(F.array(part(0, F.col("text"), F.col("x0"), F.col("x1")))))
    w = w.withColumn("part", F.explode(parts))
    keep = [c for c in w.columns if c not in ("text", "x0", "x1", "part")]
    return w.select(*keep, "part.sub", "part.text", "part.x0", "part.x1",
                    F.lit(1).alias("n_letters"), F.lit(5.0).alias("glyph_span"),
                    F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"))
