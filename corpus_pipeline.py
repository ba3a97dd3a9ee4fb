"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing; each stage is written and read again.

Every stage takes the documents that its predecessor kept, as read from Parquet, and all but the last return their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veridoc.llm import language, mixing, packing, shingles, streamdedup
from veridoc.llm.common import store, table

#: A classifier and fingerprints have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; those without a letter go."""
    model = language.fit(docs.filter(language.in_training_part()))
    return language.identified(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return streamdedup.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by SimHash fingerprints that differ in at most 2 bits, as op3 links them, or by a five-word Jaccard similarity
    of 0.8 or more, the row with the smallest doc_id stays."""
    return shingles.without_near_copies(docs, bits=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, end_id=1).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
          ("mixing to target weights", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
