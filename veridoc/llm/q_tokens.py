"""Queries of the token record and packing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veridoc.llm import packing, records
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op9_token_records")
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), end_id=2).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
