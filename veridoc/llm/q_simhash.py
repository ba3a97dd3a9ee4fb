"""Query of the SimHash operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veridoc.llm import simhash
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op3_simhash_anchors")
def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
