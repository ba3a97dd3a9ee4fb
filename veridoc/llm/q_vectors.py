"""Query of the near-duplicate vector operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import vectors
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op8_vector_codes")
def op8_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))
