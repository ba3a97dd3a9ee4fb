"""Query of the resampling operator; its checksums have no SQL, tests hold it against a plain computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import resampling
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.selectExpr("key AS doc_id", "n_features", "weight", "score", "rank")
