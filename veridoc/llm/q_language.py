"""Query of the language identification operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import language as L
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = L.fit(docs.filter(L.in_training_part()))
    return L.predict(docs.select("doc_id", L.held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
