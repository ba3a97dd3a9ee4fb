"""Query of the HTML extraction operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm import htmltext
from veridoc.llm.common import table
from veridoc.llm.registry import query


@query("op7_html_regions")
def op7_html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
