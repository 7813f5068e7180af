"""op3: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table
from storelens.llm.html_content import extract_pages
from storelens.llm.registry import query


@query("op3_html_content")
def op3_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
