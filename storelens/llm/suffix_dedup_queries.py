"""op7: bytes of every document that repeat 100-byte strings of earlier places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table, work_folder
from storelens.llm.registry import query
from storelens.llm.suffix_dedup import deduplicate


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), work_folder(spark))
