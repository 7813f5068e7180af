"""op9: fingerprint and near-duplicate group of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import simhash as S
from storelens.llm.common import saved, table, work_folder
from storelens.llm.registry import query


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    marked = saved(S.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), folder, "fingerprints")
    return S.groups(marked, folder).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
