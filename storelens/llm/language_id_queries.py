"""op1: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import language_id as L
from storelens.llm.common import held_out, table
from storelens.llm.registry import query


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = L.fit(docs.where(~held_out("doc_id", 4, 2)))
    return L.predict(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), model)
