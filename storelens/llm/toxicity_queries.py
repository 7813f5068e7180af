"""op8: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import toxicity as T
from storelens.llm.common import held_out, table
from storelens.llm.registry import query


def fitted(spark: SparkSession, sf_dir: str) -> T.Model | None:
    """The model of the rows whose labels may be learnt."""
    return T.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return T.score(docs, fitted(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
