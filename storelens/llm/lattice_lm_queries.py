"""op2: language model score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import held_out, table, work_folder
from storelens.llm.lattice_lm import score
from storelens.llm.registry import query


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_lattice_lm")
def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "text")
    return score(docs, vocabulary(), work_folder(spark))
