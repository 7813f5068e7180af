"""op6: ids and decoded text of every document, as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.bpe import encode_documents
from storelens.llm.common import table
from storelens.llm.registry import query


def vocabulary() -> str:
    """The vocabulary file of the box; every node has it in its own installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
