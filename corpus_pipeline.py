"""From raw documents to token ids, in five stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontamination, simhash_dedup, suffix_dedup, toxicity
from storelens.llm.bpe import encode_documents
from storelens.llm.bpe_queries import vocabulary
from storelens.llm.common import held_out, table, work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; learnt from the labels that may be learnt."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return simhash_dedup.keep_one(docs, work_folder(spark))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 100-byte strings of earlier places; characters cut in two go, ``n_chars`` follows.

    Documents of which nothing is left go too; those that had no text before stay as they are.
    """
    cut = suffix_dedup.deduplicate(docs.withColumn("_null", F.col("text").isNull()), work_folder(spark), keep_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    text = F.when(~F.col("_null"), F.col("kept"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), work_folder(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, with ids and their digests."""
    return encode_documents(docs, vocabulary(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, with each stage's rows written to the shared folder."""
    folder, docs = work_folder(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
