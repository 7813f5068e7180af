"""Arrow batches of long texts are bounded by bytes where they are made, not only where they are read."""

from pyspark.sql import functions as F

from storelens.llm import common


def test_batches_are_bounded_before_they_are_sent(spark):
    docs = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 5000).alias("text"))

    def make():
        return lambda batch: {"held": [batch.column(0).get_total_buffer_size()] * batch.num_rows}

    got = [r["held"] for r in common.over_batches(docs, make, "held long").collect()]
    assert len(got) == 4000 and max(got) < 2 * common.BATCH_BYTES


def test_a_batch_of_token_ids_takes_few_bytes_a_token(spark, monkeypatch):
    """They were lists of Python numbers, 36 bytes a token."""
    import tracemalloc

    import pyarrow as pa

    from storelens.llm import bpe
    from storelens.llm.bpe_queries import vocabulary

    made = []
    monkeypatch.setattr(bpe, "over_batches", lambda df, make, schema: made.append(make()))
    bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), vocabulary(), keep_ids=True)
    text = " ".join(f"{a}{b}{c}" for a in "qxzkwv" for b in "jzqxy" for c in ("tion", "ment", "ough", "87"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text * 20, "", None]})
    made[0](batch)  # fills the caches
    tracemalloc.start()
    got = made[0](batch)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert got["n_tokens"] == [len(x) for x in got["ids"]] and got["n_tokens"][1:] == [0, 0] and got["n_tokens"][0] > 4000
    assert held < 10 * got["n_tokens"][0]
    lists = pa.array(got["ids"], type=pa.list_(pa.int32())).to_pylist()
    assert lists == [bpe.WordBpe(vocabulary()).encode(text * 20), [], []]
