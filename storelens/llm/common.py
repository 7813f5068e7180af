"""What the operators of this subpackage share: tables, folds, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def held_out(key: str, n: int, rest: int) -> Column:
    """True where the key's remainder is ``rest``; a row without a key is never held out."""
    return F.coalesce(remainder(key, n) == rest, F.lit(False))


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written as Parquet to ``folder`` and read again: lineage ends here, and every later read sees the same rows."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a work folder through Hadoop's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` holding about ``limit`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now ends an Arrow batch at ``BATCH_BYTES`` as well as at its number of rows: both sides of the pipe hold one in whole."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str) -> DataFrame:
    """``make()`` runs once per task and returns the function that maps rows in Arrow columns to columns of ``schema``.

    A batch is handed on in parts of about ``BATCH_BYTES``, so that what the function makes of it is bounded by bytes, not rows.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
            for at in range(0, batch.num_rows, rows):
                got = step(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in kinds], schema=kinds)

    return bounded_batches(df).mapInArrow(run, schema)
