"""Python over Arrow batches in parts bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

# Texts handed to Python functions at a time; what is made of them is held many times over.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch cut by the bytes of its rows: a part goes beyond ``limit`` only as a single row."""
    limit, size = limit or PART_BYTES, [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size = [n + (k or 0) for n, k in zip(size, pa.compute.binary_length(column).to_pylist())]
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (held + n > limit or i - start >= 1000):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_parts(df: DataFrame, fn: Callable[..., list[dict]], schema: str) -> DataFrame:
    """``fn`` gets the columns of a part as lists and returns rows of ``schema`` as dictionaries; a part's rows are sent before the next is read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                rows = fn(*[x.to_pylist() for x in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)
