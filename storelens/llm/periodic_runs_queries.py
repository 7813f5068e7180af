"""op12: periodic runs of words, with runs planted into one document in ten."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import over_batches, table, work_folder
from storelens.llm.periodic_runs import find_runs, words_of
from storelens.llm.registry import query


def planted(key: int | None, text: bytes) -> list[bytes]:
    """The words of a text; where the crc32 of the key is divisible by ten, those from a place on repeat with a period. Both follow from the key."""
    words = words_of(key, text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, the digest of all runs, collapsed_sha256."""
    slim = found.select("doc_id", "collapsed_sha256", "runs")
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in names) + ", runs_sha256 string, collapsed_sha256 string"

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in (*names, "runs_sha256")}
            for runs in batch.column(2).to_pylist():
                best = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                values = [best[k] for k in names[1:4]] + [1000 * best["length"] // best["period"]] if best else [None] * 4
                for k, v in zip(names, [len(runs), *values]):
                    out[k].append(v)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            return out | {"doc_id": batch.column(0), "collapsed_sha256": batch.column(1)}

        return step

    return over_batches(slim, make, schema)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_runs(docs, work_folder(spark), words=planted))
