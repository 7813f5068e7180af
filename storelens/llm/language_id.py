"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the n-grams of all labelled texts are added up by Spark per (language, bucket);
the smoothed log-probability matrix (languages x buckets, a fixed width) is broadcast and
whole texts are scored in Arrow batches with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import over_batches, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
MAX_LANGUAGES = 256
SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and length of each text (with a space on both sides) and, per n-gram order, the bucket at every position.

    Positions whose n-gram would leave its text hold the bucket number ``BUCKETS``, which weighs nothing.
    """
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        following = np.zeros_like(points)
        following[: len(points) - n + 1] = points[n - 1 :]
        h = (h + following + np.uint64(n)) * _MIX
        h ^= h >> np.uint64(32)
        if n in ORDERS:
            b = ((h * _MIX) >> np.uint64(49)).astype(np.int64) % BUCKETS
            b[left < n] = BUCKETS
            out.append(b)
    return starts, sizes, out


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-gram counts of all rows with a language; bucket -1 counts the rows themselves. Null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(k, []).append(t or "")
            for k, texts in by.items():
                total = seen.setdefault(k, np.zeros(BUCKETS + 2, dtype=np.int64))
                total[BUCKETS + 1] += len(texts)
                for a, z in slices(texts, SLICE):
                    for b in gram_buckets(texts[a:z])[2]:
                        total[: BUCKETS + 1] += np.bincount(b, minlength=BUCKETS + 1)
        for k, total in seen.items():
            at = np.flatnonzero(total)
            at = at[at != BUCKETS]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(np.where(at > BUCKETS, -1, at), pa.int32()),
                                              pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the matrix (buckets + 1) x languages of log-probabilities, and the log-priors.

    At most ``MAX_LANGUAGES`` languages x ``BUCKETS`` counts reach the driver; without any labelled row the list is empty.
    """
    counts = gram_counts(docs, text, lang)
    names = sorted(r[0] for r in counts.where("bucket = -1").select("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = counts.toPandas()
    at = {k: i for i, k in enumerate(names)}
    full, rows = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    k = got["lang"].map(at).to_numpy(dtype=np.int64)
    b, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    gram = b >= 0
    full[b[gram], k[gram]] = n[gram]
    rows[k[~gram]] = n[~gram]
    logs = np.log(full + SMOOTHING) - np.log(full.sum(axis=0) + SMOOTHING * BUCKETS)
    return names, np.vstack([logs, np.zeros((1, len(names)))]).astype(np.float32), np.log(rows / max(rows.sum(), 1))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the posterior of the predicted language.

    Null texts and texts without a letter give ``und`` with score 0, as does a model without languages.
    Ties go to the language first in alphabetical order. Older columns of those names are replaced; the text goes.
    """
    names, weights, priors = model
    shared = docs.sparkSession.sparkContext.broadcast((names, weights, priors))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept, F.when(lettered, F.col(text)).alias("_text")) if text in kept else docs
    slim = rows.select(*[c for c in kept if c != text], "_text")
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes if n != "_text") + ", lang_pred string, score double"

    def make():
        names, weights, priors = shared.value

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            best, score = ["und"] * len(texts), [0.0] * len(texts)
            live = [i for i, t in enumerate(texts) if t is not None] if names else []
            some = [texts[i] for i in live]
            for a, z in slices(some, SLICE):
                starts, _, orders = gram_buckets(some[a:z])
                total = priors + sum(np.add.reduceat(weights[b], starts, axis=0).astype(np.float64) for b in orders)
                top = total.argmax(axis=1)
                p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, t, x in zip(live[a:z], top, p):
                    best[i], score[i] = names[t], float(x)
            return {f: batch.column(i) for i, f in enumerate(batch.schema.names[:-1])} | {"lang_pred": best, "score": score}

        return step

    return over_batches(slim, make, schema)
