"""Toxicity by compression distance.

Two zstandard dictionaries share a base that the library's trainer makes from ordinary windows.
The toxic one ends in segments trained on toxic text: character n-grams that recur in toxic
documents and hardly in ordinary ones. The ordinary one ends in as many bytes that no text
holds, so that lengths under the two differ by the toxic segments alone. Every window of a
document is compressed with both; the bytes saved, as a rate and against the square root of the
number of windows, go through a logistic curve calibrated on labelled rows kept out of the
dictionaries.

The dictionaries and the curve are fitted on at most ``sample`` labelled rows per class
(a documented bound); scoring covers every window of every text, and needs no shuffle.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import over_batches

SAMPLE = 2000
THRESHOLD = 0.7
LEVEL, MIN_MATCH = 15, 3
BASE_BYTES, TAIL_BYTES = 16384, 600
WINDOW = re.compile(rb"(?s)\S.{56,76}?(?=\s)|\S.{0,76}")
WORD = re.compile(rb"[^\x00-\x20.,;:!?|\"()']+")
GRAMS = (4, 5, 6, 7, 8, 10, 12)
FALSE_COST = 8.0

Model = tuple[bytes, bytes, np.ndarray]


def windows(text: str) -> list[bytes]:
    """Whole words up to about 64 bytes, in lower case, with a space on both sides; together they cover the text."""
    return [b" " + w + b" " for w in WINDOW.findall(text.lower().encode("utf-8", "replace"))]


def _distinct(texts: list[str]) -> list[set[bytes]]:
    """Word sets of the texts, without near copies of earlier ones, which would make their rare words look frequent."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        words = set(WORD.findall(t.lower().encode("utf-8", "replace")))
        rare = {w for w in words if len(w) >= 8}
        if words and not (len(rare) > 5 and len(rare & seen) > 0.6 * len(rare)):
            out.append(words)
            seen |= words
    return out


def _grams(docs: list[set[bytes]]) -> Counter:
    count: Counter = Counter()
    for words in docs:
        found = set()
        for w in words:
            x = b" " + w[:24] + b" "
            for n in GRAMS:
                found.update(x[i : i + n] for i in range(len(x) - n + 1))
        count.update(found)
    return count


def segments(toxic: list[str], ordinary: list[str], size: int = TAIL_BYTES) -> bytes:
    """N-grams of toxic documents that ordinary ones hardly hold, the most useful last, where matching them is cheapest."""
    a, b = _distinct(toxic), _distinct(ordinary)
    here, there = _grams(a), _grams(b)
    least = max(2, 0.006 * len(a))
    found = sorted(((k * (len(g) - 3), g) for g, k in here.items() if k >= least and k / len(a) > 20 * (there.get(g, 0) + 0.3) / max(len(b), 1)), key=lambda x: (-x[0], x[1]))
    out: list[bytes] = []
    room = size
    for _, g in found:
        if room < len(g):
            break
        if not any(o in g or g in o for o in out):
            out.append(g)
            room -= len(g)
    return b"".join(reversed(out))


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    r = random.Random(5)
    pool = [w for t in ordinary for w in windows(t)]
    r.shuffle(pool)
    pool = pool[:40_000]
    pool += [b" %d " % i * 4 for i in range(max(0, 400 - len(pool)))]  # the trainer needs a minimum of samples
    base = zs.train_dictionary(min(BASE_BYTES, sum(map(len, pool)) // 8 + 1024), pool, k=32, d=6).as_bytes()
    tail = segments(toxic, ordinary)
    return base + tail, base + bytes(r.choice(b"\x01\x02\x03\x04\x05\x06\x0e\x0f\x10\x11\x12\x13") for _ in tail)


def _compressor(dictionary: bytes):
    d = zs.ZstdCompressionDict(dictionary)
    p = zs.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), source_size=64, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p).compress


def measure(texts: list[str], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Per text: bytes saved per window, bytes saved over the root of the number of windows, share of windows that save two bytes or more."""
    a, b = _compressor(toxic), _compressor(ordinary)
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        ws = windows(t)
        if ws:
            saved = np.array([len(b(w)) - len(a(w)) for w in ws])
            total, n = np.maximum(saved, 0).sum(), len(ws)
            out[i] = total / n, total / n**0.5, (saved >= 2).sum() / n
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method, both classes weighing the same."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Dictionaries and curve from at most ``sample`` rows of each class, chosen by a hash of doc_id; None without rows of both classes.

    Two rows in three train the dictionaries, the rest the curve. The curve is moved so that
    ``THRESHOLD`` lies where the share of toxic calibration rows above it, less ``FALSE_COST``
    times that of ordinary ones, is largest.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # two samples at most
    rows = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * sample).collect()
    texts = {k: [r["text"] for r in rows if r["toxic"] == k] for k in (0, 1)}
    if len(texts[0]) < 2 or len(texts[1]) < 2:
        return None
    first = {k: [t for i, t in enumerate(texts[k]) if i % 3 != 1] for k in (0, 1)}
    toxic, ordinary = _dictionaries(first[1], first[0])
    x = np.vstack([measure(texts[k][1::3], toxic, ordinary) for k in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(texts[0][1::3]), len(texts[1][1::3])])
    w = _logistic(x, y)
    raw = x @ w[:-1]
    steps = np.unique(raw)
    gain = [(raw[y == 1] >= c).mean() - FALSE_COST * (raw[y == 0] >= c).mean() for c in steps]
    best = int(np.argmax(gain))
    cut = (steps[best] + steps[best - 1]) / 2 if best else steps[0]
    w[-1] = np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return toxic, ordinary, w


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD``) to all columns but keeps the rows as they are.

    Null and empty texts score like a text without toxic windows; without a model every score is 0.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    slim = docs.select(*kept) if text in kept else docs.select(*kept, text)
    at = slim.columns.index(text)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes) + ", score double, predicted int"

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if model is None:
                p = np.zeros(len(texts))
            else:
                p = 1 / (1 + np.exp(-np.clip(measure(texts, model[0], model[1]) @ model[2][:-1] + model[2][-1], -30, 30)))
            return {f: batch.column(i) for i, f in enumerate(kept)} | {"score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

        return step

    return over_batches(slim, make, schema)
