"""Periodic runs of words, by tiles per octave of periods.

Octave S (a power of two) holds the periods S up to 2 S - 1. It has a boundary at every multiple of
S and one tile around each: from S words before it to 7 S words after it. A run whose length is at
least four periods holds, for its first boundary and the following ones, the three periods after
the boundary, and the tiles of these boundaries together cover the run (the first boundary lies less
than S behind its start, the last one less than 3 p + S before its end).

A document is exploded into the tiles whose boundary can hold a period of the octave: the word at
the boundary recurs at that distance and prefix hashes of the words agree over two periods; hashes
only ever let too much pass. Neighbouring tiles travel together. Tiles are dealt over all tasks
and solved independently: a Z-function forward from the boundary and one backward give, for all
periods at once, the longest stretch around the boundary in which words p apart are equal,
clipped to the tile. Periods of which a proper divisor is one too are left to that divisor.

A fragment (document, period, from, to) lists places i whose words i and i + p are equal. Fragments
are shuffled by document and period; touching ones are stitched into intervals, and an interval
of m places is a stretch of m + p words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import over_batches, saved, slices

LEAST, TIMES = 6, 4  # words, periods
BUNDLE = 8192  # words that neighbouring tiles of one row may add up to, beside their overlap
CHARACTERS = 1 << 20  # of texts that are looked at together

Words = Callable[[int | None, bytes], list[bytes]]


def words_of(key: int | None, text: bytes) -> list[bytes]:
    """The maximal stretches of bytes that are not white space of ASCII."""
    return text.split()


def z_function(s: list[int]) -> list[int]:
    """For every place of s, how many symbols from there on equal the symbols from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _primes(p: int) -> list[int]:
    """The distinct primes of p."""
    out, d = [], 2
    while d * d <= p:
        if p % d == 0:
            out.append(d)
            while p % d == 0:
                p //= d
        d += 1
    return out + [p] * (p > 1)


def solve_tile(before: list[int], after: list[int], octave: int) -> list[tuple[int, int, int]]:
    """(period, places before the boundary, places from it on) of every period of the octave that holds for three periods after the boundary.

    ``before`` and ``after`` are the tile's words on both sides of its boundary.
    """
    ahead = z_function(after)
    found = []
    for p in range(octave, min(2 * octave, len(after) // 3 + 1)):
        if ahead[p] >= 2 * p and not any(ahead[p // r] + p // r >= 3 * p for r in _primes(p)):
            found.append(p)
    if not found:
        return []
    back, ahead_of = before[::-1], after[: 2 * octave]
    behind = z_function(back + [-1] + (before + ahead_of)[::-1])
    end = len(back) + 1 + len(ahead_of)  # the word p places after the boundary, read backward, follows place end - p
    return [(p, behind[end - p], ahead[p]) for p in found]


def live_tiles(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries that can hold one of its periods) over the joined words of several documents.

    ``doc`` is the document of each word, ``ends`` the end of each document, ``longest`` the longest one's number of words.
    """
    n = len(ids)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:-1])])

        def equal(a: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Whether ``size`` words from ``a`` and from ``a + shift`` have one hash."""
            return (total[a + size] - total[a]) * power[shift] == total[a + shift + size] - total[a + shift]

        octave = 1
        while TIMES * octave <= longest:
            rows = n // octave - 1
            if rows > 0:
                grid = ids[: (rows + 1) * octave].reshape(rows + 1, octave)
                row, more = np.nonzero(grid[1:] == grid[:-1, :1])
                at, p = row * octave, more + octave
                inside = at + 3 * p <= ends[doc[at]]
                at, p = at[inside], p[inside]
                same = equal(at, p, 2 * p)
                at, p = at[same], p[same]
                for k in range(8):  # a period that a divisor explains is none of its own; no number below 2^32 has nine primes or more
                    prime = np.array([f[k] if k < len(f := _primes(v)) else 0 for v in p.tolist()], dtype=np.int64)
                    some = np.flatnonzero(prime)
                    if not len(some):
                        break
                    d = p[some] // prime[some]
                    left = np.ones(len(p), dtype=bool)
                    left[some] = ~equal(at[some], d, 3 * p[some] - d)
                    at, p = at[left], p[left]
                if len(at):
                    yield octave, np.unique(at)
            octave *= 2


def _bundles(marks: np.ndarray, octave: int, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(document, boundaries, first word, end) of tiles of one document that overlap, up to about ``BUNDLE`` words each."""
    owner = doc[marks]
    breaks = np.flatnonzero((np.diff(owner) > 0) | (np.diff(marks) > 8 * octave)) + 1
    for part in np.split(marks, breaks):
        d = int(doc[part[0]])
        for k in range(0, len(part), max(1, BUNDLE // octave)):
            some = part[k : k + max(1, BUNDLE // octave)]
            yield d, some, max(int(starts[d]), int(some[0]) - octave), min(int(ends[d]), int(some[-1]) + 7 * octave)


def _explode(texts: list[bytes], keys: list, words: Words) -> tuple[list[list[bytes]], list[list[dict]]]:
    """Words of every text, and its live tiles (octave, first word, boundaries and numbered words)."""
    lists = [words(k, t) for k, t in zip(keys, texts)]
    names: dict[bytes, int] = {}
    number = names.setdefault
    ids = np.fromiter((number(w, len(names)) for ws in lists for w in ws), dtype=np.int32, count=sum(map(len, lists)))
    sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(lists)), sizes)
    tiles: list[list[dict]] = [[] for _ in lists]
    for octave, marks in live_tiles(ids, doc, ends, int(sizes.max(initial=0))):
        for d, some, a, z in _bundles(marks, octave, doc, starts, ends):
            tiles[d].append({"octave": octave, "first": a - int(starts[d]), "marks": (some - a).astype(np.int32), "ids": ids[a:z]})
    return lists, tiles


def explode(docs: DataFrame, text: str, key: str, rest: list[str], words: Words, keep_text: bool) -> DataFrame:
    """Per row: the columns ``rest``, _doc and _name (key and a hash of the words), _n, _sha, _words (joined), _live and _tiles.

    Where no tile is live there is no run, so the digest of the words is enough.
    """
    slim = docs.select(*rest, F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    tile = "array<struct<octave:int, first:int, marks:array<int>, ids:array<int>>>"
    schema = "".join(f"`{n}` {t}, " for n, t in slim.dtypes if n not in ("_doc", "_text")) + f"_doc long, _name binary, _n long, _sha string, _words binary, _live boolean, _tiles {tile}"

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f: batch.column(i) for i, f in enumerate(batch.schema.names[:-1])} | {k: [] for k in ("_name", "_n", "_sha", "_words", "_live", "_tiles")}
            keys = batch.column(batch.num_columns - 2).to_pylist()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, z in slices(texts, CHARACTERS):
                for ws, tiles in zip(*_explode(texts[a:z], keys[a:z], words)):
                    joined = b" ".join(ws)
                    digest = hashlib.sha256(joined)
                    out["_name"].append(digest.digest())
                    out["_n"].append(len(ws))
                    out["_sha"].append(digest.hexdigest())
                    out["_words"].append(joined if tiles or keep_text else None)
                    out["_live"].append(bool(tiles))
                    out["_tiles"].append(tiles)
            return out

        return step

    return over_batches(slim, make, schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of each row of tiles, with those of neighbouring tiles already joined."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("_doc", "_name", "period", "lo", "hi")}
        for r in range(batch.num_rows):
            doc, name, octave, first = (batch.column(i)[r].as_py() for i in range(4))
            ids = batch.column(5)[r].values.to_numpy().tolist()
            open_: dict[int, list[int]] = {}
            for m in batch.column(4)[r].values.to_numpy().tolist():
                for p, left, right in solve_tile(ids[max(0, m - octave) : m], ids[m : m + 7 * octave], octave):
                    lo, hi = first + m - left, first + m + right
                    held = open_.get(p)
                    if held and lo <= held[1]:
                        held[1] = max(held[1], hi)
                        continue
                    if held:
                        for k, v in zip(rows, (doc, name, p, *held)):
                            rows[k].append(v)
                    open_[p] = [lo, hi]
            for p, held in open_.items():
                for k, v in zip(rows, (doc, name, p, *held)):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(rows.values(), (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))], names=list(rows))


def stitch(fragments: DataFrame) -> DataFrame:
    """(_doc, _name, start, length, period) of the maximal stretches that fragments of one document and period add up to."""
    w = Window.partitionBy("_doc", "_name", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = fragments.withColumn("_new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    joined = joined.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("_doc", "_name", "period", "_part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return whole.select("_doc", "_name", "start", length.alias("length"), "period").where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))


def find_runs(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", words: Words = words_of, keep_text: bool = False) -> DataFrame:
    """The other columns and n_words, runs, collapsed_sha256; with ``keep_text`` also ``collapsed``.

    ``runs`` is array<struct<start long, length long, period long>> by start, then period. A run is a stretch of
    words whose smallest period is ``period`` and whose length is at least 4 periods and 6 words, and that no
    neighbouring word extends. A word is dropped from the collapsed text if a run contains it after the run's first
    period. ``words(key, text)`` reads the words of a text.

    A null text has no words. A text without words has no runs and an empty collapsed text. Rows that share
    their key, or have none, are told apart by their words; repeated rows each give a row. Older columns of
    those names, and working columns _doc, _name, _n, _sha, _words, _live, _tiles, _text, are dropped.
    """
    made = ("n_words", "runs", "collapsed_sha256", "collapsed", "_doc", "_name", "_n", "_sha", "_words", "_live", "_tiles", "_text")
    rest = [c for c in docs.columns if c != text and c not in made]
    rows = saved(explode(docs, text, key, rest, words, keep_text), folder, "tiles")
    tiles = rows.where("_live").select("_doc", "_name", F.explode("_tiles").alias("t")).select("_doc", "_name", "t.*")
    solved = tiles.repartition(F.xxhash64("_name", "octave", "first")).mapInArrow(_solve, "_doc long, _name binary, period int, lo int, hi int")
    found = stitch(solved).groupBy("_doc", "_name").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("start", "length", "period")]))).alias("runs"))
    none = F.array().cast("array<struct<start:long, length:long, period:long>>")
    live = rows.where("_live").drop("_tiles", "_sha")
    same = [live["_doc"].eqNullSafe(found["_doc"]), live["_name"] == found["_name"]]
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.select(*rest).dtypes)
    schema = f"{kept}, n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed_sha256 string" + ", collapsed string" * keep_text
    joined = live.join(found, same, "left").select(*[live[c] for c in rest], live["_n"].alias("n_words"), F.coalesce("runs", none).alias("runs"), "_words")

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f: batch.column(i) for i, f in enumerate(batch.schema.names[:-1])} | {"collapsed_sha256": [], "collapsed": []}
            for runs, joined in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                ws = joined.as_py().split(b" ")
                drop = np.zeros(len(ws) + 1, dtype=np.int32)
                for r in runs.as_py():
                    drop[r["start"] + r["period"]] += 1
                    drop[r["start"] + r["length"]] -= 1
                left = b" ".join(w for w, d in zip(ws, np.cumsum(drop).tolist()) if not d)
                out["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
                out["collapsed"].append(left.decode("utf-8", "surrogatepass") if keep_text else None)
            return out

        return step

    plain = rows.where("not _live").select(*rest, F.col("_n").alias("n_words"), none.alias("runs"), F.col("_sha").alias("collapsed_sha256"),
                                           *[F.col("_words").cast("string").alias("collapsed")] * keep_text)
    return over_batches(joined, make, schema).unionByName(plain)
