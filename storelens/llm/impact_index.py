"""Exact top-k search by inner product over an impact-ordered index.

Vectors are dealt over shards of bounded size. A shard's index holds, for every component, its
posting segments: the rows whose value lies in one of a few ranges (the quantised impact), with
the least and greatest value of the segment. A query weighs each segment by the most it can
add to a score, processes segments by descending weight and adds the weights up per row. A row
with c components processed can reach its sum and, for every other component, at most the
weight of the next segment. The k best exact scores known so far are a proven floor; processing
stops once rescoring the rows that can reach the floor costs less than the postings that are left,
and these rows, all of them, are rescored exactly. No row is given up without that proof.

The index is a table that can be searched again. Queries are dealt over blocks; block and shard meet
in one task at a time and hand on k rows a query, the best k of which are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import saved
from storelens.llm.graph import whole_groups

SCALE = 256
SHARD, BLOCK = 4096, 16384  # rows of a shard, queries of a block, on average
SEGMENTS = 16  # of a component in a shard
CHUNK_BYTES = 1 << 14  # of vectors in one row of the index
LARGEST = 2.0**62
STAGES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # shares of the postings after which the bound is looked at

INDEX = "dim int, shard long, part int, keys array<long>, lows array<double>, highs array<double>, starts array<int>, body binary"


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, dim, raw): the distinct rows whose vector takes part, with floor(scale * x) of every component.

    A row takes no part if its key or vector is null, or a component is null, not finite, or beyond the range of 2^62.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if x is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(scale * x) + 0.0
                    x = x if np.isfinite(x).all() and np.abs(x).max(initial=0) <= LARGEST else None
                raw.append(None if x is None else x.astype("<f4" if np.abs(x).max(initial=0) < 1 << 24 else "<f8").tobytes())
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["key", "dim", "raw"])

    slim = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null")
    return slim.mapInArrow(run, "key long, dim int, raw binary").where("raw is not null").distinct()


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, dtype="<f4" if len(b) == 4 * dim else "<f8") for b in raw], dtype=np.float64).reshape(len(raw), dim)


def _numbered(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their place ``name`` among the groups of about ``size`` rows of equal dim, and per dim the number of groups."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias("groups"))
    return rows.join(sizes, "dim").withColumn(name, F.pmod(F.xxhash64("key", "raw"), "groups")).drop("groups"), sizes


def _segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest value and start of each segment of one component, and the row numbers by segment."""
    least, most = values.min(), values.max()
    step = max((most - least) / SEGMENTS, 1.0)
    level = np.minimum((values - least) // step, SEGMENTS - 1).astype(np.int8)
    order = np.argsort(level, kind="stable").astype(np.uint32)
    starts = np.flatnonzero(np.diff(level[order], prepend=-1))
    return np.minimum.reduceat(values[order], starts), np.maximum.reduceat(values[order], starts), starts.astype(np.int32), order


def build_index(rows: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """The index of rows (key, dim, raw): per shard the rows themselves in chunks (part below zero) and each component's segments."""
    placed, _ = _numbered(rows, shard, "shard")
    kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("part", pa.int32()), ("keys", pa.list_(pa.int64())), ("lows", pa.list_(pa.float64())),
                       ("highs", pa.list_(pa.float64())), ("starts", pa.list_(pa.int32())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["dim", "shard"], shard):
            keys, dims, numbers, raw = t.column("key").to_numpy(), t.column("dim").to_numpy(), t.column("shard").to_numpy(), t.column("raw").to_pylist()
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                dim, number, x = int(dims[a]), int(numbers[a]), _matrix(raw[a:z], int(dims[a]))
                rows, step = [], max(1, CHUNK_BYTES // max(8 * dim, 1))
                for k, i in enumerate(range(0, z - a, step)):
                    rows.append((-1 - k, keys[a + i : min(a + i + step, z)], [], [], [], x[i : i + step].tobytes()))
                for d in range(dim):
                    low, high, starts, order = _segments(x[:, d])
                    rows.append((d, [], low, high, starts, order.tobytes()))
                columns = [[dim] * len(rows), [number] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)

    dealt = placed.select("dim", "shard", "key", "raw").repartition("dim", "shard").sortWithinPartitions("dim", "shard")
    return saved(dealt.mapInArrow(run, INDEX), folder, "index")


class Shard:
    """One shard's index in memory."""

    def __init__(self, t: pa.Table):
        parts = t.column("part").to_numpy()
        order = np.argsort(parts)
        self.dim = int(t.column("dim")[0].as_py())
        keys, body, lists = t.column("keys").to_pylist(), t.column("body").to_pylist(), {k: t.column(k).to_pylist() for k in ("lows", "highs", "starts")}
        chunks = [i for i in order[::-1] if parts[i] < 0]
        dims = [i for i in order if parts[i] >= 0]
        self.keys = np.array([k for i in chunks for k in keys[i]], dtype=np.int64)
        n = len(self.keys)
        self.x = np.frombuffer(b"".join(body[i] for i in chunks), dtype=np.float64).reshape(n, self.dim)
        self.members = np.concatenate([np.frombuffer(body[i], dtype=np.uint32) for i in dims]).astype(np.intp) if dims else np.zeros(0, np.intp)
        self.low, self.high = (np.array([v for i in dims for v in lists[k][i]]) for k in ("lows", "highs"))
        self.component = np.repeat(np.arange(len(dims)), [len(lists["starts"][i]) for i in dims]).astype(np.intp)
        self.start = np.array([d * n + s for d, i in enumerate(dims) for s in lists["starts"][i]], dtype=np.int64)
        self.end = np.append(self.start[1:], n * len(dims))
        self.most = np.abs(self.x).max(axis=0, initial=0)

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products as integers, those beyond the range of a long at its ends; in Python's numbers where doubles could not hold them."""
        if float(self.most @ np.abs(q)) < 2.0**53:
            return (self.x[rows] @ q).astype(np.int64)
        small = [int(v) for v in q]
        return np.array([max(-(1 << 63) + 1, min((1 << 63) - 1, sum(int(a) * b for a, b in zip(r, small)))) for r in self.x[rows].tolist()], dtype=np.int64)

    def best(self, key: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Keys and scores of the k best rows with other keys, ties to smaller keys."""
        n = len(self.keys)
        own = np.flatnonzero(self.keys == key)
        slack = 1e-12 * float(self.most @ np.abs(q))  # of sums of doubles
        weight = np.maximum(q[self.component] * self.low, q[self.component] * self.high)
        order = np.argsort(-weight, kind="stable")
        size = (self.end - self.start)[order]
        done_after = np.cumsum(size)
        total, count, known, at = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), 0
        known[own] = True
        floor: list = []
        reach = np.full(n, np.inf)
        for share in STAGES if len(order) else ():
            z = int(np.searchsorted(done_after, share * n * self.dim - 0.5)) + 1
            some = order[at:z]
            if len(some):
                rows = np.concatenate([self.members[a:b] for a, b in zip(self.start[some].tolist(), self.end[some].tolist())])
                total += np.bincount(rows, np.repeat(weight[some], size[at:z]), n)
                count += np.bincount(rows, minlength=n)
                at = z
            rest = weight[order[at]] if at < len(order) else 0.0
            reach = total + rest * (self.dim - count) + slack
            reach[own] = -np.inf
            if n - len(own) <= k:
                break
            top = np.argpartition(-reach, k - 1)[:k]
            new = top[~known[top]]
            known[new] = True
            floor = sorted([*floor, *self.exact(new, q).tolist()], reverse=True)[:k]
            if len(floor) == k and (reach >= floor[-1]).sum() * self.dim <= n * self.dim - done_after[at - 1]:
                break
        possible = np.flatnonzero(reach >= floor[-1]) if len(floor) == k else np.setdiff1d(np.arange(n), own)
        scores, keys = self.exact(possible, q), self.keys[possible]
        first = sorted(zip((-scores).tolist(), keys.tolist()))[:k]
        return [i for _, i in first], [-s for s, _ in first]


def search(index: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the index with the greatest inner products with each query (key, dim, raw).

    Rows of other numbers of components are not compared, rows with the query's key are its own and left out; ties go to
    the smaller key; fewer rows than k give all. Scores that do not fit a long are taken as the greatest one or its negative. Different
    queries with one key are searched one by one.
    """
    blocks, sizes = _numbered(queries, block, "block")
    shards = index.where("part = -1").select(F.col("dim").alias("of"), F.col("shard").alias("at"))
    here = index.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    there = blocks.join(shards, F.col("dim") == F.col("of")).select(F.col("of").alias("dim"), F.col("at").alias("shard"), "block", "key", "raw", F.xxhash64("raw").alias("name"))
    kinds = pa.schema([("query_id", pa.int64()), ("name", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(postings: pa.Table, some: pa.Table) -> pa.Table:
        out: dict[str, list] = {f: [] for f in kinds.names}
        if postings.num_rows and some.num_rows:
            shard = Shard(postings)
            for key, name, q in zip(some.column("key").to_pylist(), some.column("name").to_pylist(), _matrix(some.column("raw").to_pylist(), shard.dim)):
                keys, scores = shard.best(key, q, k)
                out["query_id"] += [key] * len(keys)
                out["name"] += [name] * len(keys)
                out["vec_id"] += keys
                out["score"] += scores
        return pa.table(out, schema=kinds)

    cell = ("dim", "shard", "block")
    found = here.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(meet, "query_id long, name long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
