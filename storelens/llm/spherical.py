"""Near-duplicate vectors by spherical-cap filters.

Unit vectors are list-decoded against structured filter directions: each direction is the
concatenation of one codeword per block of coordinates (a random product code), and a vector is
filed under every direction whose inner product with it reaches the cap height. Decoding sums
the blocks' partial products and prunes partial sums that cannot reach the height any more. Two
vectors meet where they share a filter; the exact cosine in double precision then decides, and a
pair that shares several filters counts in the smallest only. Equal vectors are one node.

The filters find a link with high probability, not certainty: with the defaults, links at
cosine of exactly 0.98 in 64 dimensions are found in 99.5 % of cases, closer ones more often
(measured; the tests compare with brute force).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved
from storelens.llm.graph import Forest, components, pairs_in, tiled, whole_groups

THRESHOLD = 0.98
ROTATIONS, BLOCKS, WORDS = 16, 2, 64
CAP = 3.35  # cap height in standard deviations of a random unit vector's inner product
TILE = 1024
DENSE = 48  # groups of more rows are compared as matrices


def codes(dim: int, blocks: int = BLOCKS, words: int = WORDS, rotations: int = ROTATIONS, seed: int = 17) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per code its rotation, and per block the codewords (words x coordinates) of length 1 / sqrt(blocks), so every direction is a unit vector.

    Several rotated codes even out vectors whose blocks differ in length under one of them.
    """
    r, cuts = np.random.default_rng(seed), [dim * i // blocks for i in range(blocks + 1)]
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        words_of = [r.standard_normal((words, z - a)) for a, z in zip(cuts, cuts[1:])]
        out.append((turn, [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / blocks**0.5 for c in words_of]))
    return out


def filters(dim: int, cap: float = CAP) -> tuple[list[tuple[np.ndarray, list[np.ndarray]]], float]:
    """Codes and cap height for a number of dimensions.

    Below 32 dimensions a cap of that many deviations would be too small for two near vectors to
    share (or empty), so the height stops at 0.6 and fewer directions give lists of about the same length.
    """
    if cap / dim**0.5 <= 0.6:
        return codes(dim), cap / dim**0.5
    r = np.random.default_rng(23).standard_normal((50_000, dim))
    share = max((r[:, 0] / np.linalg.norm(r, axis=1) >= 0.6).mean(), 1e-4)
    return codes(dim, words=min(WORDS, max(4, int(np.ceil((24 / share / 8) ** 0.5)))), rotations=8), 0.6


def decode(x: np.ndarray, code: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter direction whose inner product with the unit vector of that row is at least ``height``."""
    cuts = np.cumsum([0] + [c.shape[1] for c in code])
    parts = [x[:, a:z] @ c.T for a, z, c in zip(cuts, cuts[1:], code)]
    best = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]  # the most that this block and later ones can add
    row, number, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for k, p in enumerate(parts):
        rest = best[k + 1] if k + 1 < len(parts) else np.zeros(len(x))
        sums = total[:, None] + p[row]
        at, word = np.nonzero(sums + rest[row][:, None] >= height)
        row, number, total = row[at], number[at] * code[k].shape[0] + word, sums[at, word]
    return row, number


def decode_all(x: np.ndarray, turned: list[tuple[np.ndarray, list[np.ndarray]]], height: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all codes, sorted by row and filter; filters of different codes have different numbers."""
    found = [(row, number + k * int(np.prod([len(c) for c in code]))) for k, (turn, code) in enumerate(turned) for row, number in [decode(x @ turn, code, height)]]
    row, number = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((number, row))
    return row[order], number[order]


def dense_links(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the graph whose upper triangle is ``near``."""
    label, a, b = np.arange(len(near)), [], []
    for i in range(len(near)):
        j = np.flatnonzero(near[i])
        j = j[label[j] != label[i]]
        while len(j):
            a.append(i)
            b.append(int(j[0]))
            label[label == label[j[0]]] = label[i]
            j = j[label[j] != label[i]]
    return a, b


def shared_below(lists: list[list[int]], limit: int) -> np.ndarray:
    """Whether two lists share a number below ``limit``, for all pairs of lists."""
    size = np.array([len(x) for x in lists])
    flat, row = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]), np.repeat(np.arange(len(lists)), size)
    flat, row = flat[flat < limit], row[flat < limit]
    names, column = np.unique(flat, return_inverse=True)
    shared = np.zeros((len(lists), len(lists)), dtype=np.float32)
    for k in range(0, len(names), 4096):
        some = (column >= k) & (column < k + 4096)
        m = np.zeros((len(lists), min(4096, len(names) - k)), dtype=np.float32)
        m[row[some], column[some] - k] = 1
        shared += m @ m.T
    return shared > 0.5


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype="<f4" if len(b) == 4 * dim else "<f8").astype(np.float64) for b in raw])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, dim, raw (the components as floats where those are exact, else doubles); raw is null where the row links with nothing.

    That is where the label or the vector is null, the vector is empty or zero, or a component is null or not finite.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for lab, v in zip(batch.column(1), batch.column(2)):
                x = None if not lab.is_valid or not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                big = np.abs(x).max(initial=0.0) if x is not None and np.isfinite(x).all() else 0.0
                with np.errstate(over="ignore"):
                    slim = None if not big > 0 else (x + 0.0).astype("<f4")
                raw.append(None if slim is None else (slim if (slim == x).all() else (x + 0.0).astype("<f8")).tobytes())
                dims.append(len(x) if raw[-1] is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["key", "label", "dim", "raw"])

    slim = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return slim.mapInArrow(run, "key long, label string, dim int, raw binary")


def near_duplicates(rows: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, cap: float = CAP) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable), kept (whether that is the row's own key).

    Only rows with equal labels and equally many components are compared. Rows that share a key are rows of their own; a row
    that links with nothing is its own component. Other columns are dropped.
    """
    all_rows = saved(vectors(rows, key, vector, label), folder, "vectors")
    live = all_rows.where("raw is not null")
    nodes = saved(live.groupBy("label", "raw").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"))
                  .withColumn("id", F.monotonically_increasing_id()), folder, "nodes")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                code, height = known[int(dim)] = known.get(int(dim)) or filters(int(dim), cap)
                for part in np.array_split(np.flatnonzero(dims == dim), 1 + len(dims) // 512):
                    if not len(part):
                        continue
                    some = batch.take(pa.array(part))
                    row, number = decode_all(_unit(some.column(1).to_pylist(), int(dim)), code, height)
                    starts = np.searchsorted(row, np.arange(len(part) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(number, pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["id", "filters"])

    filed = nodes.select("id", "raw", "dim").mapInArrow(file, "id long, filters array<long>")
    met = saved(nodes.join(saved(filed, folder, "filed"), "id"), folder, "lists")
    spread = met.select("id", "copies", "raw", "filters", F.explode("filters").alias("filter"), F.xxhash64("label", "dim", "filter").alias("meet"), "label", "dim")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["meet", "_a", "_b"], 20_000):
            ids, copies, here = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("filter").to_numpy()
            part, cross = t.column("_part").to_numpy(), t.column("_a").to_numpy() != t.column("_b").to_numpy()
            kinds, dims = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("dim").to_numpy()
            lists = t.column("filters").to_pylist()
            raw = t.column("raw").to_pylist()
            forest, degree = Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
            width = int(dims.max())
            x = np.zeros((len(ids), width))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x[at, : int(d)] = _unit([raw[i] for i in at], int(d))
            longest = max(map(len, lists))
            table = np.full((len(lists), longest), -1, dtype=np.int64)
            for i, f in enumerate(lists):
                table[i, : len(f)] = f
            for p, q in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if q - p <= DENSE:
                    continue
                some = slice(p, q)
                near = np.triu(x[some] @ x[some].T >= threshold, 1)
                for v in (kinds[some], dims[some], here[some]):
                    if (v != v[0]).any():
                        near &= v[:, None] == v[None, :]
                if cross[p]:
                    near &= part[some][:, None] != part[some][None, :]
                a, b = dense_links(near)
                forest.add(np.array(a, dtype=np.int64) + p, np.array(b, dtype=np.int64) + p)
                if near.any():
                    near &= ~shared_below(lists[p:q], int(here[p]))
                    degree[some] += near @ copies[some] + near.T @ copies[some]
            for i, j in pairs_in(starts, part, cross, 1 << 14, DENSE):
                same = (kinds[i] == kinds[j]) & (dims[i] == dims[j]) & (here[i] == here[j])
                i, j = i[same], j[same]
                near = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
                i, j = i[near], j[near]
                if not len(i):
                    continue
                forest.add(i, j)
                first = np.ones(len(i), dtype=bool)  # no smaller filter holds both
                for k in range(longest):
                    f = table[i, k]
                    first &= ~((f >= 0) & (f < here[i]) & (table[j] == f[:, None]).any(axis=1))
                i, j = i[first], j[first]
                np.add.at(degree, i, copies[j])
                np.add.at(degree, j, copies[i])
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(degree[some]), pa.array([None] * len(some), pa.int64())], names=["id", "n", "to"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[forest.a]), pa.array([0] * len(forest.a), pa.int64()), pa.array(ids[forest.b])], names=["id", "n", "to"])

    order = ["meet", "_a", "_b", "_part", "id", "copies", "raw", "filters", "filter", "label", "dim"]
    found = saved(tiled(spread, "meet", "id", TILE, folder, "meetings").select(*order).mapInArrow(compare, "id long, n long, to long"), folder, "found")
    degrees = found.where("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")), folder)
    rooted = saved(nodes.join(degrees, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
                   .select("label", "raw", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), folder, "rooted")
    smallest = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), folder, "smallest")
    named = saved(rooted.join(smallest, "root").select("label", "raw", "n_links", "component_id"), folder, "named")
    linked = live.select("key", "label", "raw").join(named, ["label", "raw"]).select("key", "n_links", "component_id")
    alone = all_rows.where("raw is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
