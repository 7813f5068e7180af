"""SimHash fingerprints and near-duplicate groups found with pivot distance tables.

Equal fingerprints are one node. Each node carries the table of its Hamming distances to fixed
reference fingerprints (pivots). By the triangle inequality two nodes within the radius differ
by at most the radius in every coordinate, so pairs with a larger coordinate difference are
discarded before the exact distance is computed. Nodes meet where two of six bit blocks agree,
which any pair within four bits does; large meeting places are cut into tiles, and a tile gives
the edges of a spanning forest of its links instead of all pairs. Groups are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import over_batches, saved
from storelens.llm.graph import Forest, components, pairs_in, tiled, whole_groups

SEED = 42
RADIUS = 4
BLOCKS = 6
TILE = 2048
PIVOTS = 16


def fingerprint(text: bytes, size: int = 4, seed: int = SEED) -> int:
    """A bit is one if it is set in over half of the XXH64 values of the ``size``-word shingles, repeats included.

    Words are runs of anything but ASCII white space, A-Z in lower case. Fewer words than ``size``
    make one shingle, no word the fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    values = np.array([h(joined[a:z], seed) for a, z in zip(starts[:n].tolist(), ends[size - 1 :].tolist())], dtype="<u8")
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """The other columns and ``fp``, the fingerprint as a signed long. A null text has no word."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    slim = docs.select(*rest, text)
    schema = "".join(f"`{n}` {t}, " for n, t in slim.dtypes if n != text) + "fp long"

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            fp = np.array([fingerprint((t or "").encode("utf-8", "surrogatepass"), size) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            return {f: batch.column(i) for i, f in enumerate(rest)} | {"fp": fp.view(np.int64)}

        return step

    return over_batches(slim, make, schema)


def pivots(count: int = PIVOTS, seed: int = 11) -> np.ndarray:
    """Reference fingerprints, drawn once and for all."""
    return np.random.default_rng(seed).integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(seed + 1).integers(0, 2, size=count, dtype=np.uint64)


def distances(fp: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(fp[:, None] ^ to[None, :]).astype(np.int8)


def block_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(mask, number) of every choice of ``blocks - radius`` blocks; two fingerprints within the radius agree on one of them."""
    if not 0 < radius < blocks:
        raise ValueError("there must be more blocks than bits of the radius")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:])]
    return [(sum(masks[i] for i in choice), k) for k, choice in enumerate(combinations(range(blocks), blocks - radius))]


def links(nodes: DataFrame, folder: str, radius: int = RADIUS, blocks: int = BLOCKS, name: str = "simhash") -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, enough of them to span every component; each is within ``radius``."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for m, k in block_keys(radius, blocks)])
    rows = nodes.select("fp", F.explode(keys).alias("e")).select("fp", F.xxhash64("e.k", "e.v").alias("key"))
    to = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["key", "_a", "_b"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            part = t.column("_part").to_numpy()
            cross = t.column("_a").to_numpy() != t.column("_b").to_numpy()
            table, forest = distances(fp, to), Forest(len(fp))
            for i, j in pairs_in(starts, part, cross):
                near = np.abs(table[i] - table[j]).max(axis=1) <= radius
                i, j = i[near], j[near]
                found = np.bitwise_count(fp[i] ^ fp[j]) <= radius
                forest.add(i[found], j[found])
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[forest.a]), pa.array(signed[forest.b])], names=["a", "b"])

    met = tiled(rows, "key", "fp", TILE, folder, f"{name}-keys")
    return met.select("key", "_a", "_b", "_part", "fp").mapInArrow(run, "a long, b long")


def groups(marked: DataFrame, folder: str, radius: int = RADIUS, blocks: int = BLOCKS, key: str = "doc_id") -> DataFrame:
    """``marked`` (a written table with ``fp``) and ``component_id``: the smallest ``key`` of the rows reachable over links.

    A component without any key gives null. Rows with a hot fingerprint are added up before they
    are shuffled; the joins back can be split.
    """
    nodes = saved(marked.groupBy("fp").agg(F.min(key).alias("_least")), folder, "nodes")
    edges = saved(links(nodes, folder, radius, blocks), folder, "links")
    roots = components(edges, folder)
    joined = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root")), folder, "rooted")
    least = saved(joined.groupBy("root").agg(F.min("_least").alias("component_id")), folder, "least")
    named = saved(joined.join(least, "root").select("fp", "component_id"), folder, "named")
    return marked.join(named, "fp")
