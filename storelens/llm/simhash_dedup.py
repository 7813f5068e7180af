"""Near-duplicate documents by SimHash, verified by word-shingle similarity.

Texts with the same words in the same order are one node. Nodes meet at the smallest hashes of
their five-word shingles: two sets with Jaccard similarity s share one of the k smallest with a
probability of about 1 - (1 - s)^k, over 99.99 % for the defaults. Where they meet, the pivot
distance table discards pairs by their largest coordinate difference, the Hamming distance of the
fingerprints discards more, and the exact Jaccard similarity of the shingle sets decides. The
fingerprints are built from the sets too, so a line repeated often weighs no more than once. Pairs
that are already linked through others are not verified again, and only the links of a spanning
forest leave a task.

Shingles of lines that many texts share would be meeting places whose pairs grow with the square of
the input. A node leaves those of over ``TILE`` nodes and instead meets at its smallest hashes that
are rare among such nodes, as many as make a miss no likelier than elsewhere for the share of
its set that is common; a node that is common for the most part stays as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import drop_folder, over_batches, saved
from storelens.llm.graph import Forest, components, pairs_in, tiled, whole_groups
from storelens.llm.simhash import SEED, distances, pivots

SHINGLE = 5
SIMILARITY = 0.8
MEETINGS = 6
RADIUS = 26  # of the fingerprints: over four deviations above the mean distance at the similarity
TILE = 512
LOOK = 64  # so many smallest hashes of a node tell which share of its set is common


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one, no word none."""
    words = text.lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    return np.unique(np.array([h(joined[a:z], SEED) for a, z in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64))


def set_fingerprint(values: np.ndarray) -> int:
    """SimHash of a shingle set: a bit is one if it is set in over half of the distinct hashes; zero for none."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def node_of(text: bytes) -> int:
    """Identity of a text's words in order, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))).astype(np.int64))


def _rows(docs: DataFrame) -> DataFrame:
    """id, tk (hash of the text), node, keys."""
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            return {"id": batch.column(0), "tk": batch.column(1), "node": [node_of(t) for t in texts], "keys": [shingle_set(t)[:MEETINGS].view(np.int64) for t in texts]}

        return step

    return over_batches(docs.select("id", F.xxhash64("text").alias("tk"), "text"), make, "id long, tk long, node long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """node, fp, set of the texts."""
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            sets = [shingle_set(t) for t in texts]
            fp = np.array([set_fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            return {"node": [node_of(t) for t in texts], "fp": fp, "set": [s.tobytes() for s in sets]}

        return step

    return over_batches(docs, make, "node long, fp long, set binary")


def _rarer(hot: DataFrame, sets: DataFrame, folder: str, similarity: float) -> DataFrame:
    """node, left (hot keys that it gives up), extra (rare hashes it meets at), from the nodes (key, node) of hot keys.

    With a common share f of the union, sets of the similarity s share (s - f) / (1 - f) of the rest at least. f is known from
    ``LOOK`` hashes, so a tenth is added.
    """
    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64)[:LOOK].view(np.int64) for s in batch.column(1)]
            times = np.array([len(s) for s in sets], dtype=np.int64)
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            return {"node": np.repeat(batch.column(0).to_numpy(), times), "place": place, "key": np.concatenate(sets) if sets else []}

        return step

    left = hot.groupBy("node").agg(F.collect_set("key").alias("left"))
    first = saved(over_batches(sets.join(left.select("node"), "node").select("node", "set"), make, "node long, place int, key long"), folder, "first")
    common = first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("key", F.lit(True).alias("common"))
    told = first.join(F.broadcast(common), "key", "left").groupBy("node").agg(  # a row of common for over TILE of first
        (F.count("common") / F.count("*") + 0.1).alias("f"), F.array_sort(F.collect_list(F.when(F.col("common").isNull(), F.struct("place", "key")))).alias("rare"))
    goes = F.col("f") < (similarity - 0.2) / 0.8  # the rest then shares over a fifth
    shared = (similarity - F.col("f")) / (1 - F.col("f"))
    miss = MEETINGS * float(np.log(max(1 - similarity, 1e-9)))  # as at MEETINGS hashes of which none is common
    most = F.when(goes, F.ceil(miss / F.log(F.greatest(1 - shared, F.lit(1e-9)))).cast("int")).otherwise(LOOK)
    told = told.select("node", goes.alias("goes"), F.slice("rare.key", 1, most).alias("extra"))
    return told.join(left, "node").select("node", F.when(F.col("goes"), F.col("left")).otherwise(F.array().cast("array<bigint>")).alias("left"), "extra")


def groups(docs: DataFrame, folder: str, similarity: float = SIMILARITY) -> DataFrame:
    """node, component_id (smallest doc_id of the group), from columns doc_id and text.

    Texts without a word are one node. A group without any doc_id gives null.
    """
    return _grouped(docs, folder, similarity)[1]


def _grouped(docs: DataFrame, folder: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows (id, tk, node) of the documents, and ``groups``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = saved(_rows(slim), folder, "rows")
    nodes = saved(rows.groupBy("node").agg(F.min("id").alias("id"), F.min_by("tk", "id").alias("tk"), F.first("keys").alias("keys")), folder, "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    counts = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), folder, "counts")
    some = keyed.join(counts, "key").select("node").distinct().join(nodes.where("id is not null").select("node", "id", "tk"), "node")
    # one text a node: its sets need no shuffle of their own
    texts = slim.withColumn("tk", F.xxhash64("text")).join(some.select("id", "tk"), ["id", "tk"]).dropDuplicates(["id", "tk"])
    sets = saved(_sets(texts.select("text")), folder, "sets")
    keys, extra = F.col("keys"), F.array().cast("array<bigint>")
    hot = counts.where(F.col("n") > TILE).select("key")
    if not hot.isEmpty():
        rarer = saved(_rarer(keyed.join(F.broadcast(hot), "key"), sets, folder, similarity), folder, "rarer")  # a row of hot for over TILE of keyed
        nodes = saved(nodes.join(rarer, "node", "left").select("node", "id", F.when(F.col("left").isNull(), keys).otherwise(F.array_except(keys, F.col("left"))).alias("keys"),
                                                               F.coalesce("extra", extra).alias("extra")), folder, "placed")
        extra = F.col("extra")
    met = saved(tiled(nodes.select("node", F.explode(F.array_union("keys", extra)).alias("key")), "key", "node", TILE, folder, "keys"), folder, "met")
    slight = sets.select("node", "fp", (F.length("set") / 8).cast("int").alias("size")).join(nodes.select("node", "keys"), "node")
    to = pivots()

    def near(i: np.ndarray, j: np.ndarray, size: np.ndarray, table: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose sizes, pivot distances and fingerprints are close enough."""
        close = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & (np.abs(table[i] - table[j]).max(axis=1) <= RADIUS)
        i, j = i[close], j[close]
        close = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        return i[close], j[close]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of a tile that have a near partner in it with which they share no smaller key."""
        for t, starts in whole_groups(batches, ["key", "_a", "_b"], 20_000):
            here, part = t.column("key").to_numpy(), t.column("_part").to_numpy()
            cross = t.column("_a").to_numpy() != t.column("_b").to_numpy()
            fp, size = t.column("fp").to_numpy().view(np.uint64), t.column("size").to_numpy()
            lists = t.column("keys").combine_chunks()
            row = np.repeat(np.arange(len(here)), np.diff(lists.offsets.to_numpy()))
            keys = np.zeros((len(here), MEETINGS), dtype=np.int64)
            there = np.zeros((len(here), MEETINGS), dtype=bool)
            at = np.arange(len(row)) - (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[row]
            keys[row, at], there[row, at] = lists.flatten().to_numpy(), True
            there &= keys < here[:, None]
            table, wanted = distances(fp, to), np.zeros(len(here), dtype=bool)
            for i, j in pairs_in(starts, part, cross):
                i, j = near(i, j, size, table, fp)
                fresh = ~(wanted[i] & wanted[j])
                i, j = i[fresh], j[fresh]
                shared = ((keys[i][:, :, None] == keys[j][:, None, :]) & there[i][:, :, None]).any(axis=(1, 2))
                wanted[i[~shared]] = wanted[j[~shared]] = True
            some = t.select(["key", "_a", "_b", "_part", "node"]).filter(pa.array(wanted))
            yield from some.to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["key", "_a", "_b"], 2_000):
            node, part = t.column("node").to_numpy(), t.column("_part").to_numpy()
            cross = t.column("_a").to_numpy() != t.column("_b").to_numpy()
            fp = t.column("fp").to_numpy().view(np.uint64)
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in t.column("set")]
            size = np.array([len(s) for s in sets])
            table, forest = distances(fp, to), Forest(len(fp))
            for i, j in pairs_in(starts, part, cross):
                for a, b in zip(*[x.tolist() for x in near(i, j, size, table, fp)]):
                    if forest.find(a) != forest.find(b):
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                            forest.add(np.array([a]), np.array([b]))
            yield pa.RecordBatch.from_arrays([pa.array(node[forest.a]), pa.array(node[forest.b])], names=["a", "b"])

    # sets go only where a pair is to be verified, and a pair is verified at its smallest shared key (once more at extra ones)
    tiles = met.join(slight, "node").repartition("key", "_a", "_b").sortWithinPartitions("key", "_a", "_b")
    marked = saved(tiles.select("key", "_a", "_b", "_part", "node", "fp", "size", "keys").mapInArrow(mark, "key long, _a int, _b int, _part int, node long"), folder, "marked")
    full = marked.join(sets, "node").repartition("key", "_a", "_b").sortWithinPartitions("key", "_a", "_b")
    edges = saved(full.select("key", "_a", "_b", "_part", "node", "fp", "set").mapInArrow(compare, "a long, b long"), folder, "links")
    roots = components(edges, folder)
    rooted = saved(nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), folder, "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("id").alias("component_id")), folder, "least")
    named = saved(rooted.join(least, "root").select("node", "component_id"), folder, "named")
    for name in ("nodes", "counts", "sets", "first", "rarer", "placed", "keys", "keys-counts", "met", "marked", "links", "rooted", "least"):
        drop_folder(docs.sparkSession, f"{folder}/{name}")
    return rows.select("id", "tk", "node"), named


def keep_one(docs: DataFrame, folder: str) -> DataFrame:
    """The documents whose doc_id is the smallest of their group, with all columns.

    Rows that repeat one doc_id and text stay or go together; rows without doc_id stay unless
    their group has a document with one. Texts without a word are a group like any other.
    """
    rows, named = _grouped(docs, folder)
    gone = saved(rows.join(named, "node").where(F.coalesce(F.col("component_id") != F.col("id"), F.col("component_id").isNotNull()))
                 .select(F.col("id").alias("_gone"), F.col("tk").alias("_tk")).distinct(), folder, "gone")
    for name in ("rows", "named"):
        drop_folder(docs.sparkSession, f"{folder}/{name}")
    # the texts leave by the hash they came in with: they are not read by Python again
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_tk")), "left_anti")
