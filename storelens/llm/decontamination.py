"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits in lower case; a text is the sequence of hashes of its
five-word shingles (a shorter item: its whole sequence). Windows of an item's size are taken
where a document holds enough of the item's shingles to reach the similarity at all; such a
window may be moved right until it begins with one of them and loses none, so those starts are
all that is needed. Each window gets a SimHash over its shingles, a repeat counting as a shingle of
its own, so that the fingerprints measure what is verified. Radius + 1 bit blocks make the index:
two fingerprints within the radius agree on one block at least, so the equi-join on (size, block,
bits) holds every such pair. Candidates are verified by the weighted Jaccard similarity of their
shingle multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 26  # over five deviations above the mean distance at the similarity, for all but the shortest items
BROADCAST_ROWS = 500_000
_LANES = (1 << 42) | (1 << 21) | 1


def words(text: str) -> Column:
    """Lower-case runs of letters and digits; no word for null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(seq: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty if there are fewer words."""
    w = F.col(seq)
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))


def simhash(hashes: str) -> Column:
    """A bit is one if it is set in over half of the hashes. Three counters of 21 bits share one sum."""
    h, n = F.col(hashes), F.size(F.col(hashes)).cast("long")

    def total(of) -> Column:
        return F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + of(x))

    sums = [total(lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_LANES).cast("long"))) for j in range(21)]
    bits = [(F.shiftright(s, 21 * lane).bitwiseAND(F.lit((1 << 21) - 1).cast("long")), j + 21 * lane) for j, s in enumerate(sums) for lane in range(3)]
    bits.append((total(lambda x: F.shiftrightunsigned(x, 63)), 63))
    out = F.lit(0).cast("long")
    for count, bit in bits:
        value = -(1 << 63) if bit == 63 else 1 << bit
        out = out.bitwiseOR(F.when(count * 2 > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def block_masks(radius: int = RADIUS) -> list[int]:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [signed((1 << z) - (1 << a)) for a, z in zip(cuts, cuts[1:])]


def numbered(hashes: str) -> Column:
    """The multiset as a set: each hash with the number of its occurrence."""
    s = F.sort_array(F.col(hashes))
    return F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x)))


def _blocks(fp: str, radius: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(block_masks(radius))])


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast where the counted rows are within the limit; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def matches(docs: DataFrame, items: DataFrame, folder: str, **settings) -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window of each document for each item, where it reaches the similarity.

    ``start`` is the window's first word, the earliest among the best. Rows that share a doc_id,
    or have none, count as one document with several texts.
    """
    found = text_matches(docs, items, folder, **settings)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start"))


def drop_contaminated(docs: DataFrame, items: DataFrame, folder: str, **settings) -> DataFrame:
    """The rows whose text matches no item, with all columns."""
    found = saved(text_matches(docs, items, folder, **settings).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), folder, "found")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")


def text_matches(docs: DataFrame, items: DataFrame, folder: str, similarity: float = SIMILARITY, radius: int = RADIUS,
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start): the best window of each text for each item, where it reaches ``similarity``.

    ``text_key`` is Spark's xxhash64 of the text. Items and documents without a word match nothing.
    Other columns are not read. The benchmark's shingles are broadcast if they are at most
    ``broadcast_rows``; beyond that the joins are shuffled.
    """
    bench = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    bench = bench.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashed = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in range(1, SHINGLE + 1):
        hashed = hashed.when(F.col("k") == k, shingles("w", k))
    bench = bench.withColumn("h", hashed)
    bench = saved(bench.select("item_id", "k", "h", F.size("h").alias("n"), numbered("h").alias("item_set")).withColumn("item_fp", simhash("item_set")), folder, "items")
    count = bench.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    sizes = sorted(r[0] for r in bench.select("k").distinct().collect())  # five at most
    m = F.col("length") - F.col("k") + 1
    # shingles that a window, which a short text does not fill, must share with the item to reach the similarity
    need = F.ceil(F.lit(similarity) * (F.col("n") + F.least("n", m)) / (1 + similarity) - F.lit(1e-9)).cast("int")

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words("text").alias("w"))
    found = None
    for k in sizes:
        keys = bench.where(F.col("k") == k).select("item_id", "n", F.explode(F.array_distinct("h")).alias("s"))
        spots = rows.select("doc_id", "text_key", F.size("w").alias("length"), F.posexplode(shingles("w", k)).alias("pos", "s"))
        hits = spots.join(_small(keys, count, broadcast_rows), "s").drop("s").withColumn("k", F.lit(k))
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, similarity double, start int")
    # how many of the item's shingles begin within the window that starts at this one
    hits = saved(found.distinct(), folder, "hits")
    place = "doc_id", "text_key", "item_id"
    ahead = hits.groupBy(*place, "n", "k", "length").agg(F.sort_array(F.collect_list("pos")).alias("all")).withColumn("need", need).where(F.size("all") >= F.col("need"))
    # windows at the hits, those too near the end moved back onto the text
    room = F.greatest(F.lit(0), m - F.col("n"))
    starts = F.array_distinct(F.transform("all", lambda p: F.least(p, room)))
    dense = F.filter(starts, lambda s: F.size(F.filter("all", lambda p: (p >= s) & (p < s + F.col("n")))) >= F.col("need"))
    spans = ahead.select(*place[:2], "k", "n", F.explode(dense).alias("start")).distinct()
    per_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("k", "n", "start")).alias("spans"))
    met = rows.join(per_text, rows["doc_id"].eqNullSafe(per_text["doc_id"]) & (rows["text_key"] == per_text["text_key"])).select(rows["doc_id"], rows["text_key"], rows["w"], "spans")
    windows = None
    for k in sizes:
        part = met.select("doc_id", "text_key", shingles("w", k).alias("all"), F.explode(F.filter("spans", lambda s: s["k"] == k)).alias("span"))
        part = part.select("doc_id", "text_key", F.col("span.k").alias("k"), F.col("span.n").alias("n"), F.col("span.start").alias("start"), F.slice("all", F.col("span.start") + 1, F.col("span.n")).alias("h"))
        windows = part if windows is None else windows.union(part)
    windows = saved(windows.select("doc_id", "text_key", "k", "n", "start", numbered("h").alias("set")).withColumn("fp", simhash("set")), folder, "windows")
    index = _small(bench.select("item_id", "k", "n", "item_fp", "item_set", F.explode(_blocks("item_fp", radius)).alias("b")).select("*", "b.block", "b.bits").drop("b"), count, broadcast_rows)
    probes = windows.select("doc_id", "text_key", "k", "n", "start", "set", "fp", F.explode(_blocks("fp", radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(block_masks(radius))])
    near = probes.join(index, ["k", "n", "block", "bits"]).where((F.bit_count(apart) <= radius) & (first == F.col("block")))
    judged = near.select("doc_id", "text_key", "item_id", "start", (F.size("set") + F.size("item_set")).alias("both"), F.size(F.array_intersect("set", "item_set")).alias("shared"))
    judged = judged.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = judged.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "text_key", "item_id", "b.similarity", (-F.col("b.back")).alias("start"))
