"""Removal of bytes covered by 100-byte strings that also start earlier.

Every 100-byte string has an anchor: the leftmost of its 20-byte grams with the smallest hash.
Equal strings have equal anchors at equal places, so only runs of starts whose anchor occurs
more than once can hold repeats (counted over all documents). A run's snippet is the bytes its
strings cover. Equal snippets are one variant; all its occurrences but the first are repeats as
a whole. A variant that shares its anchor with others is cut in two: its starts 40 bytes or more
before the anchor, whose strings all hold the 60 bytes up to the anchor's end, and the others,
whose strings all hold the 60 bytes from the anchor on. Halves that share these 60 bytes are
compared by shards: each shard's Burrows-Wheeler transform is made by itself, the transforms are
merged by interleave refinement to depth 100, and the blocks of the merged order are the repeated
strings. Where more halves than fit a task share them, every string becomes a row, and its first
place is an aggregate: the work grows with the halves, not with their pairs.

Ordering is by (doc_id, start). A null doc_id comes after all others. Repeated rows of a doc_id
and text are one document; different texts of one doc_id are ordered by start, then by a hash of
the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.bwt import classes
from storelens.llm.common import bounded_batches, drop_folder, over_batches, saved, slices
from storelens.llm.graph import whole_groups

LENGTH = 100
GRAM = 20
SLICE = 1 << 18
SEPARATOR = 0xFF  # no UTF-8 text holds this byte
HALF = (LENGTH - GRAM) // 2
TILE = 4096  # halves that are compared in one task
SHARD_BYTES = 1 << 15
LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from every position on (the last ones wrap and are not to be used)."""
    parts, out, reach, done = b.astype(np.uint64) * _A + _B, None, 1, 0
    while True:
        if size & reach:
            shifted = np.roll(parts, -done)
            out = shifted if out is None else (out * _B + shifted) ^ (out >> np.uint64(29))
            done += reach
        if done == size:
            break
        parts = (parts * _A + np.roll(parts, -reach)) * _B
        parts ^= parts >> np.uint64(31)
        reach *= 2
    out = out * _A
    return out ^ out >> np.uint64(32)


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one buffer, each one's place in it, and per run: anchor hash, text number, first start (in the buffer), number of starts."""
    buffer = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n, width = len(buffer), length - gram + 1
    none = np.array([], dtype=np.int64)
    if n < length or not (sizes >= length).any():
        return buffer, places, none.view(np.uint64), none, none, none
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    h = _gram_hashes(np.frombuffer(buffer, dtype=np.uint8), gram)
    low = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    low = np.minimum(low[: len(low) - rest], low[rest:])  # starts 0 .. n - gram - width + 1, more than needed
    at = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(n) + length <= np.repeat(places + sizes, sizes)
    starts = np.flatnonzero(valid)
    anchor, text = at[starts], owner[starts]
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    return buffer, places, h[anchor[begin]], text[begin], starts[begin], np.diff(np.append(begin, len(starts)))


def text_key(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def _anchors(docs: DataFrame) -> DataFrame:
    """h (anchor), doc, tk (hash of the text), lo (first start in the text), n (starts), c (hash of the snippet) of every run."""
    schema = "h long, doc long, tk long, lo int, n int, c long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, z in slices(texts, SLICE):
                buffer, places, h, text, start, n = runs(texts[a:z])
                of = xxhash.xxh3_64_intdigest
                c = np.array([of(buffer[i : i + k]) for i, k in zip(start.tolist(), (n + LENGTH - 1).tolist())], dtype=np.uint64)
                tk = np.array([text_key(t) for t in texts[a:z]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a + text]), pa.array(tk[text]), pa.array((start - places[text]).astype(np.int32)),
                                                  pa.array(n.astype(np.int32)), pa.array(c.view(np.int64))], names=["h", "doc", "tk", "lo", "n", "c"])

    return bounded_batches(docs).mapInArrow(run, schema)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (from, to) runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of variants' first occurrences that repeat an earlier string of another variant of the anchor, as (doc, tk, lo, from, to).

    Small batches keep the arrays of the refinement in the processor's cache; a large group still makes four shards at most.
    """
    for t, _ in whole_groups(batches, ["h"], 500):
        group = t.column("h").to_numpy()
        doc, tk, lo, n = (t.column(k).to_numpy() for k in ("doc", "tk", "lo", "n"))
        snippets = t.column("snippet").to_pylist()
        size = np.array([len(s) + 1 for s in snippets])
        shard = np.cumsum(size) // max(SHARD_BYTES, int(size.sum()) // 4 + 1)
        shards, rows, offs = [], [], []
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            text = np.frombuffer(b"".join(snippets[i] + bytes([SEPARATOR]) for i in at), dtype=np.uint8)
            shards.append(text)
            rows.append(np.repeat(at, size[at]))
            offs.append(np.arange(len(text)) - np.repeat(np.cumsum(size[at]) - size[at], size[at]))
        cls, row, off = np.concatenate(classes(shards, LENGTH)), np.concatenate(rows), np.concatenate(offs)
        live = off < n[row]
        live &= np.bincount(cls[live], minlength=int(cls.max()) + 1)[cls] > 1
        if not live.any():
            continue
        cls, row, off = cls[live], row[live], off[live]
        start = lo[row] + off
        # the earliest of each string; strings of different groups are not to be compared
        order = np.lexsort((tk[row], start, doc[row], group[row], cls))
        cls, row, off, start = cls[order], row[order], off[order], start[order]
        new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (group[row[1:]] != group[row[:-1]])])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (doc[row] != doc[row[head]]) | (start != start[head]) | (tk[row] != tk[row[head]])
        spot = np.unique(row[late].astype(np.int64) << 32 | off[late])
        first = np.concatenate([[True], np.diff(spot) != 1])[: len(spot)]
        r, a = spot[first] >> 32, spot[first] & 0xFFFFFFFF
        z = a + np.diff(np.append(np.flatnonzero(first), len(spot)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tk[r]), pa.array(lo[r]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))],
                                         names=["doc", "tk", "lo", "a", "z"])


def halves(h: np.ndarray, n: np.ndarray, snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per snippet with its anchor hash and number of starts: the hashes of the bytes all its left and all its right strings hold, and the number of left ones.

    The hash of a side without a start means nothing.
    """
    left, right, lefts = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.int64)
    for a, z in slices(snippets, SLICE):
        sizes, starts = np.array([len(s) for s in snippets[a:z]]), n[a:z].astype(np.int64)
        b = np.frombuffer(b"".join(snippets[a:z]), dtype=np.uint8)
        grams, place = _gram_hashes(b, GRAM), np.cumsum(sizes) - sizes
        # the anchor is the leftmost gram of its hash among those that all strings hold
        width = LENGTH - GRAM + 2 - starts
        row = np.repeat(np.arange(z - a), width)
        at = np.arange(len(row)) - (np.cumsum(width) - width - starts + 1)[row]
        found = np.flatnonzero(grams[place[row] + at] == h[a:z].view(np.uint64)[row])
        anchor = at[found[np.unique(row[found], return_index=True)[1]]]
        long = _gram_hashes(b, GRAM + HALF)
        left[a:z], right[a:z] = long[place + np.maximum(anchor - HALF, 0)], ~long[place + anchor]
        lefts[a:z] = np.clip(anchor - HALF + 1, 0, starts)
    return left.view(np.int64), right.view(np.int64), lefts


def _first_of_many(halves: DataFrame, folder: str) -> DataFrame:
    """What ``_compare`` gives, a row per repeating start, from halves (h, doc, tk, lo, snippet) of keys with any number of them."""
    def make():
        of = xxhash.xxh3_64_intdigest

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            snippets = batch.column(4).to_pylist()
            times = np.array([len(s) - LENGTH + 1 for s in snippets], dtype=np.int64)
            row = np.repeat(np.arange(len(times)), times)
            off = np.arange(len(row)) - (np.cumsum(times) - times)[row]
            x = np.fromiter((of(s[i : i + LENGTH]) for s, k in zip(snippets, times.tolist()) for i in range(k)), dtype=np.uint64, count=len(row))
            h, doc, tk, lo = (batch.column(k).to_numpy()[row] for k in range(4))
            return {"h": h, "x": x.view(np.int64), "doc": doc, "tk": tk, "lo": lo, "off": off}

        return step

    strings = over_batches(halves.select("h", "doc", "tk", "lo", "snippet"), make, "h long, x long, doc long, tk long, lo int, off int")
    strings = saved(strings.select("h", "x", "doc", "tk", (F.col("lo") + F.col("off")).alias("lo")), folder, "strings")
    place = F.struct("doc", "lo", "tk")
    first = strings.groupBy("h", "x").agg(F.min(place).alias("f"), F.count("*").alias("k")).where("k > 1").select("h", "x", "f")
    return strings.join(first, ["h", "x"]).where(place != F.col("f")).select("doc", "tk", "lo", F.lit(0).alias("a"), F.lit(1).alias("z"))


def _packed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """The texts compressed for the shuffles."""
    schema = "".join(f"`{k}` {t}, " for k, t in docs.select(*rest).dtypes) + "doc long, tk long, packed binary"

    def make():
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            return {f: batch.column(i) for i, f in enumerate(batch.schema.names[:-1])} | {"tk": [text_key(t) for t in texts], "packed": [squeeze(t) for t in texts]}

        return step

    return over_batches(docs.select(*rest, "doc", "_text"), make, schema)


def _cut(text: bytes, marks: dict[str, np.ndarray], length: int) -> tuple[bytes, int]:
    """What is left of the text, and the number of maximal removed runs. Kinds: 0 a run's occurrence, 1 the first of its variant, 2 repeats within a first."""
    kind, lo = marks["kind"], marks["lo"]
    whole = (kind == 0) & ~np.isin(lo, lo[kind == 1])
    part = kind == 2
    a = np.concatenate([lo[whole], lo[part] + marks["a"][part]])
    z = np.concatenate([lo[whole] + marks["n"][whole], lo[part] + marks["z"][part]]) + length - 1
    if not len(a):
        return text, 0
    flags = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(flags, a, 1)
    np.add.at(flags, np.minimum(z, len(text)), -1)
    covered = np.cumsum(flags[:-1]) > 0
    return np.frombuffer(text, dtype=np.uint8)[~covered].tobytes(), len(_ranges(covered))


def deduplicate(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """The other columns and n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also ``kept``, the bytes left as text (characters cut in two are dropped).

    A null text is empty. Repeated rows with one doc_id each give a row, and do not remove each other's bytes.
    Older columns of those names, and of the working columns doc, packed, marks, are dropped.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "doc", "_text", "packed", "marks")
    rest = [k for k in docs.columns if k != text and k not in made]
    rows = docs.select(*rest, F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("_text"))
    slim = rows.select("doc", "_text")
    every = saved(_anchors(slim), folder, "anchors")
    repeated = saved(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), folder, "repeated")
    hits = saved(every.join(repeated, "h"), folder, "runs")
    for name in ("anchors", "repeated"):
        drop_folder(docs.sparkSession, f"{folder}/{name}")
    firsts = saved(hits.groupBy("h", "c").agg(F.min(F.struct("doc", "lo", "tk")).alias("f"), F.max("n").alias("n")).select("h", "c", "f.doc", "f.tk", "f.lo", "n"), folder, "variants")
    several = saved(firsts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), folder, "several")
    wanted = firsts.join(several, "h").groupBy("doc", "tk").agg(F.collect_list(F.struct("h", "lo", "n")).alias("want"))

    def make_snippets():
        expand = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            want = batch.column(3)
            at, each = want.offsets.to_numpy(), want.flatten()
            first = at[0]
            h, lo, n = (each.field(k) for k in range(3))
            los, ns, snippets = lo.to_numpy().tolist(), n.to_numpy().tolist(), []
            for k, packed in enumerate(batch.column(2).to_pylist()):
                body = expand(packed)
                snippets += [body[los[i] : los[i] + ns[i] + LENGTH - 1] for i in range(at[k] - first, at[k + 1] - first)]
            times = np.diff(at)
            left, right, lefts = halves(h.to_numpy(), n.to_numpy(), snippets)
            return {"left": left, "right": right, "lefts": lefts, "doc": np.repeat(batch.column(0).to_numpy(), times), "tk": np.repeat(batch.column(1).to_numpy(), times),
                    "lo": lo, "n": n, "snippet": snippets}

        return step

    bodies = _packed(rows, [])
    # repeated rows of a document give the same snippets
    joined = bodies.join(wanted, ["doc", "tk"]).select("doc", "tk", "packed", "want").dropDuplicates(["doc", "tk"])
    snippets = saved(over_batches(joined, make_snippets, "left long, right long, lefts int, doc long, tk long, lo int, n int, snippet binary"), folder, "snippets")
    lefts, more = F.col("lefts"), LENGTH - 1
    both = (snippets.where("lefts > 0").select(F.col("left").alias("h"), "doc", "tk", "lo", lefts.alias("n"), F.expr(f"substring(snippet, 1, lefts + {more})").alias("snippet"))
            .union(snippets.where("lefts < n").select("right", "doc", "tk", F.col("lo") + lefts, F.col("n") - lefts, F.expr("substring(snippet, lefts + 1)"))))
    counts = saved(both.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), folder, "counts")
    few = both.join(counts.where(F.col("k") <= TILE).select("h"), "h").repartition("h").sortWithinPartitions("h")
    parts = saved(few.select("h", "doc", "tk", "lo", "n", "snippet").mapInArrow(_compare, "doc long, tk long, lo int, a int, z int"), folder, "repeats")
    many = counts.where(F.col("k") > TILE).select("h")
    if not many.isEmpty():
        parts = parts.union(saved(_first_of_many(both.join(F.broadcast(many), "h"), folder), folder, "later"))  # a row of many for over TILE halves
    for name in ("several", "snippets", "counts"):
        drop_folder(docs.sparkSession, f"{folder}/{name}")
    none = F.lit(None).cast("int")
    marks = (hits.select("doc", "tk", F.lit(0).alias("kind"), "lo", "n", none.alias("a"), none.alias("z"))
             .union(firsts.select("doc", "tk", F.lit(1), "lo", "n", none, none))
             .union(parts.select("doc", "tk", F.lit(2), "lo", none, "a", "z")))
    per_doc = marks.groupBy("doc", "tk").agg(F.collect_list(F.struct(*[F.coalesce(k, F.lit(0)).alias(k) for k in ("kind", "lo", "n", "a", "z")])).alias("marks"))
    joined = _packed(rows, rest).join(per_doc, ["doc", "tk"], "left").select(*rest, "packed", F.coalesce("marks", F.array().cast(per_doc.schema["marks"].dataType)).alias("marks"))
    schema = "".join(f"`{k}` {t}, " for k, t in docs.select(*rest).dtypes) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text

    def make_cut():
        expand = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f: batch.column(i) for i, f in enumerate(rest)} | {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            lists = batch.column(batch.num_columns - 1)
            at, each = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            fields = {each.type.field(k).name: each.field(k).to_numpy(zero_copy_only=False) for k in range(each.type.num_fields)}
            for i, packed in enumerate(batch.column(batch.num_columns - 2)):
                body = expand(packed.as_py())
                kept, spans = _cut(body, {k: v[at[i] : at[i + 1]] for k, v in fields.items()}, LENGTH)
                for k, v in (("n_bytes", len(body)), ("n_removed", len(body) - len(kept)), ("n_spans", spans), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode("utf-8", "ignore") if keep_text else "")):
                    if k != "kept" or keep_text:
                        out[k].append(v)
            return out

        return step

    return over_batches(joined, make_cut, schema)
