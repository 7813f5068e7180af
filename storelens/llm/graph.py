"""Pairs within meeting places of any size, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import saved


def tiled(rows: DataFrame, key: str, by: str, size: int, folder: str, name: str) -> DataFrame:
    """Rows that share their ``key`` with others, dealt so that every two of them meet in one tile of about ``2 * size`` rows at most.

    A key with n rows has p = ceil(n / size) parts (by a hash of ``by``); part i goes to the tiles
    (i, j) of all j, so a hot key is spread over p * (p + 1) / 2 tiles. Adds ``_a``, ``_b`` (the
    tile) and ``_part``. Rows alone with their key are dropped. The result is partitioned and
    sorted by key and tile.
    """
    rows = saved(rows, folder, name)
    counts = saved(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), folder, f"{name}-counts")
    parts = F.ceil(F.col("_n") / size).cast("int")
    met = rows.join(counts, key).withColumn("_p", parts).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_p")).cast("int"))
    met = met.withColumn("_q", F.explode(F.when(F.col("_p") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_p") - 1))))
    met = met.withColumn("_a", F.least("_part", "_q")).withColumn("_b", F.greatest("_part", "_q")).drop("_n", "_p", "_q")
    return met.repartition(key, "_a", "_b").sortWithinPartitions(key, "_a", "_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows of a stream sorted by ``keys`` that hold whole groups only, with the start of each group and the end."""
    held: list[pa.Table] = []
    count = 0

    def borders(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):  # a batch may hold many times as many
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            t = pa.concat_tables(held)
            at = borders(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at
            held, count = [t.slice(at[-1])], t.num_rows - at[-1]
    if count:
        t = pa.concat_tables(held)
        yield t, np.append(borders(t), t.num_rows)


def pairs_in(starts: np.ndarray, part: np.ndarray, cross: np.ndarray, most: int = 1 << 16, up_to: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within each group (rows starts[k] up to starts[k + 1]), about ``most`` at a time; in cross tiles those of different parts only.

    Groups of over ``up_to`` rows are left to the caller.
    """
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    last = starts[1:][group]
    i = np.flatnonzero(sizes[group] <= up_to)
    sizes = sizes[sizes <= up_to]
    wait_a: list[np.ndarray] = []
    wait_b: list[np.ndarray] = []
    waiting = 0
    for k in range(1, int(sizes.max(initial=1))):
        i = i[i + k < last[i]]
        keep = ~cross[i] | (part[i] != part[i + k])
        for z in range(0, len(i), most):
            a = i[z : z + most][keep[z : z + most]]
            wait_a.append(a)
            wait_b.append(a + k)
            waiting += len(a)
            if waiting >= most:
                yield np.concatenate(wait_a), np.concatenate(wait_b)
                wait_a, wait_b, waiting = [], [], 0
    if waiting:
        yield np.concatenate(wait_a), np.concatenate(wait_b)


class Forest:
    """Union-find over the rows of a table; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.a: list[int] = []
        self.b: list[int] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.find(x), self.find(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.a.append(x)
                self.b.append(y)


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node that has one.

    Labels spread to neighbours and then jump to their label's label, so long chains take a number
    of rounds like the logarithm of their length. Every round is a written table; no link or label
    reaches the driver, only whether anything changed. Aggregates are combined before they are
    shuffled, and the joins on labels can be split at a hot one.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), folder, f"{name}-edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), folder, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        spread = saved(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), folder, f"{name}-{turn}-spread")
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = saved(spread.join(up, "root").select("node", F.least("root", "higher").alias("root"), (F.least("root", "higher") != F.col("was")).alias("moved")), folder, f"{name}-{turn}")
        if not new.where("moved").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
