"""Exact top-k search against brute force."""

import math
import random

import __spark_entry__ as entry
from compare import compare, connect
from storelens.llm import impact_index as I
from storelens.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def brute(rows, queries, k):
    rows = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, q in rows:
        if queries(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out |= {(i, q, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return sorted((i, r, j, s) for i, _, r, j, s in out)


def found(spark, folder, rows, queries, k, shard=I.SHARD, block=I.BLOCK):
    f = folder()
    ints = saved(I.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), f, "integers")
    wanted = ints.where(ints.key.isin([i for i, _ in rows if i is not None and queries(i)]))
    return sorted(tuple(r) for r in I.search(I.build_index(ints, f, shard), wanted, k, block).collect())


def test_query_matches_sql(spark):
    ok, note = compare(entry.queries()["op11_impact_index"](spark, SF), connect(SF), entry.oracle_sql()["op11_impact_index"])
    assert ok, note


def test_shards_blocks_and_kinds_of_vectors(spark, folder):
    r = random.Random(8)
    kinds = (lambda: [r.gauss(0, 0.1) for _ in range(16)], lambda: [r.choice([0.0, 0.0, 1.0]) for _ in range(16)], lambda: [-abs(r.gauss(0, 1)) for _ in range(16)],
             lambda: [5.0] * 16, lambda: [r.gauss(0, 1e6) for _ in range(16)], lambda: [r.random() for _ in range(3)])
    rows = [(i, r.choice(kinds)()) for i in range(600)]
    rows += [(700 + i, [0.25 * (i % 2)] * 16) for i in range(80)]
    for shard, block, k in ((64, 8, 5), (4096, 4096, 7)):
        assert found(spark, folder, rows, lambda i: i % 9 == 0, k, shard, block) == brute(rows, lambda i: i % 9 == 0, k)


def test_odd_rows(spark, folder):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]),
            (6, [-3.0, -3.0]), (7, [1.0]), (8, []), (9, []), (10, [0.0, 0.0]), (10, [0.5, 0.5])]
    every = lambda i: True
    got = found(spark, folder, rows, every, 5)
    assert got == brute(rows, every, 5)
    assert [x for x in got if x[0] == 0] == [(0, 1, 5, 196608), (0, 2, 10, 98304), (0, 3, 10, 0), (0, 4, 6, -589824)] and (8, 1, 9, 0) in got
    top = (1 << 63) - 1
    huge = [(0, [2.0**50, 1.0]), (50, [2.0**50, 2.0]), (100, [-(2.0**53), 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**23, 3.0]), (3, [2.0**22 + 1, 5.0]), (4, [2.0**60, 1.0])]
    got = found(spark, folder, huge, lambda i: i == 1, 7)
    assert [x[2:] for x in got] == [(0, top), (50, top), (2, (1 << 61) + 768 * 768), (3, (1 << 30) * ((1 << 30) + 256) + 768 * 1280), (100, -top)]
    assert found(spark, folder, [], every, 5) == []


def test_ties_and_repeated_vectors(spark, folder):
    rows = [(i, [0.1, 0.2, 0.3]) for i in range(300)]
    got = found(spark, folder, rows, lambda i: i in (0, 3), 5, 64)
    assert [x[2] for x in got] == [1, 2, 3, 4, 5, 0, 1, 2, 4, 5]


def test_extra_columns(spark, folder):
    docs = table(spark, SF, "embeddings").selectExpr("*", "1 as key", "'a' as raw", "2 as dim", "3 as shard")
    assert I.integers(docs).columns == ["key", "dim", "raw"] and I.integers(docs).count() == 500
