"""Substring joins and pruned scores against brute force."""

from __future__ import annotations

import random

import pytest

from storelens.operators import baseline as B, catalog as G, search as S
from storelens.operators.containment import contained

CARD = "id string, title string, description string, categories array<string>, tags array<string>, specifications map<string,string>, hidden boolean, stock_status string, price double, status string"
WORDS = ["red", "redder", "ring", "string", "blue", "a", "ab", "סוללה", "לסוללה", "x1", "promo"]


def cards(spark, n, seed=1):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randint(0, k)))
    rows = [(f"{i:04d}", some(3), some(4), [r.choice(WORDS)], r.sample(WORDS, 2), {"size": some(1)}, i % 11 == 0,
             "outofstock" if i % 3 == 0 else "instock", 1.0, "active") for i in range(n)]
    return rows, spark.createDataFrame(rows, CARD)


def shown(spark, rows):
    keep = {r["id"] for r in spark.createDataFrame(rows, CARD).filter(S.sellable()).collect()}
    return [r for r in rows if r[0] in keep]


def test_contained_equals_brute_force(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 6)))) for i in range(80)] + [(80, None), (81, "red\tring")]
    asked = ["r", "re", "red", "ring", "tri", "red ring", "d r", "ללה", "לה לס", "zz", "promo", "", " ", None, "red"]
    got = contained(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(texts, "product_id long, text string"))
    want = sorted((a, i) for a in {a for a in asked if a and a.strip()} for i, t in texts if t and a in t)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("n", [1, 5, 40])
def test_closest_score_prunes_blocks_without_loss(spark, n):
    rows, products = cards(spark, 240)
    asked = ["red", "ring red ring", "סוללה promo", "a", "nothing here", "", "  ", "x1 blue string"]
    posts = S.score_postings(products, block_products=20)
    assert posts.select("block").distinct().count() > 5
    got = S.closest_score(None, spark.createDataFrame([(q,) for q in asked + ["red"]], "query string"), n, postings=posts).collect()
    for q in asked:
        scores = []
        for r in shown(spark, rows):
            title, rest = r[1], " ".join([r[2], *r[3], *r[5].values()])
            scores.append((-sum(4 * (t in title) + (t in rest) for t in q.split()), r[0]))
        want = [(i + 1, p, -s) for i, (s, p) in enumerate(sorted(scores)[:n])]
        assert sorted((g["rank"], g["product_id"], g["score"]) for g in got if g["query"] == q) == want
    assert S.closest_score(products.limit(0), spark.createDataFrame([("red",)], "query string"), n).count() == 0


def test_lexical_score_takes_a_table_of_requests(spark):
    rows, products = cards(spark, 90)
    asked = [("one", ["red", "red", "x1"], ["blue"], ["ring", "red ring", "ring"]), ("two", None, [], ["סוללה", ""]), ("none", [], None, None)]
    requests = spark.createDataFrame(asked, "query string, tags array<string>, categories array<string>, terms array<string>")
    want = []
    for q, tags, cats, terms in asked:
        for r in shown(spark, rows):
            text = " ".join(" ".join([r[1], r[2], *r[5].values()]).split())
            score = 4 * len(set(tags or []) & set(r[4])) + 4 * len(set(cats or []) & set(r[3])) + 3 * sum(bool(t) and t in text for t in terms or [])
            if score:
                want.append((q, r[0], score))
    assert sorted(map(tuple, S.lexical_score(products, requests).collect())) == sorted(want)
    top = S.lexical_score(products, requests, n=4).filter("query = 'one'").orderBy("rank").collect()
    assert [(t["product_id"], t["score"]) for t in top] == [(p, -s) for s, p in sorted((-s, p) for q, p, s in want if q == "one")[:4]]


def test_out_of_stock_hits_of_a_query_table(spark):
    rows, products = cards(spark, 120)
    asked = ["red ring", "סוללה", "a", "ab blue", "", "zzz red"]
    got = G.out_of_stock_hits(products, spark.createDataFrame([(q,) for q in asked], "query string"), n=3).collect()
    want = []
    for q in asked:
        terms = [t for t in q.split() if len(t) >= 2]
        hits = [r[0] for r in rows if not r[6] and r[7] == "outofstock" and terms and all(t in " ".join([r[1], r[2], *r[3], *r[4], *r[5].values()]) for t in terms)]
        want += [(q, i, k + 1) for k, i in enumerate(sorted(hits)[:3])]
    assert sorted((g["query"], g["id"], g["rank"]) for g in got) == sorted(want)


def test_item_numbers_are_catalog_keys(spark):
    products = spark.createDataFrame([("1", "lamp", "A7 ", None), ("2", "desk", None, "m-3")], "id string, name string, ItemID string, Makat string").selectExpr(
        "*", "null as url", "false as hidden", "'instock' as stock_status")
    refs = spark.createDataFrame([("a7", None, None), ("M-3", None, None), ("zz", None, None)], "pid string, name string, url string")
    got = {r["pid"]: r["product"] and r["product"]["id"] for r in B.match_catalog(refs, products).collect()}
    assert got == {"a7": "1", "M-3": "2", "zz": None}


def test_related_queries_equal_brute_force(spark):
    r = random.Random(5)
    rows = sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(60)})
    counts = {q: r.randint(1, 9) for q in rows}
    asked = rows[::4] + ["re", "unseen ring"]
    got = B.related_queries(spark.createDataFrame(list(counts.items()), "query string, searches long"), spark.createDataFrame([(q,) for q in asked], "query string"), 3).collect()
    want = [(a, q, k + 1) for a in asked for k, q in enumerate(sorted((q for q in rows if q != a and (a in q or q in a)), key=lambda q: (-counts[q], q))[:3])]
    assert sorted((g["asked"], g["query"], g["rank"]) for g in got) == sorted(want)


def test_only_asked_keys_are_sorted_by_key(spark):
    from pyspark.sql import functions as F

    products = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), F.lit(False).alias("hidden"), F.lit("instock").alias("stock_status"))
    refs = spark.createDataFrame([("7", "", "", 1), (None, "X", None, 2)], "pid string, name string, url string, n int")
    got = B.match_catalog(refs, products)
    assert {r["n"]: r["product"]["id"] for r in got.collect()} == {1: "7", 2: "99"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    keys = plan[plan.index("max_by"):]
    assert "Join LeftSemi" in keys and "RepartitionByExpression" in keys and keys.index("Join LeftSemi") < keys.index("Generate explode")
