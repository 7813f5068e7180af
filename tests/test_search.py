"""Term resolution, retrieval, ranking and spelling against brute force and small cases."""

import random

from pyspark.sql import functions as F

from storelens.functions import text as T
from storelens.operators import ranking as K, search as S
from storelens.session import cut


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(nxt[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def test_close_terms_equal_all_pairs(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 11))) for _ in range(250)})
    asked = [w for w in words if len(w) >= 4]
    df = spark.createDataFrame([(w,) for w in asked], "term string")
    vocab = spark.createDataFrame([(w,) for w in words], "term string")
    limit = F.when(F.length("term") >= 8, 2).otherwise(1)
    got = {(r["term"], r["target"], r["edits"]) for r in S.close_terms(df, vocab, limit).collect()}
    want = {(a, b, lev(a, b)) for a in asked for b in words if a != b and lev(a, b) <= (2 if len(a) >= 8 else 1)}
    assert got == want


def products(spark, titles):
    rows = [(str(i), t, "", [], [], 10.0, False, "instock") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "id string, title string, description string, categories array<string>, tags array<string>, price double, hidden boolean, stock_status string")


def search(spark, titles, queries, profile=None):
    p = products(spark, titles)
    cards, post, ids = S.search_cards(p).cache(), S.build_postings(p).cache(), S.build_identifiers(p)
    plans = S.plan_queries(spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "query_id string, query string"), profile or {}).cache()
    res = S.retrieve(plans, post, cards, ids).cache()
    out = {q: [] for q in queries}
    for r in sorted(res.collect(), key=lambda r: r["rank"]):
        out[queries[int(r["query_id"])]].append(r["product_id"])
    return out, (plans, res, post, cards)


def test_fuzzy_and_inflection(spark):
    titles = ["בננה", "בננות טריות", "Chronicles of Narnia", "abc123 model"]
    got, _ = search(spark, titles, ["בננות", "chronicels", "narnja", "abc124", "1"])
    assert got["בננות"] == ["1", "0"]          # the word itself, then its other number
    assert got["chronicels"] == ["2"] and got["narnja"] == ["2"]
    assert got["abc124"] == [] and got["1"] == ["1"]  # digits are never approximated; an id wins


def test_relax_one_term(spark):
    titles = ["shalev ben novel", "shalom ben", "shalem cohen"]
    got, (plans, res, post, cards) = search(spark, titles, ["shalem novel"])
    assert got["shalem novel"] == []
    again = S.relax_one_term(plans, res, post, cards).collect()
    assert [(r["product_id"], r["relaxed_term"]) for r in again] == [("0", 0)]


def test_plan_consumes_in_order(spark):
    profile = {"product_types": {"mug": ["mug"], "glass mug": ["glass mug"]}, "colors": ["red"], "tags": {"gift": ["present"]}, "query_aliases": {"rad": "red"}}
    q = spark.createDataFrame([("1", "rad Glass Mug present עד 50 ש nice")], "query_id string, query string")
    r = S.plan_queries(q, profile).first()
    assert (r["product_type"], r["colors"], r["tags"], r["max_price"]) == ("glass mug", ["red"], ["gift"], 50.0) and "nice" in r["terms"]


def test_ranking_rules_lift_fresh_produce(spark):
    titles = ["Tomato sauce", "Tomatoes cherry", "Tomato soup"]
    p = products(spark, titles).withColumn("categories", F.when(F.col("id") == "1", F.array(F.lit("Fresh"))).otherwise(F.array(F.lit("Cans"))))
    rules = [{"id": "r", "action": "boost", "field": "categories", "values": ["fresh"], "match": "direct"}]
    res = lambda q: spark.createDataFrame([("1", q, str(i), i + 1) for i in range(3)], "query_id string, query string, product_id string, rank int")
    order = lambda q: [r["product_id"] for r in K.apply_ranking_rules(res(q), p, rules).orderBy("new_rank").collect()]
    assert order("tomatoes") == ["1", "0", "2"]
    assert order("tomato sauce")[0] == "0"


def test_spelling_repair_rejects_ambiguity(spark):
    p = products(spark, ["Kindle paperwhite", "Kinder paper", "banana split"])
    q = spark.createDataFrame([("1", ["kindel"]), ("2", ["bannana"])], "query_id string, terms array<string>")
    got = {(r["query_id"], r["compact"], r["product_id"]) for r in S.repair_spelling(q, p).collect()}
    assert ("2", "banana", "2") in got


def test_vectors_in_one_and_many_passes(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    v = spark.createDataFrame([(i, vec()) for i in range(60)] + [(60, None)], "product_id long, vector array<double>").repartition(5)
    q = v.filter("product_id < 9").withColumnRenamed("product_id", "query_id")
    a = S.vector_rank(q, v, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    assert S.vector_rank(q, v, 4).orderBy("query_id", "rank").collect() == a
    assert all(r["product_id"] == r["query_id"] for r in a if r["rank"] == 1)


def test_text_forms(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(T.search_normalize(F.lit(" CAFÉ-au „lait”™ ﬁn "))) == "cafe au laittm fin"
    assert one(T.keyboard_layout(F.lit("שמלה"))) == "ankv"
    assert one(T.swap_typo(F.lit("red widget"))) == "red wigdet"
    assert one(T.article_prefixed(F.lit("שמלה"))) == "השמלה" and one(T.article_prefixed(F.lit("הבית"))) is None
    assert set(one(T.inflections(F.lit("תפוחים")))) == {"תפוח"} and one(T.inflections(F.lit("apple"))) == []
    assert one(T.query_key(F.lit("  A  b "))) == "a b"


def test_vector_rank_in_many_blocks(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(1)
    vec = lambda: None if rng.random() < 0.05 else [float(rng.randrange(-2, 3)) for _ in range(4)]
    q, v = [(f"q{i}", vec()) for i in range(150)], [(i, vec()) for i in range(400)]
    qs, vs = spark.createDataFrame(q + q[:20], "query_id string, vector array<double>"), spark.createDataFrame(v, "product_id int, vector array<float>")
    unit = lambda x: np.zeros(4) if x is None or not any(x) else np.array(x) / np.linalg.norm(x)
    want = {}
    for name, x in q:
        scored = sorted((-round(float(unit(x) @ unit(y)), 9), i) for i, y in v)[:6]
        want[name] = [(i, -s) for s, i in scored]
    for sizes in ((1024, 1024), (16, 32)):
        monkeypatch.setattr(S, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(S, "VECTOR_BLOCK", sizes[1])
        got = {}
        for r in S.vector_rank(qs, vs, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["product_id"], r["score"]))
        assert got.keys() == want.keys() and all([i for i, _ in got[n]] == [i for i, _ in want[n]] for n in want)
        assert all(abs(a[1] - b[1]) < 1e-8 for n in want for a, b in zip(got[n], want[n]))
    assert S.vector_rank(qs.limit(0), vs, 3).count() == 0 and S.vector_rank(qs, vs.limit(0), 3).count() == 0
    once = spark.range(5000).selectExpr("'q' as query_id", "array(cast(id as double), 1D) as vector")  # more rows of one query than a block holds
    assert S.vector_rank(once, spark.createDataFrame([(1, [1.0, 0.0])], "product_id int, vector array<double>"), 2).count() == 2


def test_linked_phrases_identifiers_and_filters(spark):
    """Hebrew fixture: phrases drive and narrow, identifiers are not relaxed or explained, repairs keep filters, variants are named."""
    rows = [("1", "יומן שבועי", "", "A1", 10.0), ("2", "יומן אישי", "", "B2", 10.0), ("3", "פלנר שולחני", "כולל יומן מתנה", "C3", 10.0), ("4", "עט יוקרתית", "", "D4", 90.0), ("5", "עט יוקרתיח", "", "E5", 5.0)]
    p = spark.createDataFrame(rows, "id string, title string, description string, sku string, price double").selectExpr(
        "*", "array() as categories", "cast(array() as array<string>) as tags", "false as hidden", "if(id = '2', 'outofstock', 'instock') as stock_status",
        "array(named_struct('id', 'v' || id, 'sku', sku || '-x', 'stock_status', 'instock'), named_struct('id', 'w' || id, 'sku', 'B2', 'stock_status', 'instock')) as variants")
    cards, post, ids = S.search_cards(p).cache(), S.build_postings(p).cache(), S.build_identifiers(p)
    rules = [{"id": "d", "term": "יומן", "mode": "only", "product_ids": ["1", "3"]}, {"id": "g", "term": "יומן מתנה", "mode": "add", "product_ids": ["4"]}]
    asked = {"only": "יומן", "narrow": "יומן שולחני", "open": "יומן מתנה", "id": "d4", "gone": "b2", "typo": "עט יוקרתיך עד 50", "none": "יומן בלבלב"}
    q = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    plans = S.plan_queries(q, {"scoped": rules}).cache()
    found = S.retrieve(plans, post, cards, ids, rules=rules).cache()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["product_id"])
    assert got["only"] == ["1", "3"] and got["narrow"] == ["3"] and sorted(got["open"]) == ["3", "4"] and got["id"] == ["4"] and "none" not in got
    assert S.retrieve(plans, post, cards, ids).filter("query_id = 'only'").count() == 4  # without rules nothing but stock narrows a query of no terms
    sold_out = S.build_identifiers(p.filter("id = '2'"))
    res = S.resolve_terms(S.term_rows(plans), S.vocabulary(post))
    why = {r["query_id"]: r["why"] for r in S.explain_empty(plans, found.filter("query_id <> 'gone'"), post, res, sold_out).collect()}
    assert "gone" not in why and why["none"] == "missing-terms"
    fixed = {r["product_id"] for r in S.repair_spelling(plans.filter("query_id = 'typo'"), p).collect()}
    assert fixed == {"4", "5"} and {r["product_id"] for r in S.repair_spelling(plans.filter("query_id = 'typo'"), p, cards=cards).collect()} == {"5"}
    named = {(r["query_id"], r["product_id"]): r["variant"]["id"] for r in S.matched_variants(plans, p).collect()}
    assert named == {("gone", str(i)): f"w{i}" for i in range(1, 6)}


def broadcast_columns(df):
    """The columns of every side that a join of the plan broadcasts."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if "Broadcast" in node.nodeName() and "Join" in node.nodeName():
            side = node.right() if "Right" in node.buildSide().toString() else node.left()
            out.append(side.output().toString())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_catalog_tables_are_not_broadcast(spark, tmp_path):
    products(spark, ["red ring", "red bolt", "cog ring"]).withColumn("specifications", F.create_map(F.lit("size"), F.lit("4"))).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    rules = [{"id": "s", "term": "cog", "mode": "add", "product_ids": ["0"]}]
    asked = spark.createDataFrame([("a", "red ring"), ("b", "cog"), ("c", "1")], "query_id string, query string")
    plans = cut(S.plan_queries(asked, {"scoped": rules}))
    found = S.retrieve(plans, S.build_postings(p), S.search_cards(p), S.build_identifiers(p), 5, rules)
    requests = spark.createDataFrame([("q", ["x"], ["y"], ["red", "red ring"])], "query string, tags array<string>, categories array<string>, terms array<string>")
    prefixes = spark.createDataFrame([("re",)], "prefix string")
    results = found.join(asked, "query_id")
    assert {(r["query_id"], r["product_id"]) for r in found.collect()} == {("a", "0"), ("b", "0"), ("b", "2"), ("c", "1")}
    for df in (found, S.lexical_score(p, requests), S.autocomplete(prefixes, p), K.apply_ranking_rules(results, p, [{"id": "r", "field": "title", "values": ["cog"]}])):
        assert not [x for x in broadcast_columns(df) if "product_id" in x]
