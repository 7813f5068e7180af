"""Catalog keys, feeds, robots, facts, sources and sinks on small fixtures."""

from pyspark.sql import functions as F

from storelens.operators import baseline as B, changes as H, evidence as V, pages as G, ranks as R
from storelens.sources import readers as RD, sinks as SK

CARD = "id string, name string, url string, sku string, slug string, stock_status string, hidden boolean"


def test_catalog_keys(spark):
    products = spark.createDataFrame([("7", "Red Wine", "https://s/p/red-wine", "RW", "red", "instock", False), ("8", "Gin", "https://s/p/gin", None, None, "outofstock", False)], CARD)
    refs = spark.createDataFrame([("woo_product_7", "", ""), ("gid://shop/Product/7", "", ""), ("red", "", ""), ("---", " red  WINE", ""), ("", "", "https://s/x/red-wine/?a=1"),
                                  ("999", "", ""), ("8", "", "")], "pid string, name string, url string")
    got = {(r["pid"], r["name"], r["url"]): r["product"] and (r["product"]["id"], r["product"]["available"]) for r in B.match_catalog(refs, products).collect()}
    assert [got[k] for k in (("woo_product_7", "", ""), ("gid://shop/Product/7", "", ""), ("red", "", ""), ("---", " red  WINE", ""), ("", "", "https://s/x/red-wine/?a=1"))] == [("7", True)] * 5
    assert got[("999", "", "")] is None and got[("8", "", "")] == ("8", False)


def test_unmatched_products_are_unknown_below_ninety_percent(spark):
    products = spark.createDataFrame([("1", "A", "u", None, None, "instock", False)], CARD)
    tallies = spark.createDataFrame([("q", "x", "x", "", "", 0, 5, 0), ("q", "1", "1", "", "", 0, 1, 0)],
                                    "query string, key string, pid string, name string, url string, clicks long, carts long, purchases long")
    assert {r["key"]: r["gone"] for r in B.baseline_targets(tallies, products).collect()} == {"x": False, "1": False}


def cards(spark, n):
    return spark.createDataFrame([(str(i), f"t{i}", 10.0, "instock", False, False) for i in range(n)],
                                 "id string, title string, price double, stock_status string, hidden boolean, feed_hidden boolean")


def feed(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, price double, stock_status string, published boolean")


def test_feed_outcomes_and_restore(spark):
    rows = [(str(i), f"t{i}", 10.0, "instock", True) for i in range(28)]
    rows[0] = ("0", "t0", 8.0, "instock", True)
    rows[1] = ("1", "t1", 10.0, "outofstock", True)
    rows[2] = ("2", "t2", 10.0, "instock", False)
    rows += [("99", "new", 1.0, "instock", True)]
    out = H.apply_feed(cards(spark, 29), feed(spark, rows))
    assert {r["outcome"]: r["n"] for r in H.outcome_counts(out).collect()} == {"updated": 2, "added": 1, "removed": 2, "unchanged": 25}
    again = H.apply_feed(out.drop("outcome"), feed(spark, rows[:2] + [("2", "t2", 10.0, "instock", True)] + rows[3:]))
    assert [r["id"] for r in again.filter("outcome = 'restored'").collect()] == ["2"]


def test_small_feed_is_refused(spark):
    import pytest
    few = feed(spark, [(str(i), "", 1.0, "instock", True) for i in range(5)])
    assert H.feed_guard(cards(spark, 30), few).first()["refused"]
    with pytest.raises(Exception, match="lost most"):
        H.apply_feed(cards(spark, 30), few).collect()


def test_robots(spark):
    body = "User-agent: a\nDisallow: /\n\nUser-agent: *\nDisallow: /private # x\nAllow: /private/open\nDisallow: /*.pdf$\n"
    robots = spark.createDataFrame([("s.com", body)], "host string, body string")
    urls = ["https://s.com/", "https://s.com/private/x", "https://s.com/private/open/1", "https://s.com/a.pdf", "https://s.com/a.pdf?x=1", "https://other.com/private"]
    got = {r["url"]: r["allowed"] for r in G.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), robots).collect()}
    assert [got[u] for u in urls] == [True, False, True, False, True, True]


def test_facts(spark):
    p = spark.createDataFrame([("1", "Mug", "A mug made of clay. Holds 300 ml, or 400 ml.", {"Color": "red"})], "id string, name string, description string, specifications map<string,string>")
    rows = [("1", "Material", "clay", "made of clay"), ("1", "Origin", "Rome", "made in Rome"), ("1", "Volume", "300 ml", "Holds 300 ml"), ("1", "volume", "400 ml", "or 400 ml"),
            ("1", "color", "clay", "made of clay"), ("1", "price", "300", "Holds 300 ml")]
    got = {(r["field"], r["value"]): r["status"] for r in V.validate_facts(spark.createDataFrame(rows, "id string, field string, value string, quote string"), p).collect()}
    assert got == {("Material", "clay"): "verified", ("Volume", "300 ml"): "conflict", ("volume", "400 ml"): "conflict", ("Color", "clay"): "conflict"}


def test_quoted_only_uses_every_source(spark):
    st = spark.createDataFrame([(1, "s", "blue", "a blue pot"), (2, "s", "x", "x"), (3, "s", "red", "a red pot")], "row_id int, source string, value string, quote string")
    src = spark.createDataFrame([("s", "u2", "has a blue pot here"), ("s", "u1", "xa blue pots"), ("t", "u0", "a red pot")], "source string, url string, text string")
    assert {r["row_id"]: r["url"] for r in V.quoted_only(st, src).collect()} == {1: "u1", 2: "u1"}


def test_csv_feed(spark, tmp_path):
    f = tmp_path / "feed.csv"
    f.write_text('﻿id,title,note\n1,"a ""quoted"", name","two\nlines"\n,,\n2,short\n', encoding="utf-8")
    rows = {r["id"]: r for r in RD.read_feed_csv(spark, str(f)).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["title"] == 'a "quoted", name' and rows["1"]["note"] == "two\nlines" and rows["2"]["note"] == ""
    g = tmp_path / "feed.tsv"
    g.write_text("id\ttitle\n1\ta,b\n")
    assert RD.read_feed_csv(spark, str(g)).first()["title"] == "a,b"


def test_json_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","title":"x"}]')
    (tmp_path / "b.json").write_text('{"products":[{"id":"2","title":"y"}],"nextUrl":null}')
    assert {r["id"] for r in RD.read_feed_json(spark, str(tmp_path), "id string, title string").collect()} == {"1", "2"}


def test_platform_pages(spark):
    body = '{"products":[{"id":"1","title":"A","handle":"a","product_type":"x","tags":["t"],"variants":[{"id":"1","price":"5","available":false},{"id":"2","price":"9","available":true},{"id":"3","price":"7","available":true}]}]}'
    r = RD.platform_rows(spark.createDataFrame([(body,)], "body string"), "shopify", "https://s").first()
    assert (r["price"], r["price_min"], r["price_max"], r["stock_status"], r["url"], r["reject"]) == (7.0, 7.0, 9.0, "instock", "https://s/products/a", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "host string, score int")
    SK.write_leads_csv(df, str(tmp_path / "leads"))
    text = next((tmp_path / "leads").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿host,score")
    for period in ("p1", "p2", "p1"):
        SK.write_report(df, str(tmp_path / "r"), "r1", period)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_systematic_sample_is_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "n").repartition(7)
    got = sorted(r["n"] for r in R.systematic_sample(df, 10, [F.col("n")], F.floor(F.col("n") / 64)).collect())
    assert got == [i * 100 for i in range(10)]


def test_page_parse(spark):
    html = ("<html><head><title>T</title><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"Product\",\"name\":\"X\"}]}</script></head><body><nav><a href='/c/x'>Dresses</a></nav>"
            "<script>var a='<p>no</p>'</script><p>Hello &amp; bye</p><table><tr><th>Size</th><td>L</td></tr></table><a href='/products/a?x=1#f'>A</a><a href='/cart'>C</a><a href='/c/y?page=2&s=1'>n</a></body></html>")
    p = G.parse_pages(spark.createDataFrame([(1, "https://s.com/home", html)], "page_id int, url string, html string")).cache()
    assert "Hello & bye" in p.first()["text"] and "var a" not in p.first()["text"]
    assert {r["link"] for r in G.page_links(p).collect()} == {"https://s.com/c/x", "https://s.com/products/a", "https://s.com/c/y?page=2"}
    assert G.product_evidence(p).first()["evidence"] == "jsonld" and G.spec_tables(p).first()["value"] == "L"
    assert [r["term"] for r in G.nav_terms(p).collect()] == ["Dresses"]


def test_text_cuts_can_be_lifted(spark):
    from storelens.operators import catalog as C

    row = spark.createDataFrame([("1", "t", "d" * 30000, ["c"], ["g"], {"k": "v"})], "id string, title string, description string, categories array<string>, tags array<string>, specifications map<string,string>")
    sizes = row.select(F.length(C.document_text()), F.length(C.document_text(None))).first()
    assert tuple(sizes) == (20000, 30000 + len("t\n\nc\ng\nk: v"))
    source = spark.createDataFrame([("1", "x" * 3000)], "id string, text string")
    got = [C.import_field(row, source, "text", "long", **k).first()["specifications"]["long"] for k in ({}, {"limit": None})]
    assert [len(v) for v in got] == [2000, 3000]
