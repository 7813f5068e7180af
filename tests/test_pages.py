"""Pages at size: what a task holds, how often and where a page is read, and that the short way of reading gives the same tree."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from storelens.functions import batches as B, html as H
from storelens.operators import pages as G
from storelens.plans import page_queries as Q

SF = "/root/testdata/sf0.001"
PLAIN = ("<!DOCTYPE html><html><head><title>A &amp; b</title><style>p{}</style><script type=x>var t='</p>'</script></head><body><!-- c -->"
         "<ul class='a b'><li>1<li><a href=\"/x\" data-y>2 &lt; 3</a><br/><INPUT checked value=v></ul><textarea>t</textarea></body></html>")


def library(html):
    t = H._Tree()
    t.feed(html)
    t.close()
    return t.root


def tree(root):
    return [(n.tag, n.attrs, "\0".join("\1" if isinstance(p, H.Node) else p for p in n.parts).replace("\0", "")) for n in root.walk()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_markup_is_read_as_by_the_library(spark):
    rnd, plain = random.Random(7), 0
    real = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(50).collect()]
    odd = list("<>/\"'=& !-") + ["<!--", "-->", "</script>", "<script>", "</", "/>", "<svg>", "<p a=b/>", "<title>", "&lt;", "<SCRIPT>", "</p/>"]
    for _ in range(3000):
        html = rnd.choice([PLAIN, PLAIN, rnd.choice(real)[:2000]])
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(html))
            html = html[:at] + rnd.choice(odd) + html[at + rnd.randint(0, 3):]
        got = H._parse_plain(html)
        if got is not None:
            plain += 1
            assert tree(got) == tree(library(html)), html
    assert plain > 300 and H._parse_plain(PLAIN) is not None


def test_parts_are_bounded_by_bytes_and_lose_nothing():
    texts = ["x" * n for n in (10, 0, 700, 400, 5000, 1, 2)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "html": texts})
    got = list(B.parts(batch, 1000))
    assert [x for p in got for x in p.column("html").to_pylist()] == texts and [p.num_rows for p in got] == [3, 1, 1, 3]


def test_a_task_holds_a_part_not_a_batch(spark):
    pages = spark.range(0, 400, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://a/").alias("url"), F.repeat(F.lit("x"), 20_000).alias("html"))
    seen = B.map_parts(pages, lambda ids, urls, htmls: [{"n": len(ids)}], "n long").collect()
    assert sum(r["n"] for r in seen) == 400 and max(r["n"] for r in seen) <= B.PART_BYTES // 20_000


def test_generated_pages_are_dealt_before_they_are_read(spark):
    shown = plan(G.parse_pages(Q.ld_pages(spark, SF)))
    assert "Exchange" in shown[shown.index("MapInArrow"):] and "MapInPandas" not in shown


def test_own_page_product_reads_a_page_once(spark):
    nodes = G.json_ld_products(G.parse_pages(Q.ld_pages(spark, SF)))
    assert plan(G.own_page_product(nodes)).count("MapInArrow") == 1
