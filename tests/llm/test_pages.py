"""Main text and archives of pages."""

import zlib

import pytest
from pyspark.sql import functions as F

from storelens.llm import warc as W
from storelens.llm.html_blocks import blocks
from storelens.llm.html_content import _scores, default_model, extract_pages, labelled_pages, main_text, viterbi


@pytest.fixture(scope="module")
def model():
    return default_model()


def test_labels_of_held_out_pages(model):
    wrong = total = 0
    for rows, labels in labelled_pages(100, seed=99):
        got = viterbi(_scores(model, rows), model[1], model[2])
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong < 0.01 * total


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, accept?</p></div><article><h1>Title &amp; more</h1><p><b>One   two<br>three.<p>Fo<i>u</i>r &eacute; five.</p>
<div class="ad">Buy this now.</div><ul><li>item one<li>item two</ul></article><aside class="sidebar"><p>Other stories you may like.</p></aside>
<section id="comments"><div class="comment"><p>I think that this is great, thanks.</p></div></section><form><label>Mail</label><input><button>Go</button></form>
<script>var x = "</p>";</script><footer>&copy; Site</footer></body></html>"""


def test_article_only(model):
    assert main_text(PAGE, model) == "Title & more\nOne two three.\nFour é five.\nitem one\nitem two"


def test_broken_markup(model):
    assert main_text("", model) == "" and main_text("<p", model) == "" and main_text("<!-- open", model) == ""
    assert [b.text for b in blocks("<div>" * 100_000 + "deep")] == ["deep"]
    assert [b.text for b in blocks("a<br>b<td>c</td></ul>d<script>e")] == ["a b", "c", "d"]


def test_pages_edge_cases(spark, model):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (3, "u", PAGE, "z"), (3, "u", PAGE, "z")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in extract_pages(rows, model).collect())
    assert [g[:2] for g in got[:2]] == [(1, 0), (2, 0)] and len(got) == 4 and all(a == b for _, a, b in got)
    assert extract_pages(rows.limit(0), model).count() == 0


def test_archive_round_trip(spark, folder):
    pages = [(5, "http://a/\n?x", "same"), (2, None, "same"), (9, "u", None), (4, "u", ""), (7, "u", "é😀\r\n\r\nWARC/1.1"), (2, None, "same"), (None, "u", "same"), (8, "u", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    f = folder()
    index = W.write_archives(W.mark_revisits(df, f).repartition(3), f, file_bytes=2000)
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["html"]) for r in W.read_records(index, f, keep_html=True).collect()), key=str)
    want = [(5, "revisit", 2, 4, ""), (2, "response", None, 4, "same"), (2, "response", None, 4, "same"), (9, "revisit", 4, 0, ""), (4, "response", None, 0, ""),
            (7, "response", None, len("é😀\r\n\r\nWARC/1.1".encode()), pages[4][2]), (-1, "response", None, 4, "same"), (8, "response", None, 300_000, "x" * 300_000)]
    assert got == sorted(want, key=str)
    some = W.read_records(index.where("page_id in (7, 8)"), f)
    assert {r["page_id"] for r in some.collect()} == {7, 8}
    big = W.mark_revisits(df, folder(), min_bytes=5)
    assert big.where(F.col("first").isNotNull()).count() == 0
    empty = folder()
    assert W.read_records(W.write_archives(W.mark_revisits(df.limit(0), empty), empty), empty).count() == 0


def test_ranges_join_neighbours():
    e = [("a", 0, 10), ("a", 10, 5), ("a", 500, 5), ("b", 0, 5)]
    assert list(W.ranges(e, max_gap=20)) == [("a", 0, 15, 0, 2), ("a", 500, 505, 2, 3), ("b", 0, 5, 3, 4)]
    assert list(W.ranges(e, max_gap=1000))[0][:3] == ("a", 0, 505)
    raw = W.record(1, "u", b"body", W.base32_sha1(b"body"), None, "1970-01-01T00:00:00Z")
    fields, http, payload = W.parse(raw)
    assert payload == b"body" and fields["warc-type"] == "response" and http["content-length"] == "4"
    assert zlib.decompress(W._gzip(raw), 31) == raw


def test_tags_that_never_close_are_read_in_linear_time():
    import random
    import time

    from storelens.llm import html_blocks as H

    r = random.Random(1)
    for _ in range(4000):  # the same tags as a plain search finds
        page = "".join(r.choice(["<", "<a", "</b", ">", '"', "'", "/", " ", "x=", "<!--", "-->", "<!", "t", "<a<"]) for _ in range(r.randint(1, 60)))
        tags, at, got = H._Tags(page), 0, []
        tags.failed = r.choice([0, 7, 7])
        while m := tags.search(at):
            got.append(m.span())
            at = m.end()
        assert got == [m.span() for m in H.TAG.finditer(page)], page
    for part in ("<a ", "<a", '<a "', "<a'", "<p x='", "<b>x<a \"", "< ", "</a ", "<!x"):
        page = part * (500_000 // len(part))
        for end in ("", ">"):
            start = time.time()
            H.blocks(page + end)
            assert time.time() - start < 10, (part, end)
