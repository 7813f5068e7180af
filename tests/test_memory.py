"""What a Python worker holds at a time."""

import tracemalloc
import unicodedata

import pyarrow as pa

from storelens.functions import text as T


def test_decomposition_holds_few_strings_at_a_time():
    """The strings of a whole batch were held before, twice over."""
    values = [None if i % 9 == 0 else ("é" if i % 2 else "e") * 10_000 for i in range(2000)]
    batch = pa.array(values)
    tracemalloc.start()
    got = T.decomposed(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    assert got.to_pylist() == [v and unicodedata.normalize("NFKD", v) for v in values]
    assert T.decomposed(pa.array([], pa.string())).to_pylist() == []


def test_pages_give_only_the_wanted_facts(spark):
    """All facts of a page were made and sent for queries that need one."""
    from storelens.operators import pages as G

    html = "<title>a</title><body><a href='/x'>y</a><table><tr><th>k<td>v</table><script type='application/ld+json'>{\"@type\": \"Product\", \"name\": \"n\"}</script></body>"
    pages = spark.createDataFrame([(1, "https://s/1", html), (2, "https://s/2", None)], "page_id long, url string, html string")
    every = G.parse_pages(pages)
    for facts in (["specs"], ["url", "products"], ["links", "body"], ["blocks", "h1", "metas", "itemtypes", "text", "title", "inputs"]):
        some = G.parse_pages(pages, *facts)
        assert set(some.columns) == {"page_id", *facts}
        assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))
