"""Inputs beyond the sizes that used to be fixed: long windows, deep pages, long results and words."""

import datetime as dt

from pyspark.sql import functions as F

from storelens.functions import html as H
from storelens.functions.text import prefix_stems
from storelens.operators import attribution as A, hooks, pages

T0 = dt.datetime(2026, 9, 10, 10)


def test_windows_over_a_day(spark):
    searches = spark.createDataFrame([(1, "ring", "s1", T0 - dt.timedelta(hours=30)), (2, "old", "s1", T0 - dt.timedelta(hours=60))], "event_id long, q string, s string, t timestamp")
    events = spark.createDataFrame([(9, "click", "", "s1", T0)], "event_id long, kind string, q string, s string, t timestamp")
    two_days = {"click": 2880 * A.MINUTE_US}
    assert A.preceding_search(events, searches, two_days).first()["hit_q"] == "ring"
    assert A.preceding_search(events, searches).first()["hit_q"] is None
    any_age = A.as_of(events, searches, ["s"], F.lit(40 * 1440 * A.MINUTE_US), ["q"]).first()
    assert any_age["hit"]["q"] == "ring"


def test_pages_of_any_depth():
    root = H.parse("<div>" * 50_000 + "<a href='/x' title='T'>deep</a>")
    assert root.text() == "deep" and sum(1 for _ in root.walk()) == 50_002
    facts = pages._facts("https://a/", "<nav>" + "<div>" * 2_000 + "<a href='/x' title='T'>deep</a>" + '<script type="application/ld+json">' + "[" * 100_000 + "</script>")
    assert facts["links"] == [{"href": "/x", "text": "deep", "title": "T", "chrome": True, "nav": True}] and facts["products"] == []


def test_rerank_sees_all_results(spark):
    rows = spark.range(1, 1501).select(F.lit("q").alias("query_id"), F.col("id").alias("product_id"), F.col("id").cast("int").alias("rank"))
    got = hooks.rerank(rows, lambda q, pdf: [x for x in pdf["product_id"] if x % 2 == 0])
    assert got.count() == 750 and got.agg(F.max("product_id"), F.max("rank")).first() == (1500, 750)
    assert hooks.rerank(rows, lambda q, pdf: [], n=1000).count() == 500


def test_long_words_keep_their_end(spark):
    word = "ה" + "א" * 1500
    assert spark.range(1).select(prefix_stems(F.lit(word)).alias("x")).first()["x"] == [word[1:]]
