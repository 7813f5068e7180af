"""Substring conditions of many asked terms on many texts as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.session import large

c = F.col
GRAM = 3


def _runs(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def words_holding(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(asked, term): for every asked term the words that contain its longest run without white space.

    ``asked`` is (asked), ``words`` (term); repeated rows count once, null and blank terms hold nowhere. A run meets
    the words on its first three characters (all of them, if fewer) and is verified with ``contains``; only distinct
    words are cut into pieces of one to three characters, so the join grows with the vocabulary, not with the texts.
    """
    longest = F.reduce(_runs(c("asked")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    want = asked.select("asked").distinct().withColumn("_run", longest).filter("_run <> ''").withColumn("gram", F.left("_run", F.lit(GRAM)))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("term"))), lambda k: F.transform(
        F.sequence(F.lit(1), F.length("term") - k + 1), lambda i: F.substring("term", i, k))))
    have = words.select("term").distinct().filter("term <> ''").select("term", F.explode(F.array_distinct(pieces)).alias("gram"))
    return want.join(large(have), "gram").filter(F.contains("term", "_run")).select("asked", "term")


def contained(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(asked, product_id): the texts (product_id, text) that contain an asked term; terms of several words are verified on the text."""
    posts = texts.select("product_id", F.explode(F.array_distinct(_runs(c("text")))).alias("term"))
    near = words_holding(asked, posts).join(large(posts), "term").select("asked", "product_id").distinct()
    several = c("asked").rlike("\\s")
    verified = near.filter(several).join(large(texts), "product_id").filter(F.contains("text", "asked")).select("asked", "product_id").distinct()
    return near.filter(~several).unionByName(verified)
