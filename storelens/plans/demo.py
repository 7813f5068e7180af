"""Bindings of the generic test tables to the shop tables the operators expect.

Raw events mix the shapes shops log: two session spellings, four time formats,
tagged and untagged events, several order layouts.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storelens.operators import events as E
from storelens.operators.funnel import Events
from storelens.plans.report import ConversionReport

PRODUCT_SPACE = 2100  # product ids of events; a few of them are not in the catalog
SHOP = "https://shop.example"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_base(spark: SparkSession, sf: str) -> DataFrame:
    """events with the derived attributes every raw collection is made of."""
    return once("raw", spark, sf, lambda: raw_rows(table(spark, sf, "events")))


def raw_rows(ev: DataFrame) -> DataFrame:
    """The same for any (also streaming) frame of the events table."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    t = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ms = F.unix_millis(t).cast("string")
    form = e % 5
    sid = F.when(e % 10 != 0, F.col("user_id").cast("string"))
    return ev.select(
        e, "user_id", "event_type", "value", k.alias("k"), t.alias("t"),
        F.when(form == 0, F.concat(iso, F.lit("Z"))).when(form == 1, F.concat(iso, F.lit("+00:00")))
        .when(form == 2, ms).when(form == 3, iso).alias("timestamp"),
        F.when(form == 4, ms).alias("created_at"),
        F.when(e % 3 != 0, F.concat(F.lit(" "), sid, F.lit(" "))).alias("session_id"),
        F.when(e % 3 == 0, sid).alias("sessionId"),
        F.when(k % 3 == 0, F.concat(F.lit("Q"), (k % 20).cast("string"))).when(k % 3 == 1, F.lit("direct")).alias("search_query"),
        ((e * 7) % PRODUCT_SPACE).alias("pid"))


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    b = raw_base(spark, sf).filter("event_type = 'view'")
    n = (F.floor("value") % 5).cast("int")
    names = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("Item "), ((F.col("event_id") + i) % PRODUCT_SPACE).cast("string")))
    listed = F.when(n > 0, names).otherwise(F.array().cast("array<string>"))
    pad = F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.lit(""))
    return b.select("event_id", "timestamp", "created_at", "session_id", "sessionId",
                    F.concat(F.lit(" Q"), (F.col("k") % 20).cast("string"), pad).alias("query"),
                    F.when(F.col("k") % 7 != 0, listed).alias("deliveredProducts"))


def _product_fields() -> list[Column]:
    p = F.col("pid").cast("string")
    f = F.col("event_id") % 5
    return [F.when(f == 0, p).when(f == 1, F.concat(F.lit("gid://shop/Product/"), p))
            .when(f == 2, F.concat(F.lit("woo_product_"), p)).when(f == 3, F.lit("---")).alias("product_id"),
            F.when(f == 4, F.concat(F.lit(" ITEM  "), p)).alias("product_name"),
            F.when(f == 3, F.concat(F.lit(f"{SHOP}/products/item-"), p, F.lit("?ref=x"))).alias("product_url")]


def raw_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return raw_base(spark, sf).filter("event_type = 'click'").select(
        "event_id", "timestamp", "created_at", "session_id", "sessionId", "search_query", *_product_fields())


def raw_carts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 17 == 0, "remove_from_cart").when(F.col("event_id") % 2 == 0, "add_to_cart")
    return raw_base(spark, sf).filter("event_type = 'signup'").select(
        "event_id", "timestamp", "created_at", "session_id", "sessionId", "search_query", kind.alias("event_type"),
        *_product_fields())


def raw_checkouts(spark: SparkSession, sf: str) -> DataFrame:
    return once("raw checkouts", spark, sf, lambda: _raw_checkouts(spark, sf))


def _raw_checkouts(spark: SparkSession, sf: str) -> DataFrame:
    b = raw_base(spark, sf).filter("event_type in ('error', 'purchase')")
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "checkout_initiated").when(e % 6 != 0, "checkout_completed")
    amount = F.col("value").cast("string")
    item = lambda i: ((e * 7 + i * 13) % PRODUCT_SPACE).cast("string")
    lines = F.transform(F.sequence(F.lit(0), (e % 3).cast("int")), lambda i: F.struct(
        item(i).alias("product_id"), F.concat(F.lit("Item "), item(i)).alias("name"), (i + 1).cast("string").alias("quantity")))
    bought = F.col("event_type") == "purchase"
    return b.select(
        "event_id", "timestamp", "created_at", "session_id", "sessionId", "search_query", kind.alias("event_type"),
        F.when(e % 4 < 2, F.floor(e / 2).cast("string")).alias("order_id"),
        F.when(bought & (e % 3 == 0), amount).alias("order_total"), F.when(bought & (e % 3 == 1), amount).alias("total_price"),
        F.struct(F.when(bought & (e % 3 == 2), amount).alias("total_price"), F.lit(None).cast("string").alias("currency"),
                 F.lit(None).cast("string").alias("session_id")).alias("orderData"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 7 == 0, "ils")
        .when(F.col("user_id") % 2 == 0, "ILS").otherwise("USD").alias("currency"),
        F.when(e % 12 == 0, "paid").otherwise("refunded").alias("status"),
        F.when(bought & (e % 2 == 0), lines).alias("items"), F.when(bought & (e % 2 == 1), lines).alias("line_items"))


def searches(spark, sf):
    return E.to_query_events(raw_queries(spark, sf))


def clicks(spark, sf):
    return E.to_product_events(raw_clicks(spark, sf), "click")


def carts(spark, sf):
    return E.to_product_events(raw_carts(spark, sf), "cart")


def checkouts(spark, sf):
    return E.to_checkout_starts(raw_checkouts(spark, sf))


def purchases(spark, sf):
    return E.to_purchase_events(raw_checkouts(spark, sf))


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(source, rows, truncated) of the four collections, counted in one pass."""
    name = F.create_map(*[F.lit(x) for x in (
        "view", "queries", "click", "product_clicks", "signup", "cart", "error", "checkout_events",
        "purchase", "checkout_events")])
    return table(spark, sf, "events").groupBy(name[F.col("event_type")].alias("source")).agg(
        F.count("*").alias("rows")).withColumn("truncated", F.lit(False))


SOURCES = ["queries", "product_clicks", "cart", "checkout_events"]


def sources(spark, sf):
    return E.source_status(source_rows(spark, sf), SOURCES)


_MADE: dict[tuple, object] = {}


def once(name: str, spark: SparkSession, sf: str, make):
    """A table bundle built once per session and data folder, as a report job shares it between its parts."""
    key = (name, spark.sparkContext.applicationId, id(spark), sf)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def reset(spark: SparkSession) -> None:
    """Forgets the shared bundles and their cached tables."""
    _MADE.clear()
    spark.catalog.clearCache()


def events(spark: SparkSession, sf: str) -> Events:
    """The shop's event bundle; callers may replace parts of their copy."""
    return copy.copy(once("events", spark, sf, lambda: Events(
        searches(spark, sf), clicks(spark, sf), carts(spark, sf), checkouts(spark, sf), purchases(spark, sf), sources(spark, sf))))


def report(spark: SparkSession, sf: str) -> ConversionReport:
    return once("report", spark, sf, lambda: ConversionReport(events(spark, sf), products(spark, sf)))


def products(spark: SparkSession, sf: str) -> DataFrame:
    """part as the shop's product cards."""
    p = F.col("p_partkey")
    ids = p.cast("string")
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        ids.alias("id"), F.concat(F.lit("Item "), ids).alias("name"), F.initcap("p_name").alias("title"),
        F.concat(F.lit("A "), F.col("p_name"), F.lit(" of type "), F.lower("p_type"), F.lit(", size "),
                 size.cast("string")).alias("description"),
        F.concat(F.lit(f"{SHOP}/products/item-"), ids).alias("url"), F.concat(F.lit("SKU-"), ids).alias("sku"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
        F.when(p % 4 == 0, F.col("p_retailprice") * 1.25).otherwise(F.col("p_retailprice")).alias("regular_price"),
        F.when(size % 7 == 0, "outofstock").when(size % 13 == 0, "onbackorder").otherwise("instock").alias("stock_status"),
        (size % 11 == 0).alias("hidden"), F.when(p % 9 == 0, "draft").otherwise("ACTIVE").alias("status"),
        F.array(F.col("p_type"), F.element_at(F.split("p_name", " "), -1)).alias("categories"),
        F.array_compact(F.array(F.col("p_brand"), F.when(size > 40, "large"), F.when(size < 10, "small"))).alias("tags"),
        F.array(F.element_at(F.split("p_name", " "), 1)).alias("colors"),
        F.create_map(F.lit("size"), size.cast("string"), F.lit("brand"), F.col("p_brand")).alias("specifications"),
        (p % 50).cast("double").alias("popularity"), size.alias("size"))
