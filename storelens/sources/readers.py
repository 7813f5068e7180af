"""Catalog feeds and saved platform pages (SRC-01, 05..07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens.operators.catalog import normalize_products

c = F.col


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """SRC-01: one raw collection with a declared schema; unselected columns are never read."""
    return spark.read.format(fmt).schema(schema).load(path)


def parse_feed(docs: DataFrame, row_schema: str, body: str = "body") -> DataFrame:
    """SRC-05: product rows of JSON feed documents that are an array or an object {products, nextUrl}."""
    text = F.trim(body)
    rows = F.when(text.startswith("["), F.from_json(text, f"array<struct<{row_schema}>>")).otherwise(
        F.from_json(text, f"struct<products: array<struct<{row_schema}>>>")["products"])
    return docs.select(F.inline(rows))


def read_feed_json(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """SRC-05: feed files, one document each."""
    return parse_feed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"), row_schema)


def read_feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: delimited feed: tab when the first line has one, quoted cells, byte-order mark, short and blank rows."""
    head = spark.read.text(path).first()
    sep = "\t" if head and "\t" in head[0] else ","
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    df = df.toDF(*[x.strip().lstrip("﻿") for x in df.columns]).na.fill("")
    return df.filter(F.concat(*[c(f"`{x}`") for x in df.columns]) != "")


# Row fields of the platforms' product responses.
SHOPIFY_ROW = ("id string, title string, handle string, body_html string, vendor string, product_type string, tags array<string>, currency string, "
               "variants array<struct<id:string,sku:string,price:string,compare_at_price:string,available:boolean>>")
WOO_ROW = ("id string, name string, permalink string, sku string, prices struct<price:string,regular_price:string,currency_minor_unit:int,currency_code:string>, "
           "is_in_stock boolean, categories array<struct<name:string>>, tags array<struct<name:string>>, description string")
MAGENTO_ROW = ("id string, sku string, name string, price double, status int, custom_attributes array<struct<attribute_code:string,value:string>>, "
               "extension_attributes struct<stock_item:struct<is_in_stock:boolean>>")


def platform_rows(docs: DataFrame, platform: str, origin: str, body: str = "body") -> DataFrame:
    """SRC-07: canonical products of saved response pages of a platform; custom pages are JSON arrays of plain rows."""
    if platform == "shopify":
        return normalize_products(parse_feed(docs, SHOPIFY_ROW, body), "shopify", origin)
    if platform == "woocommerce":
        return normalize_products(parse_feed(docs, WOO_ROW, body), "woocommerce", origin)
    if platform == "magento":
        rows = docs.select(F.inline(F.from_json(body, f"struct<items: array<struct<{MAGENTO_ROW}>>>")["items"]))
        attr = lambda code: F.try_element_at(F.filter("custom_attributes", lambda a: a["attribute_code"] == code), F.lit(1))["value"]
        none = F.lit(None).cast("string")
        plain = rows.select("id", "sku", "name", F.concat(F.lit("/"), F.coalesce(attr("url_key"), "sku"), F.lit(".html")).alias("url"), "price",
                            none.alias("regular_price"), none.alias("currency"),
                            F.when(c("extension_attributes.stock_item.is_in_stock"), "/InStock").otherwise("/OutOfStock").alias("availability"),
                            none.alias("category"), none.alias("tags"), F.coalesce(attr("description"), attr("short_description")).alias("description"), none.alias("brand"))
        return normalize_products(plain, "custom", origin)
    row = "id string, sku string, name string, url string, price string, regular_price string, currency string, availability string, category string, tags string, description string, brand string"
    return normalize_products(parse_feed(docs, row, body), "custom", origin)


def read_platform_pages(spark: SparkSession, path: str, platform: str, origin: str) -> DataFrame:
    """SRC-07: saved response files of one platform."""
    docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return platform_rows(docs, platform, origin)
