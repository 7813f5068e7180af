"""Continuous forms of the event and catalog jobs (STR-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storelens.operators import events as E
from storelens.streaming.attribution import stream_attribute
from storelens.streaming.feeds import CatalogLog, catalog_writer, stream_catalog_changes

__all__ = ["CatalogLog", "catalog_writer", "stream_attribute", "stream_catalog_changes", "stream_daily_activity", "stream_normalize", "stream_unique_orders"]

c = F.col


def stream_normalize(raw: DataFrame, kind: str) -> DataFrame:
    """STR-01: raw rows of an append stream as normalised events; stateless.

    ``kind`` is search, click, cart, checkout or purchase.
    """
    if kind == "search":
        return E.to_query_events(raw)
    if kind == "checkout":
        return E.to_checkout_starts(raw)
    return E.to_purchase_events(raw) if kind == "purchase" else E.to_product_events(raw, kind)


def stream_unique_orders(purchases: DataFrame, lateness: str = "1 day") -> DataFrame:
    """STR-02: the first row per order id within the lateness bound; rows without an id pass."""
    marked = purchases.withWatermark("t", lateness)
    named = marked.filter("order_id is not null").dropDuplicatesWithinWatermark(["order_id"])
    return named.unionByName(marked.filter("order_id is null"))


def stream_daily_activity(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """STR-03: events per UTC day and kind; rows later than the watermark are dropped."""
    return events.withWatermark("t", lateness).groupBy(F.window("t", "1 day").alias("day"), "kind").agg(F.count("*").alias("n")).select(
        c("day.start").alias("day"), "kind", "n")
