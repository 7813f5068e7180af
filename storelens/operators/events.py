"""Raw shop events to the normalised event tables (SRC-02..04, PRJ-01..11, FLT-01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from storelens.functions.numbers import parse_event_time, parse_number
from storelens.functions.text import blank_to_empty, query_key

# Statuses of a legacy order that count as paid.
PAID = ("paid", "completed", "processing", "partially_refunded")
DAY_US = 86_400_000_000


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A possibly missing (nested) raw field; shops disagree on which fields they log."""
    field: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(field, T.StructType) or part not in field.fieldNames():
            return F.lit(None).cast(dtype)
        field = field[part].dataType
    return F.col(name)


def event_time(df: DataFrame) -> Column:
    """First readable of the three time fields."""
    return F.coalesce(*[parse_event_time(col_or_null(df, c).cast("string"))
                        for c in ("timestamp", "created_at", "received_at")])


def session_key(df: DataFrame) -> Column:
    """PRJ-02: session id from its three spellings, trimmed, blank as null."""
    raw = F.coalesce(*[col_or_null(df, c).cast("string")
                       for c in ("session_id", "sessionId", "orderData.session_id")])
    return F.nullif(F.trim(raw), F.lit(""))


def explicit_query(df: DataFrame) -> Column:
    """PRJ-04: the tagged query; an empty tag does not fall through to the second field."""
    return blank_to_empty(query_key(F.coalesce(col_or_null(df, "search_query"), col_or_null(df, "normalized_query"))))


def order_total(df: DataFrame) -> Column:
    """PRJ-06: first readable amount of six fields."""
    names = ("order_total", "orderData.total_price", "orderData.total", "total_price", "total", "cart_total")
    return F.coalesce(*[parse_number(col_or_null(df, n).cast("string")) for n in names])


def order_currency(df: DataFrame) -> Column:
    """PRJ-07: a three-capital-letter currency code or null."""
    c = F.coalesce(col_or_null(df, "currency"), col_or_null(df, "orderData.currency"))
    return F.when(c.rlike("^[A-Z]{3}$"), c)


def is_purchase(df: DataFrame) -> Column:
    """PRJ-05: completed checkouts, and paid legacy orders with lines or an amount."""
    kind = F.coalesce(col_or_null(df, "event_type"), F.lit(""))
    status = F.coalesce(col_or_null(df, "shopify_data.financial_status"), col_or_null(df, "financial_status"),
                        col_or_null(df, "status"))
    lines = [col_or_null(df, n).isNotNull() for n in ("items", "cart_items", "line_items", "products")]
    amount = parse_number(F.coalesce(col_or_null(df, "order_total"), col_or_null(df, "total_price")).cast("string"))
    legacy = (F.coalesce(col_or_null(df, "order_id").cast("string"), F.lit("")) != "") & \
        F.coalesce(status.isin(*PAID), F.lit(True)) & reduce(lambda a, b: a | b, lines + [amount.isNotNull()])
    return F.when(kind != "", kind == "checkout_completed").otherwise(legacy)


def _item_fields(df: DataFrame, name: str) -> Column:
    """One item list with uniform element fields, or a null array."""
    out = "array<struct<pid:string,name:string,qty:double>>"
    if name not in df.columns:
        return F.lit(None).cast(out)
    have = df.schema[name].dataType.elementType.fieldNames()
    pick = lambda i, names: F.coalesce(*([i[n].cast("string") for n in names if n in have] + [F.lit("")]))
    qty = lambda i: F.coalesce(parse_number(i["quantity"].cast("string")), F.lit(1.0)) if "quantity" in have else F.lit(1.0)
    items = F.transform(F.col(name), lambda i: F.struct(
        pick(i, ("product_id", "id")).alias("pid"),
        pick(i, ("product_name", "name", "title")).alias("name"), qty(i).alias("qty")))
    return F.filter(items, lambda i: (i["pid"] != "") | (i["name"] != "")).cast(out)


def to_query_events(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """PRJ-08: searches with result count, tri-state zero flag and the first ten result names."""
    listed = col_or_null(df, "deliveredProducts", "array<string>")
    counts = [parse_number(col_or_null(df, c).cast("string"))
              for c in ("native_result_count", "resultCount", "resultsCount", "totalResults")]
    count = F.when(listed.isNotNull(), F.size(listed).cast("double")).otherwise(F.coalesce(*counts))
    zero = F.coalesce(col_or_null(df, "zero_results", "boolean"), count == 0)
    names = F.filter(F.slice(listed, 1, 10), lambda n: n.isNotNull() & (n != ""))
    out = df.select(F.col(id_col).alias("event_id"), query_key(F.col("query")).alias("q"),
                    session_key(df).alias("s"), event_time(df).alias("t"), count.cast("int").alias("delivered"),
                    zero.alias("zero"), F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    return out.filter(F.col("t").isNotNull() & (F.col("q") != ""))


def to_product_events(df: DataFrame, kind: str, id_col: str = "event_id") -> DataFrame:
    """PRJ-09: clicks or carts; cart rows keep ``add_to_cart`` and untyped events."""
    if kind == "cart":
        typed = F.coalesce(col_or_null(df, "event_type"), F.lit(""))
        df = df.filter(typed.isin("", "add_to_cart"))
    text = lambda c: F.coalesce(col_or_null(df, c).cast("string"), F.lit(""))
    out = df.select(F.col(id_col).alias("event_id"), F.lit(kind).alias("kind"), explicit_query(df).alias("q"),
                    session_key(df).alias("s"), event_time(df).alias("t"), text("product_id").alias("pid"),
                    text("product_name").alias("name"), text("product_url").alias("url"))
    return out.filter(F.col("t").isNotNull())


def to_purchase_events(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """PRJ-10: completed purchases with amount, currency and line items."""
    first = F.coalesce(*[_item_fields(df, n) for n in ("items", "cart_items", "line_items", "products")],
                       F.array().cast("array<struct<pid:string,name:string,qty:double>>"))
    started = F.coalesce(col_or_null(df, "event_type"), F.lit("")) == "checkout_initiated"
    out = df.filter(~started & is_purchase(df)).select(
        F.col(id_col).alias("event_id"), explicit_query(df).alias("q"), session_key(df).alias("s"),
        event_time(df).alias("t"), F.nullif(col_or_null(df, "order_id").cast("string"), F.lit("")).alias("order_id"),
        order_total(df).alias("total"), order_currency(df).alias("currency"), first.alias("items"))
    return out.filter(F.col("t").isNotNull())


def to_checkout_starts(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """PRJ-11: checkouts that were only started."""
    out = df.filter(F.col("event_type") == "checkout_initiated").select(
        F.col(id_col).alias("event_id"), explicit_query(df).alias("q"), session_key(df).alias("s"),
        event_time(df).alias("t"))
    return out.filter(F.col("t").isNotNull())


def in_window(df: DataFrame, start: str, end: str, t: str = "t", now: str | None = None, max_days: int | None = None) -> DataFrame:
    """FLT-01: rows of the half-open window, not ending in the future of ``now``; over ``max_days``, if given, it is refused."""
    import datetime as dt

    parse = lambda v: dt.datetime.fromisoformat(v).replace(tzinfo=dt.timezone.utc)
    a, b = parse(start), parse(end)
    if not a < b or max_days is not None and b - a > dt.timedelta(days=max_days):
        raise ValueError("window must be positive and within the allowed number of days")
    if now is not None and b > parse(now) + dt.timedelta(minutes=1):
        raise ValueError("window ends in the future")
    lo, hi = [F.timestamp_seconds(F.lit(int(v.timestamp()))) for v in (a, b)]
    return df.filter((F.col(t) >= lo) & (F.col(t) < hi))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """SRC-03: several collections of one kind as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_rows(df: DataFrame, n: int, order: str = "event_id") -> DataFrame:
    """SRC-04: the newest ``n`` rows, each flagged when older rows were left out."""
    more = df.orderBy(F.col(order).desc()).limit(n + 1).agg((F.count("*") > n).alias("m"))
    return df.orderBy(F.col(order).desc()).limit(n).withColumn("truncated", more.scalar())


def source_status(present: DataFrame, expected: list[str], failed: tuple[str, ...] = ()) -> DataFrame:
    """SRC-02: ok / missing / unavailable per expected source with row count and truncation flag.

    ``present`` is (source, rows, truncated); rows of a failed source are not counted.
    """
    spark = present.sparkSession
    names = spark.createDataFrame([(n,) for n in expected], "source string")
    bad = F.col("source").isin(*failed) if failed else F.lit(False)
    j = names.join(present, "source", "left")
    status = F.when(bad, "unavailable").when(F.col("rows").isNull(), "missing").otherwise("ok")
    known = status == "ok"
    return j.select("source", status.alias("status"),
                    F.when(known, F.col("rows")).otherwise(F.lit(0)).cast("bigint").alias("rows"),
                    F.when(known, F.coalesce(F.col("truncated"), F.lit(False))).otherwise(F.lit(False)).alias("truncated"))
