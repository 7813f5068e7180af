"""Streams over the event table, run to completion into the shared folder and read back; feeds and report rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens.operators import funnel as U
from storelens.plans import catalog_queries as CQ, demo as D
from storelens.plans.oracle import sql
from storelens.plans.registry import query
from storelens.session import shared_folder
from storelens.sources import readers as RD, sinks as SK
from storelens.streaming import jobs as J

c = F.col


def run_stream(df: DataFrame) -> DataFrame:
    """Runs an append stream over all available input; its output table."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    (df.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(f"{out}")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = D.table(spark, sf, "events").schema
    return D.raw_rows(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def raw_kind(spark, sf, kind, name):
    b = raw_stream(spark, sf).filter(c("event_type") == kind)
    if name == "search":
        return b.withColumn("query", F.concat(F.lit(" Q"), (c("k") % 20).cast("string")))
    order = F.when(c("event_id") % 4 < 2, F.floor(c("event_id") / 2).cast("string"))
    return b.withColumn("event_type", F.lit("checkout_completed")).withColumn("order_id", order).withColumn("product_id", c("pid").cast("string"))


@query("str_01_stream_normalize", sql("select event_id, q, s, epoch_us(t) as t_us from search", "search"))
def stream_normalize(spark, sf):
    out = J.stream_normalize(raw_kind(spark, sf, "view", "search"), "search").select("event_id", "q", "s", F.unix_micros("t").alias("t_us"))
    return run_stream(out)


@query("str_02_stream_unique_orders", sql("select coalesce(order_id, '') as order_id, case when order_id is null then count(*) else 1 end as n from (select case when event_id % 4 < 2 then '' || event_id // 2 end as order_id from raw where event_type = 'purchase') group by order_id", "raw"))
def stream_unique_orders(spark, sf):
    rows = J.stream_normalize(raw_kind(spark, sf, "purchase", "purchase"), "purchase").select("event_id", "order_id", "t")
    out = run_stream(J.stream_unique_orders(rows, "40 days"))
    return out.groupBy(F.coalesce("order_id", F.lit("")).alias("order_id")).agg(F.count("*").alias("n"))


@query("str_03_stream_daily_activity", sql("select epoch_us(date_trunc('day', t)) as day_us, event_type as kind, count(*) as n from raw where date_trunc('day', t) + interval 1 day <= (select max(t) from raw) - interval 1 hour group by 1, 2", "raw"))
def stream_daily_activity(spark, sf):
    out = run_stream(J.stream_daily_activity(raw_stream(spark, sf).select(c("event_type").alias("kind"), "t"), "1 hour"))
    return out.select(F.unix_micros("day").alias("day_us"), "kind", "n")


@query("str_04_stream_attribute", sql("""select e.event_id, epoch_us(e.t) as et_us, arg_max(x.q, (x.t, -x.event_id)) as hit_q, epoch_us(max(x.t)) as hit_us
    from tagged e left join search x on e.s = x.s and x.t <= e.t and x.t >= e.t - interval 2 hour
    where e.event_type = 'signup' and (e.s is null or e.t < least((select max(t) from search), (select max(t) from tagged where event_type = 'signup')) - interval 1 hour)
    group by e.event_id, e.t""", "tagged", "search"))
def stream_attribute(spark, sf):
    searches = J.stream_normalize(raw_kind(spark, sf, "view", "search"), "search")
    carts = J.stream_normalize(raw_kind(spark, sf, "signup", "cart").drop("event_type"), "cart")
    out = run_stream(J.stream_attribute(carts, searches, "cart", "1 hour"))
    return out.select("event_id", F.unix_micros("et").alias("et_us"), "hit_q", F.unix_micros("hit_t").alias("hit_us"))


def fed_in_pieces(spark, sf) -> J.CatalogLog:
    """The feed in three files, one a batch: half of the products, the other half of them, and the end row."""
    cards, feed = CQ.feed_inputs(spark, sf)
    base = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    log = J.CatalogLog(spark, f"{base}/cards")
    log.create(cards)
    rows = feed.withColumn("feed", F.lit(1).cast("bigint")).withColumn("end_rows", F.lit(None).cast("bigint"))
    second = F.pmod(F.crc32(c("id").cast("binary")), F.lit(2)) == 1
    end = rows.agg(F.count("*").alias("end_rows")).select(*[F.lit(None).cast(t).alias(n) for n, t in feed.dtypes], F.lit(1).cast("bigint").alias("feed"), "end_rows")
    for part in (rows.filter(~second), rows.filter(second), end):
        part.coalesce(1).write.mode("append").parquet(f"{base}/feed")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    J.stream_catalog_changes(stream, f"{base}/cards", f"{base}/state").awaitTermination()
    return log


@query("str_05_stream_catalog_changes", sql("select outcome, count(*) as n from fed where outcome <> 'ignored' group by 1", "fed"))
def stream_catalog_changes(spark, sf):
    return fed_in_pieces(spark, sf).outcomes().select("outcome", "n")


@query("str_05_cards_after_feed", sql("""select id, case when infeed and n % 4 = 1 then price + 5 else price end as price,
    case when outcome = 'removed' then true when outcome in ('restored', 'added') then false else hid end as hidden from fed where outcome <> 'ignored'""", "fed"))
def cards_after_feed(spark, sf):
    return fed_in_pieces(spark, sf).cards().select("id", "price", "hidden")


def feed_docs(spark, sf, row, wrap):
    """Feed documents of the catalog, a hundred products each, arrays or wrapped objects."""
    p = D.table(spark, sf, "part").groupBy(F.floor(c("p_partkey") / 100).alias("doc")).agg(F.to_json(F.collect_list(row)).alias("body"))
    return p.select(F.when(c("doc") % 2 == 0, F.concat(F.lit('{"products":'), "body", F.lit("}"))).otherwise(c("body")).alias("body")) if wrap else p.select("body")


@query("src_05_read_feed_json", "select '' || p_partkey as id, p_name as title, p_retailprice as price from part")
def read_feed_json(spark, sf):
    row = F.struct(c("p_partkey").alias("id"), c("p_name").alias("title"), c("p_retailprice").alias("price"))
    return RD.parse_feed(feed_docs(spark, sf, row, True), "id string, title string, price double")


@query("src_07_read_platform_pages", sql("select '' || p_partkey as id, p_name as name, p_retailprice as price, case when p_size % 7 = 0 then 'outofstock' else 'instock' end as stock_status, 'https://shop.example/p' || p_partkey || '.html' as url from part"))
def read_platform_pages(spark, sf):
    k = c("p_partkey")
    row = F.struct(k.alias("id"), F.concat(F.lit("s"), k).alias("sku"), c("p_name").alias("name"), c("p_retailprice").alias("price"), F.array(F.struct(
        F.lit("url_key").alias("attribute_code"), F.concat(F.lit("p"), k).alias("value"))).alias("custom_attributes"),
        F.struct(F.struct((c("p_size") % 7 != 0).alias("is_in_stock")).alias("stock_item")).alias("extension_attributes"))
    docs = feed_docs(spark, sf, row, False).select(F.concat(F.lit('{"items":'), "body", F.lit("}")).alias("body"))
    return RD.platform_rows(docs, "magento", D.SHOP).select("id", "name", "price", "stock_status", "url")


@query("snk_01_write_report", sql("select query, searches, '2024-01' as period, 'r1' as report_id from funnel", "funnel"))
def write_report(spark, sf):
    rows = U.query_funnel(D.events(spark, sf)).select("query", "searches")
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    SK.write_report(rows, path, "r1", "2024-01")
    return spark.read.schema("query string, searches bigint, period string, report_id string").parquet(path)


@query("src_06_read_feed_csv", "select '' || p_partkey as id, p_name || ', \"new\"' as title, case when p_size % 3 = 0 then '' else 'a' || chr(10) || 'b' end as note from part")
def read_feed_csv(spark, sf):
    cell = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.when(c("p_size") % 3 == 0, "").otherwise("a\nb")
    line = F.concat_ws(",", c("p_partkey").cast("string"), cell(F.concat("p_name", F.lit(', "new"'))), cell(note))
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    # Every part file is a feed of its own: header, rows, a blank row.
    docs = D.table(spark, sf, "part").groupBy(F.floor(c("p_partkey") / 500).alias("f")).agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    docs.select(F.concat(F.lit("id,title,note\n"), "rows", F.lit("\n,,")).alias("value")).repartition(4).write.option("lineSep", "\n").text(path)
    return RD.read_feed_csv(spark, path).filter("id <> 'id'")


@query("snk_03_write_leads_csv", "select 'h' || c_custkey as host, '' || c_nationkey as score, c_name as title from customer")
def write_leads_csv(spark, sf):
    path = f"{shared_folder(spark)}/leads-{uuid.uuid4().hex}"
    SK.write_leads_csv(D.table(spark, sf, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("host"), c("c_nationkey").alias("score"), c("c_name").alias("title")), path)
    return RD.read_feed_csv(spark, path)
