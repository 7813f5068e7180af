"""Funnel, coverage, activity and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import attribution as A, classify as C, funnel as U
from storelens.plans import demo as D
from storelens.plans.oracle import sql
from storelens.plans.registry import query

COUNTS = """query, searches, search_sessions, missing_session, zero_searches, measured_searches, clicks, carts, checkouts,
    purchases, explicit_purchases, inferred_purchases, click_sessions, cart_sessions, checkout_sessions, purchase_sessions"""
RATES = "zero_rate, click_rate, cart_rate, purchase_rate"


def flat(df):
    return df.withColumn("delivered", F.array_join("delivered", "|")).drop("attributed_revenue")


@query("agg_01_store_funnel", sql("select * from store_rates", "store_rates"))
def store_funnel(spark, sf):
    return U.store_funnel(D.events(spark, sf))


@query("agg_01_store_funnel_24h", sql("select * from store_rates", "store_rates").replace("30 as w", "1440 as w").replace("null, 120 from", "null, 1440 from"))
def store_funnel_24h(spark, sf):
    return U.store_funnel(D.events(spark, sf), A.WINDOWS_24H)


VIA = """via as (select o.*, case when o.q <> '' then 'explicit' when h.hit_q is not null then 'inferred' end as via
    from orders_ o left join hits h on h.kind = 'purchase' and h.event_id = o.event_id)"""


@query("agg_02_order_assistance", sql(f"""select count(*) as orders, coalesce(cast(sum(copies - 1) as bigint), 0) as duplicates, count(via) as search_assisted,
    count(*) filter (via = 'explicit') as explicit, count(*) filter (via = 'inferred') as inferred, count(s) as with_session
    from ({VIA[8:-1]}) x""", "orders_", "hits"))
def order_assistance(spark, sf):
    return U.order_assistance(D.events(spark, sf))


@query("agg_03_revenue_by_currency", sql(f"""select scope, coalesce(currency, '—') as currency, floor(sum(total) * 100 + 0.5) / 100 as amount, count(*) as orders,
    floor((floor(sum(total) * 100 + 0.5) / 100) / count(*) * 100 + 0.5) / 100 as average_order
    from (select 'total' as scope, * from ({VIA[8:-1]}) x union all select 'search_assisted', * from ({VIA[8:-1]}) y where via is not null) z
    where total is not null group by 1, 2""", "orders_", "hits"))
def revenue_by_currency(spark, sf):
    return U.revenue_by_currency(D.events(spark, sf))


@query("agg_04_cart_session_purchase_rate", sql("""select count(*) filter (searched) as with_search_sessions, count(*) filter (not searched) as without_search_sessions,
    count(*) filter (searched and bought) / nullif(count(*) filter (searched), 0) as with_search,
    count(*) filter (not searched and bought) / nullif(count(*) filter (not searched), 0) as without_search
    from (select s, s in (select s from search where s is not null) as searched, s in (select s from orders_ where s is not null) as bought from (select distinct s from cart where s is not null) c) d""", "cart", "search", "orders_"))
def cart_session_purchase_rate(spark, sf):
    return U.cart_session_purchase_rate(D.events(spark, sf))


@query("agg_05_coverage", sql("""select (select count(*) from search) as queries, (select count(s) from search) as queries_with_session,
    (select count(zero) from search) as queries_with_result_count, (select count(*) from click) as clicks,
    (select count(*) from click where q <> '') as clicks_tagged, (select count(*) from cart) as carts,
    (select count(*) from cart where q <> '') as carts_tagged, (select count(*) from orders_) as purchases,
    (select count(*) from orders_ where q <> '') as purchases_tagged, (select count(s) from orders_) as purchases_with_session,
    true as checkout_tracking, true as purchase_tracking,
    (select count(*) filter (s in (select s from click where s is not null union select s from cart where s is not null)) / count(*)
     from (select distinct s from orders_ where s is not null) b) as purchase_sessions_seen_before""", "search", "click", "cart", "orders_"))
def coverage(spark, sf):
    return U.coverage(D.events(spark, sf))


@query("agg_06_query_funnel", sql(f"select {COUNTS}, {RATES}, array_to_string(delivered, '|') as delivered from funnel", "funnel"))
def query_funnel(spark, sf):
    return flat(U.query_funnel(D.events(spark, sf)))


@query("agg_06_query_funnel_24h", sql(f"select {COUNTS}, {RATES} from funnel", "funnel").replace("30 as w", "1440 as w").replace("null, 120 from", "null, 1440 from"))
def query_funnel_24h(spark, sf):
    return flat(U.query_funnel(D.events(spark, sf), A.WINDOWS_24H)).drop("delivered")


@query("agg_06_attributed_revenue", sql("""select aq as query, coalesce(currency, '—') as currency, floor(sum(total) * 100 + 0.5) / 100 as amount, count(*) as orders
    from attr where kind = 'purchase' and aq is not null group by 1, 2""", "attr"))
def attributed_revenue(spark, sf):
    rows = U.query_funnel(D.events(spark, sf)).select("query", F.explode("attributed_revenue").alias("r"))
    return rows.select("query", F.coalesce("r.currency", F.lit("—")).alias("currency"), "r.amount", "r.orders")


@query("agg_07_latest_delivered", sql("select query, array_to_string(delivered, '|') as delivered from per_search where delivered is not null", "per_search"))
def latest_delivered(spark, sf):
    return U.latest_delivered(D.searches(spark, sf)).select("query", F.array_join("delivered", "|").alias("delivered"))


@query("agg_08_measured_conversion", sql(f"""select {COUNTS}, zero_rate,
    case when (searches - missing_session) / searches >= 0.7 then click_rate end as click_rate,
    case when (searches - missing_session) / searches >= 0.7 then cart_rate end as cart_rate,
    case when (searches - missing_session) / searches >= 0.7 then purchase_rate end as purchase_rate from funnel""", "funnel"))
def measured_conversion(spark, sf):
    return flat(U.measured_conversion(D.events(spark, sf))[1]).drop("delivered")


@query("agg_08_measured_incomplete", sql(f"""select {COUNTS}, zero_rate, cast(null as double) as click_rate,
    case when (searches - missing_session) / searches >= 0.7 then cart_rate end as cart_rate,
    case when (searches - missing_session) / searches >= 0.7 then purchase_rate end as purchase_rate from funnel""", "funnel"))
def measured_incomplete(spark, sf):
    ev = D.events(spark, sf)
    ev.sources = ev.sources.withColumn("truncated", F.col("source") == "product_clicks")
    return flat(U.measured_conversion(ev)[1]).drop("delivered")


@query("agg_09_customer_report", sql("""select query, searches, search_sessions, clicks, carts, purchases, explicit_purchases, inferred_purchases,
    purchase_sessions as converted_sessions, zero_searches as zero_results, measured_searches as measured_results, click_rate, cart_rate, purchase_rate from funnel""", "funnel")
    .replace("30 as w", "1440 as w").replace("null, 120 from", "null, 1440 from"))
def customer_report(spark, sf):
    return U.customer_report(D.events(spark, sf), A.WINDOWS_24H)


@query("agg_10_product_totals", sql("""select id, clicks, carts, purchases, title, p.name is not null as in_catalog,
    coalesce(not hidden and stock_status = 'instock', false) as available from (
    select id, count(*) filter (kind = 'click') as clicks, count(*) filter (kind = 'cart') as carts, count(*) filter (kind = 'purchase') as purchases from (
      select 'click' as kind, product_id as id from click union all select 'cart', product_id from cart union all
      select 'purchase', '' || ((event_id * 7 + i * 13) % 2100) from orders_, (select unnest([0, 1, 2]) as i) x where i <= event_id % 3) u
    where id <> '' group by 1) t left join product p using (id)""", "click", "cart", "orders_", "product"))
def product_totals(spark, sf):
    return U.product_totals(D.events(spark, sf), D.products(spark, sf))


@query("agg_11_products_of", sql("""select case when product_id <> '' then product_id else product_name end as product, count(*) as events,
    coalesce(arg_min(product_name, (t, event_id)) filter (product_name <> ''), '') as name,
    coalesce(arg_min(product_url, (t, event_id)) filter (product_url <> ''), '') as url
    from click where product_id <> '' or product_name <> '' group by 1""", "click"))
def products_of(spark, sf):
    return U.products_of(D.clicks(spark, sf))


DAYS = """select strftime(timezone('{tz}', timezone('UTC', t)), '%Y-%m-%d') as day, count(*) filter (kind = 'search') as searches,
    count(*) filter (kind = 'click') as clicks, count(*) filter (kind = 'cart') as carts, count(*) filter (kind = 'checkout') as checkouts,
    count(*) filter (kind = 'purchase') as purchases from (select t, 'search' as kind from search union all select t, kind from stage) group by 1"""


@query("agg_19_daily_activity", sql(f"""select *, searches = 0 and clicks + carts > 0 as search_log_gap, searches >= 10 and clicks + carts = 0 as tracking_gap
    from ({DAYS.format(tz='Asia/Jerusalem')})""", "search", "stage"))
def daily_activity(spark, sf):
    return U.daily_activity(D.events(spark, sf))


@query("agg_20_shopper_activity", sql("""select query, count(*) filter (kind = 'search') as searches, count(distinct s) filter (kind = 'click') as click_sessions,
    count(*) filter (kind = 'click') as clicks, count(distinct s) filter (kind = 'cart') as cart_sessions, count(*) filter (kind = 'cart') as carts
    from (select q as query, coalesce(s, 'none') as s, 'search' as kind from search union all select q, coalesce(s, 'none'), kind from stage where kind in ('click', 'cart') and q <> '') group by 1""", "search", "stage"))
def shopper_activity(spark, sf):
    return U.shopper_activity(D.events(spark, sf))


@query("agg_20_logging_gap", sql(f"""select count(*) filter (clicks > 0) as click_days, count(*) filter (clicks > 0 and searches = 0) as silent_days,
    count(*) filter (clicks > 0) >= 2 and count(*) filter (clicks > 0 and searches = 0) >= ceil(count(*) filter (clicks > 0) / 2) as gap
    from ({DAYS.format(tz='UTC')})""", "search", "stage"))
def logging_gap(spark, sf):
    return U.logging_gap(D.events(spark, sf))


def zero_counters(spark, sf):
    return D.searches(spark, sf).filter("zero").groupBy(F.col("q").alias("query")).agg(
        F.count("*").alias("hits"), F.max("t").alias("last_seen"))


@query("agg_21_top_zero_searches", sql("""select query, hits from (select q as query, count(*) as hits, max(t) as last_seen from search where zero group by 1)
    where last_seen >= timestamp '2024-01-20' order by hits desc, query limit 15""", "search"))
def top_zero_searches(spark, sf):
    since = F.lit("2024-01-20").cast("timestamp")
    return U.top_zero_searches(zero_counters(spark, sf), since).select("query", "hits")


@query("agg_23_experiment_exposures", sql("""select 'exp' || i as experiment_id, (select count(*) from search where s is not null and event_id % 3 = i and t >= timestamp '2024-01-10') as exposures
    from (select unnest([0, 1, 2, 3]) as i)""", "search"))
def experiment_exposures(spark, sf):
    ex = D.searches(spark, sf).filter("s is not null").select(
        F.concat(F.lit("exp"), F.col("event_id") % 3).alias("experiment_id"), "t")
    running = spark.createDataFrame([(f"exp{i}",) for i in range(4)], "experiment_id string")
    return U.experiment_exposures(ex, running, F.lit("2024-01-10").cast("timestamp"))


def signals(spark, sf):
    raw = D.searches(spark, sf).select("q", "delivered", F.when(F.col("event_id") % 4 == 0, F.upper("q")).otherwise(F.col("q")).alias("form"))
    return U.query_signals(D.events(spark, sf), raw)


SIGNALS = """select coalesce(s.q, h.q) as key, coalesce(s.query, h.q) as query, coalesce(searches, 0) as searches, coalesce(measured_results, 0) as measured_results,
    coalesce(zero_results, 0) as zero_results, coalesce(carts, 0) as carts, coalesce(clicks, 0) as clicks
    from (select q, case when count(*) filter (event_id % 4 = 0) >= count(*) filter (event_id % 4 <> 0) then upper(q) else q end as query,
      count(*) as searches, count(zero) as measured_results, count(*) filter (zero) as zero_results from search group by q) s
    full join (select q, count(*) filter (kind = 'cart') as carts, count(*) filter (kind = 'click') as clicks from stage where kind in ('click', 'cart') and q <> '' group by q) h on s.q = h.q"""


@query("agg_24_query_signals", sql(SIGNALS, "search", "stage"))
def query_signals(spark, sf):
    return signals(spark, sf)


@query("agg_24_signal_lists", sql(f"""select key, query, list, score, rank from (select *, row_number() over (partition by list order by score desc, key) as rank from (
    select key, query, 'top' as list, searches as score from ({SIGNALS}) where searches > 0 union all
    select key, query, 'failed', zero_results from ({SIGNALS}) where zero_results > 0 union all
    select key, query, 'converting', carts from ({SIGNALS}) where carts > 0 union all
    select key, query, 'clicked', clicks from ({SIGNALS}) where clicks > 0 union all
    select key, query, 'no_clicks', searches from ({SIGNALS}) where searches >= 3 and clicks + carts = 0)) where rank <= 30""", "search", "stage"))
def signal_lists(spark, sf):
    return U.signal_lists(signals(spark, sf))


@query("agg_39_rule_trigger_counts", sql("""select 'rule' || (k % 7) as rule_id, count(*) as triggers from raw where cast(t as date) in (date '2024-01-15', date '2024-01-14') group by 1""", "raw"))
def rule_trigger_counts(spark, sf):
    daily = D.raw_base(spark, sf).groupBy(F.concat(F.lit("rule"), F.col("k") % 7).alias("rule_id"), F.to_date("t").alias("day")).agg(F.count("*").alias("n"))
    return U.rule_trigger_counts(daily, F.lit("2024-01-15").cast("date"))


@query("agg_40_latency_stats", sql("""select event_type, count(*) as samples, max(ms) as max, list_sort(list(ms))[cast(floor(count(*) / 2) as bigint) + 1] as median
    from (select event_type, cast(floor(value * 10) as bigint) as ms from raw) group by 1""", "raw"))
def latency_stats(spark, sf):
    checks = D.raw_base(spark, sf).select("event_type", F.floor(F.col("value") * 10).alias("ms"))
    return U.latency_stats(checks, ["event_type"], "ms")


@query("agg_44_report_digest", sql("""select query as q, searches as s, search_sessions as ss, zero_rate as zero, click_rate as click, cart_rate as cart, purchase_rate as buy
    from funnel order by searches desc, query limit 20""", "funnel"))
def report_digest(spark, sf):
    return U.report_digest(U.query_funnel(D.events(spark, sf)))


@query("srt_01_rank_queries", sql("""select query, search_sessions, purchase_rate from funnel where search_sessions >= 20 and coalesce(purchase_rate, cart_rate) is not null
    order by coalesce(purchase_rate, cart_rate), search_sessions desc, query limit 10""", "funnel"))
def rank_queries(spark, sf):
    return U.rank_queries(U.query_funnel(D.events(spark, sf)), "low_conversion", 10).select("query", "search_sessions", "purchase_rate")


@query("srt_01_drilldown", sql("select query, searches from funnel where contains(query, 'q1')", "funnel"))
def drilldown(spark, sf):
    return U.rank_queries(U.query_funnel(D.events(spark, sf)), query="q1").select("query", "searches")


@query("srt_05_compact_rows", sql("""select query, searches from (select query, searches, sum(length('{"query":"' || query || '","searches":' || searches || '}')) over (order by searches desc, query) as used from funnel) where used <= 300""", "funnel"))
def compact_rows(spark, sf):
    rows = U.query_funnel(D.events(spark, sf)).select("query", "searches")
    return U.compact_rows(rows, [F.col("searches").desc(), F.col("query")], 300)


@query("cls_01_classify_leaks", sql("""select query, searches, search_sessions, clicks, carts, purchases, zero_rate, click_rate, cart_rate, purchase_rate, leak_stage, sessions_below_average from classified""", "classified"))
def classify_leaks(spark, sf):
    return D.report(spark, sf).rows.select(
        "query", "searches", "search_sessions", "clicks", "carts", "purchases", "zero_rate", "click_rate", "cart_rate",
        "purchase_rate", "leak_stage", "sessions_below_average")


SYNTH = "search_sessions >= (select searched from store) * 0.1 and coalesce(click_rate, 0) < 0.01 and coalesce(cart_rate, 0) < 0.05"


@query("cls_02_suspected_synthetic", sql(f"select query, search_sessions from funnel where {SYNTH}", "funnel", "store"))
def suspected_synthetic(spark, sf):
    ev = D.events(spark, sf)
    return C.suspected_synthetic(U.query_funnel(ev), ev.searches, min_sessions=100, share=0.1, click=0.01, cart=0.05).select("query", "search_sessions")


@query("cls_03_exclude_synthetic", sql(f"""select * from (select count(distinct s) as searched, count(*) as searches from search where q not in (select query from funnel where {SYNTH}))""", "funnel", "store"))
def exclude_synthetic(spark, sf):
    ev = D.events(spark, sf)
    bad = C.suspected_synthetic(U.query_funnel(ev), ev.searches, min_sessions=100, share=0.1, click=0.01, cart=0.05)
    return C.exclude_synthetic(ev, bad).searches.groupBy("s").agg(F.count("*").alias("n")).agg(
        F.count("s").alias("searched"), F.coalesce(F.sum("n"), F.lit(0)).alias("searches"))
