"""Event reading, normalisation and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import numbers as N, text as X
from storelens.operators import attribution as A, events as E
from storelens.plans import demo as D
from storelens.plans.oracle import sql
from storelens.plans.registry import query

US = lambda c, name="t_us": F.unix_micros(c).alias(name)


@query("src_01_read_events", sql("""select event_id, event_type, epoch_us(t) as t_us, s from raw
    where t >= timestamp '2024-01-05' and t < timestamp '2024-01-20'""", "raw"))
def read_events(spark, sf):
    b = E.in_window(D.raw_base(spark, sf), "2024-01-05", "2024-01-20")
    return b.select("event_id", "event_type", US("t"), E.session_key(b).alias("s"))


@query("src_02_source_status", sql("""select source, case when source = 'wishlist' then 'missing' when source = 'cart' then 'unavailable' else 'ok' end as status,
    case when source in ('cart', 'wishlist') then 0 else n end as rows, false as truncated from (
    select 'queries' as source, (select count(*) from raw where event_type = 'view') as n union all
    select 'product_clicks', (select count(*) from raw where event_type = 'click') union all
    select 'cart', (select count(*) from raw where event_type = 'signup') union all
    select 'checkout_events', (select count(*) from raw where event_type in ('error', 'purchase')) union all select 'wishlist', 0)""", "raw"))
def source_status(spark, sf):
    return E.source_status(D.source_rows(spark, sf), D.SOURCES + ["wishlist"], failed=("cart",))


@query("src_03_union_sources", sql("""select s, count(*) as events, count(*) filter (event_type = 'click') as clicks
    from raw where event_type in ('click', 'signup') group by 1""", "raw"))
def union_sources(spark, sf):
    both = E.union_sources([D.raw_clicks(spark, sf), D.raw_carts(spark, sf).withColumn("c", F.lit(1))])
    return both.groupBy(E.session_key(both).alias("s")).agg(
        F.count("*").alias("events"), F.count_if(F.col("c").isNull()).alias("clicks"))


@query("src_04_latest_rows", sql("""select event_id, event_type, true as truncated from raw order by event_id desc limit 500""", "raw"))
def latest_rows(spark, sf):
    return E.latest_rows(D.raw_base(spark, sf).select("event_id", "event_type"), 500)


@query("prj_01_parse_event_time", sql("""select event_id, case when event_id % 7 = 6 then null
    when event_id % 7 = 5 then epoch_us(date_trunc('second', t)) else epoch_us(t) end as t_us from raw""", "raw"))
def parse_event_time(spark, sf):
    b = D.raw_base(spark, sf)
    raw = F.when(F.col("event_id") % 7 == 6, "yesterday").when(
        F.col("event_id") % 7 == 5, F.unix_seconds("t").cast("string")).otherwise(F.coalesce("timestamp", "created_at"))
    return b.select("event_id", US(N.parse_event_time(raw)))


@query("prj_02_session_key", sql("select event_id, s from raw", "raw"))
def session_key(spark, sf):
    b = D.raw_base(spark, sf)
    return b.select("event_id", E.session_key(b).alias("s"))


@query("prj_03_parse_number", """select o_orderkey, o_totalprice as amount, cast(null as double) as junk from orders""")
def parse_number(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select("o_orderkey", N.parse_number(F.format_number("o_totalprice", 2)).alias("amount"),
                    N.parse_number(F.col("o_orderpriority")).alias("junk"))


@query("prj_04_explicit_query", sql("select event_id, case when k % 3 = 0 then 'q' || (k % 20) else '' end as q from raw", "raw"))
def explicit_query(spark, sf):
    b = D.raw_base(spark, sf)
    return b.select("event_id", E.explicit_query(b).alias("q"))


@query("prj_05_is_purchase", sql("""select event_id, event_type = 'purchase' and (event_id % 6 <> 0 or event_id % 12 = 0) as is_purchase
    from raw where event_type in ('error', 'purchase')""", "raw"))
def is_purchase(spark, sf):
    c = D.raw_checkouts(spark, sf)
    return c.select("event_id", E.is_purchase(c).alias("is_purchase"))


@query("prj_06_order_total", sql("select event_id, case when event_type = 'purchase' then value end as total from raw where event_type in ('error', 'purchase')", "raw"))
def order_total(spark, sf):
    c = D.raw_checkouts(spark, sf)
    return c.select("event_id", E.order_total(c).alias("total"))


@query("prj_07_order_currency", sql("""select event_id, case when user_id % 5 = 0 or user_id % 7 = 0 then null when user_id % 2 = 0 then 'ILS' else 'USD' end as currency
    from raw where event_type in ('error', 'purchase')""", "raw"))
def order_currency(spark, sf):
    c = D.raw_checkouts(spark, sf)
    return c.select("event_id", E.order_currency(c).alias("currency"))


@query("prj_08_to_query_events", sql("select event_id, q, s, epoch_us(t) as t_us, delivered, zero, array_to_string(names, '|') as names from search", "search"))
def to_query_events(spark, sf):
    return D.searches(spark, sf).select("event_id", "q", "s", US("t"), "delivered", "zero",
                                        F.array_join("names", "|").alias("names"))


@query("prj_09_to_product_events", sql("""select 'click' as kind, event_id, q, s, epoch_us(t) as t_us, product_id as pid, product_name as name, product_url as url from click
    union all select 'cart', event_id, q, s, epoch_us(t), product_id, product_name, product_url from cart""", "click", "cart"))
def to_product_events(spark, sf):
    return D.clicks(spark, sf).unionByName(D.carts(spark, sf)).select(
        "kind", "event_id", "q", "s", US("t"), "pid", "name", "url")


@query("prj_10_to_purchase_events", sql("""select event_id, q, s, epoch_us(t) as t_us, order_id, total, currency, event_id % 3 + 1 as lines,
    cast((event_id % 3 + 1) * (event_id % 3 + 2) / 2 as double) as quantity from purchase""", "purchase"))
def to_purchase_events(spark, sf):
    qty = F.aggregate("items", F.lit(0.0), lambda a, i: a + i["qty"])
    return D.purchases(spark, sf).select("event_id", "q", "s", US("t"), "order_id", "total", "currency",
                                         F.size("items").cast("bigint").alias("lines"), qty.alias("quantity"))


@query("prj_11_to_checkout_starts", sql("select event_id, q, s, epoch_us(t) as t_us from checkout", "checkout"))
def to_checkout_starts(spark, sf):
    return D.checkouts(spark, sf).select("event_id", "q", "s", US("t"))


@query("flt_01_in_window", sql("""select event_id, q from search where t >= timestamp '2024-01-03' and t < timestamp '2024-01-10'""", "search"))
def in_window(spark, sf):
    return E.in_window(D.searches(spark, sf), "2024-01-03", "2024-01-10").select("event_id", "q")


@query("joi_01_preceding_search", sql("""select e.kind, e.event_id, h.hit_q, epoch_us(h.hit_t) as hit_us
    from stage e left join hits h using (kind, event_id)""", "hits"))
def preceding_search(spark, sf):
    ev = D.events(spark, sf)
    out = A.preceding_search(ev.stages.select("event_id", "kind", "q", "s", "t"), ev.searches)
    return out.select("kind", "event_id", "hit_q", US("hit_t", "hit_us"))


@query("joi_02_searched_before", sql("""select e.kind, e.event_id, exists (select 1 from search x where x.s = e.s and x.q = e.q
    and x.t <= e.t and x.t >= e.t - interval 24 hour) as searched from stage e where e.q <> ''""", "stage", "search"))
def searched_before(spark, sf):
    ev = D.events(spark, sf)
    rows = ev.stages.select("event_id", "kind", "q", "s", "t").filter("q <> ''")
    return A.searched_before(rows, ev.searches, A.WINDOWS_24H).select("kind", "event_id", "searched")


@query("joi_02_searched_before_48h", sql("""select e.kind, e.event_id, exists (select 1 from search x where x.s = e.s and x.q = e.q
    and x.t <= e.t and x.t >= e.t - interval 48 hour) as searched from stage e where e.q <> ''""", "stage", "search"))
def searched_before_48h(spark, sf):
    ev = D.events(spark, sf)
    rows = ev.stages.select("event_id", "kind", "q", "s", "t").filter("q <> ''")
    return A.searched_before(rows, ev.searches, {k: 2880 * A.MINUTE_US for k in A.WINDOWS}).select("kind", "event_id", "searched")


@query("joi_03_attribute", sql("select kind, event_id, aq, how, searched from attr", "attr"))
def attribute(spark, sf):
    return D.events(spark, sf).attributed().select("kind", "event_id", "aq", "how", "searched")


@query("win_01_unique_purchases", sql("select event_id, order_id, total, copies from orders_", "orders_"))
def unique_purchases(spark, sf):
    return A.unique_purchases(D.purchases(spark, sf)).select("event_id", "order_id", "total", "copies")


@query("win_02_last_search_frame", sql("""select e.event_id, arg_max(x.event_id, (x.t, -x.event_id)) as search_id
    from click e join search x on e.s = x.s and x.t <= e.t and x.t >= e.t - interval 24 hour group by 1""", "click", "search"))
def last_search_frame(spark, sf):
    found = A.as_of(D.clicks(spark, sf), D.searches(spark, sf), ["s"], F.lit(A.WINDOWS_24H["click"]), ["event_id"])
    return found.filter("hit is not null").select("event_id", F.col("hit.event_id").alias("search_id"))


@query("set_01_all_sessions", sql("select distinct s from (select s from search union all select s from stage) where s is not null", "search", "stage"))
def all_sessions(spark, sf):
    ev = D.events(spark, sf)
    return A.all_sessions(ev.searches, ev.clicks, ev.carts, ev.checkouts, ev.orders)


@query("fn_01_query_key", """select doc_id, sha256(lower(trim(regexp_replace(text, '[\\s\\p{Z}\\x{FEFF}]+', ' ', 'g')))) as key_hash from documents""")
def query_key(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(X.query_key(F.col("text")), 256).alias("key_hash"))


@query("fn_24_wilson", sql("""select query, k, n, case when n > 0 then round(greatest(0, c - h), 9) end as lo, case when n > 0 then round(least(1, c + h), 9) end as hi
    from (select *, 1.95996398454::double * sqrt(p * (1 - p) / n + 3.8414588206941285::double / (4 * n * n)) / d as h, (p + 3.8414588206941285::double / (2 * n)) / d as c
    from (select query, click_sessions as k, search_sessions as n, click_sessions / search_sessions as p, 1 + 3.8414588206941285::double / search_sessions as d from funnel))""", "funnel"))
def wilson(spark, sf):
    from storelens.operators.funnel import query_funnel
    f = query_funnel(D.events(spark, sf)).select("query", F.col("click_sessions").alias("k"), F.col("search_sessions").alias("n"))
    w = f.withColumn("w", N.wilson(F.col("k"), F.col("n")))
    return w.select("query", "k", "n", F.round("w.lo", 9).alias("lo"), F.round("w.hi", 9).alias("hi"))


@query("fn_25_two_proportion_z", """with g as (select l_suppkey as k, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as x1, count(*) filter (l_linestatus = 'O') as n1,
    count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as x2, count(*) filter (l_linestatus = 'F') as n2 from lineitem group by 1),
    h as (select *, x1 / n1 as p1, x2 / n2 as p2, (x1 + x2) / (n1 + n2) as p from g),
    i as (select *, sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) as se from h)
    select k, round((p1 - p2) / p2, 9) as lift, round((p1 - p2) / se, 9) as z, coalesce(abs((p1 - p2) / se) >= 1.96, false) as significant from i""")
def two_proportion_z(spark, sf):
    o, r = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    g = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.count_if(r & o).alias("x1"), F.count_if(o).alias("n1"), F.count_if(r & ~o).alias("x2"), F.count_if(~o).alias("n2"))
    z = g.withColumn("z", N.two_proportion_z(*[F.col(c) for c in ("x1", "n1", "x2", "n2")]))
    return z.select("k", F.round("z.lift", 9).alias("lift"), F.round("z.z", 9).alias("z"), F.col("z.significant"))


@query("fn_27_rollout_bucket", """select c_custkey, cast(('0x' || substr(sha1(c_name), 1, 8))::bigint % 100 as integer) as bucket from customer""")
def rollout_bucket(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", N.rollout_bucket(F.col("c_name")).alias("bucket"))


@query("fn_28_week_start", sql("select epoch_us(cast(date_trunc('week', t) as timestamp)) as week_us, count(*) as n from raw group by 1", "raw"))
def week_start(spark, sf):
    return D.raw_base(spark, sf).groupBy(US(N.week_start(F.col("t")), "week_us")).agg(F.count("*").alias("n"))


@query("fn_30_local_day", sql("""select strftime(timezone('Asia/Jerusalem', timezone('UTC', t)), '%Y-%m-%d') as day, count(*) as n from raw group by 1""", "raw"))
def local_day(spark, sf):
    return D.raw_base(spark, sf).groupBy(N.local_day(F.col("t"), "Asia/Jerusalem").alias("day")).agg(F.count("*").alias("n"))


@query("fn_10_minor_units", "select o_orderkey, round(cast(floor(o_totalprice * 100 + 0.5) as bigint) / 100.0::double, 2) as price from orders")
def minor_units(spark, sf):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("string")
    return D.table(spark, sf, "orders").select("o_orderkey", F.round(N.minor_units(cents, F.lit(None).cast("int")), 2).alias("price"))


@query("fn_26_fingerprint", """select p_partkey, sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}') as fingerprint from part""")
def fingerprint(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", N.fingerprint(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("fingerprint"))
