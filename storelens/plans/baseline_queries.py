"""Chosen products, baselines, audits and tracking issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import baseline as B, classify as C, funnel as U
from storelens.plans import demo as D
from storelens.plans.oracle import CTES, sql
from storelens.plans.registry import query

CTES["picked_raw"] = ("""select a.aq as query, case a.kind when 'click' then 0 when 'cart' then 1 else 2 end as kno, a.event_id, a.t,
    0 as line, c.product_id as pid, c.product_name as name, c.product_url as url, c.pid as target
    from attr a join tagged c on c.event_id = a.event_id where a.aq is not null and a.kind in ('click', 'cart')
    union all select a.aq, 2, a.event_id, a.t, i, '' || ((a.event_id * 7 + i * 13) % 2100), 'Item ' || ((a.event_id * 7 + i * 13) % 2100),
    '', (a.event_id * 7 + i * 13) % 2100 from attr a, (select unnest([0, 1, 2]) as i) x
    where a.aq is not null and a.kind = 'purchase' and i <= a.event_id % 3""", ("attr", "tagged"))
CTES["tally"] = ("""select query, case when pid <> '' then pid else name end as key, count(*) filter (kno = 0) as clicks,
    count(*) filter (kno = 1) as carts, count(*) filter (kno = 2) as purchases, arg_min(target, (kno, t, event_id, line)) as target,
    arg_min(url, (kno, t, event_id, line)) as url,
    coalesce(arg_min(name, (kno, t, event_id, line)) filter (name <> ''), '') as name
    from picked_raw where pid <> '' or name <> '' group by 1, 2""", ("picked_raw",))
CTES["matched"] = ("""select y.*, p.id as product_id, coalesce(not p.hidden and p.stock_status = 'instock', false) as available,
    p.id is not null as known from tally y left join product p on p.p_partkey = y.target""", ("tally", "product"))
CTES["match_rate"] = ("""select sum(clicks + carts + purchases) filter (known) / sum(clicks + carts + purchases) as match_rate from matched""", ("matched",))
CTES["pick"] = ("""select *, case when known then not available else (select match_rate >= 0.9 from match_rate) end as gone from (
    select *, row_number() over (partition by query order by purchases desc, carts desc, clicks desc, key) as rank from (
    select *, sum(clicks) over (partition by query) as total_clicks from matched)
    where carts > 0 or purchases > 0 or (clicks >= 3 and (total_clicks = 0 or clicks / total_clicks >= 0.1))) where rank <= 8""",
                ("matched", "match_rate"))
CTES["base"] = ("""select f.query, f.searches, f.zero_rate, f.clicks, f.carts, f.purchases,
    case when coalesce(picked, 0) > 0 then 'works' when coalesce(f.zero_rate, 0) >= 0.5 or (f.searches >= 5 and coalesce(total, 0) = 0) then 'fails' else 'unclear' end as production,
    coalesce(n_targets, 0) as n_targets, coalesce(n_gone, 0) as n_gone, coalesce(gone_clicks, 0) as gone_clicks, coalesce(picked_clicks, 0) as picked_clicks,
    coalesce(targets, '') as targets, coalesce(unavailable, '') as unavailable
    from classified f left join (select query, count(*) as picked, count(*) filter (not gone) as n_targets, count(*) filter (gone) as n_gone,
      cast(coalesce(sum(clicks + carts) filter (gone), 0) as bigint) as gone_clicks, cast(sum(clicks + carts) as bigint) as picked_clicks,
      string_agg(key, '|' order by rank) filter (not gone) as targets, string_agg(key, '|' order by rank) filter (gone) as unavailable from pick group by 1) p using (query)
    left join (select query, sum(clicks) as total from tally group by 1) c using (query) where greatest(f.searches, f.clicks) >= 3""", ("classified", "pick", "tally"))
CTES["baseline"] = ("select *, case when production = 'works' and n_targets = 0 then 'gap' else production end as status from base", ("base",))


def tallies(spark, sf):
    return D.report(spark, sf).tallies


@query("joi_04_match_catalog", sql("""select t.event_id, p.id as product_id, coalesce(not p.hidden and p.stock_status = 'instock', false) as available
    from tagged t left join product p on p.p_partkey = t.pid where (event_type = 'click') or (event_type = 'signup' and event_id % 17 <> 0)""", "tagged", "product"))
def match_catalog(spark, sf):
    ev = D.clicks(spark, sf).unionByName(D.carts(spark, sf)).select("event_id", "pid", "name", "url")
    return B.match_catalog(ev, D.products(spark, sf)).select(
        "event_id", F.col("product.id").alias("product_id"), F.coalesce("product.available", F.lit(False)).alias("available"))


@query("joi_05_match_by_url_or_title", sql("""select t.event_id, p.id as product_id from tagged t left join product p on p.p_partkey = t.pid and t.event_id % 5 in (3, 4)
    where event_type = 'click'""", "tagged", "product"))
def match_by_url_or_title(spark, sf):
    m = B.match_by_url_or_title(D.clicks(spark, sf), D.products(spark, sf))
    return m.select("event_id", F.col("card.id").alias("product_id"))


@query("joi_06_lookup_first", """select page_id, case when page_id % 3 = 2 then null else p.id end as product_id
    from pages left join (select '' || p_partkey as id, p_partkey from part) p on p.p_partkey = page_id""")
def lookup_first(spark, sf):
    i = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/collections/all/products/item-"), i, F.lit("/?a=b"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.shop.example/products/item-"), i)).otherwise(
        F.concat(F.lit("https://other.example/products/item-"), i))
    links = D.table(spark, sf, "pages").select("page_id", href.alias("href"))
    return B.lookup_first(links, D.products(spark, sf), D.SHOP).select("page_id", "product_id")


@query("agg_12_chosen_products", sql("select query, key, clicks, carts, purchases, url, name from tally", "tally"))
def chosen_products(spark, sf):
    return tallies(spark, sf).select("query", "key", "clicks", "carts", "purchases", "url", "name")


@query("agg_13_catalog_match_rate", sql("select match_rate from match_rate", "match_rate"))
def catalog_match_rate(spark, sf):
    return B.catalog_match_rate(B.match_catalog(tallies(spark, sf), D.products(spark, sf)))


@query("win_03_click_share", sql("select query, key, clicks, clicks / nullif(sum(clicks) over (partition by query), 0) as share from tally", "tally"))
def click_share(spark, sf):
    return B.click_share(tallies(spark, sf)).select("query", "key", "clicks", "share")


@query("win_04_top_per_query", sql("""select query, key, rank from (select *, row_number() over (partition by query order by purchases desc, carts desc, clicks desc, key) as rank from tally) where rank <= 5""", "tally"))
def top_per_query(spark, sf):
    return B.top_per_query(tallies(spark, sf), 5).select("query", "key", "rank")


def _baseline(spark, sf):
    r = D.report(spark, sf)
    return r.rows, r.baseline


@query("agg_14_query_baseline", sql("select query, searches, clicks, production, status, n_targets, n_gone, targets, unavailable from baseline", "baseline"))
def query_baseline(spark, sf):
    join = lambda c: F.array_join(c, "|").alias(c)
    return _baseline(spark, sf)[1].select("query", "searches", "clicks", "production", "status", "n_targets", "n_gone", join("targets"), join("unavailable"))


@query("agg_14_baseline_summary", sql("""select count(*) as queries, count(*) filter (status = 'works') as works, count(*) filter (status = 'gap') as gaps,
    count(*) filter (status = 'fails') as fails, count(*) filter (status = 'unclear') as unclear,
    cast(coalesce(sum(searches) filter (status = 'works'), 0) as bigint) as searches_working, cast(coalesce(sum(searches) filter (status = 'fails'), 0) as bigint) as searches_failing,
    cast(coalesce(sum(searches) filter (status = 'gap'), 0) as bigint) as searches_in_gaps, count(*) filter (status = 'works' and n_gone > 0) as partial_gaps from baseline""", "baseline"))
def baseline_summary(spark, sf):
    return B.baseline_summary(_baseline(spark, sf)[1])


CTES["plog"] = ("""select c.q as key, c.pid, kind from (select *, 'click' as kind from click union all select *, 'cart' from cart) c where c.q <> '' and c.event_id % 5 = 3""", ("click", "cart"))
CTES["pper"] = ("""select *, sum(clicks) over (partition by key) as all_clicks from (select key, pid, count(*) filter (kind = 'click') as clicks, count(*) filter (kind = 'cart') as carts from plog group by 1, 2)""", ("plog",))
CTES["prod"] = ("""select key as query, key, searches, floor(zero / searches * 100 + 0.5) / 100 as production_zero_rate, coalesce(t.clicks, 0) as clicks, coalesce(t.carts, 0) as carts,
    case when coalesce(n_targets, 0) + coalesce(n_unavailable, 0) > 0 then 'works' when zero / searches >= 0.5 or (searches >= 5 and coalesce(t.clicks, 0) = 0) then 'fails' else 'unclear' end as production,
    coalesce(n_targets, 0) as n_targets, coalesce(n_unavailable, 0) as n_unavailable
    from (select q as key, count(*) as searches, count(*) filter (len(names) = 0) as zero from search group by 1 having count(*) >= 3) m
    left join (select key, cast(sum(clicks) as bigint) as clicks, cast(sum(carts) as bigint) as carts from pper group by 1) t using (key)
    left join (select key, count(*) filter (ok) as n_targets, count(*) filter (not ok) as n_unavailable from (
      select r.*, coalesce(not p.hidden and p.stock_status = 'instock', false) as ok from (
        select *, row_number() over (partition by key order by carts desc, clicks desc, 'item-' || pid) as rank from pper
        where (carts > 0 or clicks >= 3) and (all_clicks = 0 or clicks / all_clicks >= 0.1 or carts > 0)) r left join product p on p.p_partkey = r.pid where rank <= 8) group by 1) k using (key)""",
                ("search", "pper", "product"))


def production(spark, sf):
    qs = D.searches(spark, sf).select(F.col("q").alias("key"), F.col("q").alias("form"), "event_id", F.col("names").alias("delivered"))
    log = lambda df: df.filter("q <> '' and url <> ''").select(F.col("q").alias("key"), "url", "name")
    return B.production_baseline(qs, log(D.clicks(spark, sf)), log(D.carts(spark, sf)), D.products(spark, sf))


@query("agg_15_production_baseline", sql("select * from prod", "prod"))
def production_baseline(spark, sf):
    return production(spark, sf).drop("production_top")


@query("agg_16_popularity", sql("""select p.id, cast(sum(case when event_type = 'click' then 1 else 3 end) as bigint) as popularity from tagged t join product p on p.p_partkey = t.pid
    where t.event_id % 5 = 3 and (event_type = 'click' or (event_type = 'signup' and event_id % 17 <> 0)) group by 1""", "tagged", "product"))
def popularity(spark, sf):
    return B.popularity(D.clicks(spark, sf), D.carts(spark, sf), D.products(spark, sf))


# Ranked results of the demo: the cards of one residue class, twenty ranks later with a shift.
def demo_results(spark, sf, shift=0):
    n = F.col("id").cast("int")
    rank = (F.floor(n / 200) * 10 + n % 10 + 1 + 20 * shift).cast("int")
    return D.products(spark, sf).select(F.concat(F.lit("q"), F.floor(n / 10) % 20).alias("query"),
                                        F.col("id").alias("product_id"), rank.alias("rank"))


CTES["result"] = ("select 'q' || (p_partkey // 10 % 20) as query, '' || p_partkey as product_id, (p_partkey // 200) * 10 + p_partkey % 10 + 1 as rank from part", ())
CTES["result2"] = ("select 'q' || (p_partkey // 10 % 20) as query, '' || p_partkey as product_id, (p_partkey // 200) * 10 + p_partkey % 10 + 21 as rank from part", ())


def evaluation(spark, sf, shift=0):
    base = D.searches(spark, sf).groupBy(F.col("q").alias("query")).agg(F.count("*").alias("searches")).withColumn(
        "production", F.when(F.col("query") == "q3", "fails").otherwise("works"))
    n = F.col("id").cast("int")
    targets = D.products(spark, sf).filter(n % 7 == 0).select(F.concat(F.lit("q"), F.floor(n / 10) % 20).alias("query"), F.col("id").alias("product_id"))
    return B.evaluate_baseline(base, targets, demo_results(spark, sf, shift), D.products(spark, sf))


def _evaluated(result):
    return f"""select b.query, b.searches, b.production, case when b.production = 'works' and coalesce(targets, 0) = 0 then 'gap' when b.production = 'works' and found = targets then 'kept'
    when b.production = 'works' and found > 0 then 'partial' when b.production = 'works' then 'lost' when coalesce(total, 0) > 0 then 'answers' else 'empty' end as status,
    coalesce(total, 0) as total, coalesce(targets, 0) as targets, coalesce(found, 0) as found, coalesce(unavailable_now, 0) as unavailable_now, best_rank
    from (select q as query, count(*) as searches, case when q = 'q3' then 'fails' else 'works' end as production from search group by q) b
    left join (select query, count(*) filter (ok) as targets, count(*) filter (ok and rank is not null) as found, count(*) filter (not ok) as unavailable_now, min(rank) filter (ok) as best_rank
      from (select 'q' || (p_partkey // 10 % 20) as query, id as product_id, not hidden and stock_status = 'instock' as ok from product where p_partkey % 7 = 0) t
      left join (select * from {result} where rank <= 24) r using (query, product_id) group by 1) x using (query)
    left join (select query, count(*) as total from {result} group by 1) z using (query)"""


CTES["evaluated"] = (_evaluated("result"), ("search", "product", "result"))
CTES["evaluated2"] = (_evaluated("result2"), ("search", "product", "result2"))


@query("agg_17_evaluate_baseline", sql("select * from evaluated", "evaluated"))
def evaluate_baseline(spark, sf):
    return evaluation(spark, sf)


@query("agg_17_evaluation_summary", sql("""select floor(coalesce(sum(searches) filter (status = 'kept'), 0) / sum(searches) filter (production = 'works' and status <> 'gap') * 1000 + 0.5) / 1000 as kept_share,
    count(*) filter (status = 'kept') as kept, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'lost') as lost, count(*) filter (status = 'gap') as gap,
    count(*) filter (production = 'fails') as production_fails, count(*) filter (production = 'fails' and status = 'answers') as fails_we_answer from evaluated""", "evaluated"))
def evaluation_summary(spark, sf):
    return B.evaluation_summary(evaluation(spark, sf))


RANK = "case {} when 'kept' then 2 when 'partial' then 1 when 'lost' then 0 end"


@query("agg_18_baseline_regressions", sql(f"""select a.query, a.searches, b.status as was, a.status as now from evaluated2 a join evaluated b using (query)
    where a.production = 'works' and {RANK.format('a.status')} < {RANK.format('b.status')}""", "evaluated", "evaluated2"))
def baseline_regressions(spark, sf):
    return B.baseline_regressions(evaluation(spark, sf), evaluation(spark, sf, 1))


@query("agg_36_clicked_products", sql("""select coalesce(p.id, case when t.event_id % 5 = 4 then 'item ' || t.pid when t.event_id % 5 = 3 then 'item-' || t.pid else '' end) as product,
    p.id is not null as in_catalog, coalesce(not p.hidden and p.stock_status = 'instock', false) as visible, count(*) as clicks
    from click t left join product p on p.p_partkey = t.pid and t.event_id % 5 in (3, 4) where contains(q, 'q1') group by 1, 2, 3""", "click", "product"))
def clicked_products(spark, sf):
    return B.clicked_products(D.clicks(spark, sf), D.products(spark, sf), ["q1"])


@query("cls_04_catalog_gap", sql("""select query, case when status = 'gap' or (picked_clicks > 0 and gone_clicks / picked_clicks >= 0.6) then 'catalog_gap'
    when search_sessions < 5 and leak_stage <> 'zero_results' then 'unmeasured' else 'search_problem' end as classification from baseline join classified using (query)""", "baseline", "classified"))
def catalog_gap(spark, sf):
    rows, base = _baseline(spark, sf)
    j = base.join(rows.select("query", "search_sessions", "leak_stage"), "query")
    c = F.col
    return j.select("query", C.catalog_gap(c("gone_clicks"), c("picked_clicks"), c("status"), c("search_sessions"),
                                           c("leak_stage") == "zero_results").alias("classification"))


ASKED = ["q1", "q12", "q7"]
IN = "('q1', 'q12', 'q7')"


def asked(spark):
    return spark.createDataFrame([(q,) for q in ASKED], "query string")


@query("cls_05_query_evidence", sql(f"""select query, floor(sum(clicks + carts) filter (not available) / sum(clicks + carts) * 100 + 0.5) / 100 as gap_share, count(*) as products
    from (select *, row_number() over (partition by query order by purchases desc, carts desc, clicks desc, key) as rank from matched where query in {IN}) where rank <= 15 group by 1""", "matched"))
def query_evidence(spark, sf):
    return B.gap_share(tallies(spark, sf), D.products(spark, sf), asked(spark))


@query("cls_05_searches_per_day", sql(f"select q as query, strftime(t, '%Y-%m-%d') as day, count(*) as searches from search where q in {IN} group by 1, 2", "search"))
def searches_per_day(spark, sf):
    return B.searches_per_day(D.searches(spark, sf), asked(spark))


@query("cls_05_results_shown", sql(f"""select query, array_to_string(lst, '|') as names, searches, rank from (select *, row_number() over (partition by query order by searches desc, lst) as rank from (
    select q as query, names[1:5] as lst, count(*) as searches from search where q in {IN} and len(names) > 0 group by 1, 2)) where rank <= 3""", "search"))
def results_shown(spark, sf):
    return B.results_shown(D.searches(spark, sf), asked(spark)).withColumn("names", F.array_join("names", "|"))


@query("cls_05_related_queries", sql(f"""select * from (select f.query, f.searches, a.asked, row_number() over (partition by a.asked order by f.searches desc, f.query) as rank
    from funnel f, (select unnest(['q1', 'q12', 'q7']) as asked) a where f.query <> a.asked and (contains(f.query, a.asked) or contains(a.asked, f.query))) where rank <= 8""", "funnel"))
def related_queries(spark, sf):
    return B.related_queries(D.report(spark, sf).rows, asked(spark)).select("query", "searches", "asked", "rank")


@query("cls_05_related_to_every_query", sql("""select * from (select f.query, f.searches, a.query as asked, row_number() over (partition by a.query order by f.searches desc, f.query) as rank
    from funnel f, funnel a where f.query <> a.query and (contains(f.query, a.query) or contains(a.query, f.query))) where rank <= 8""", "funnel"))
def related_to_every_query(spark, sf):
    rows = D.report(spark, sf).rows
    return B.related_queries(rows, rows).select("query", "searches", "asked", "rank")


CTES["audit"] = ("""select l.*, row_number() over (partition by no order by by_ desc, query) as round from (
    select 0 as no, 'zero_results' as reason, query, searches as by_ from classified where leak_stage = 'zero_results' union all
    select 1, 'no_click', query, search_sessions from classified where leak_stage = 'no_click' or (search_sessions >= 5 and clicks = 0 and coalesce(zero_rate, 0) < 0.5) union all
    select 2, 'click_no_cart', query, sessions_below_average from classified where leak_stage = 'click_no_cart' union all
    select 3, 'cart_no_purchase', query, sessions_below_average from classified where leak_stage = 'cart_no_purchase' union all
    select 4, 'production_fails', query, searches from baseline where status = 'fails' union all
    select 5, 'catalog_gap', query, searches from baseline where status = 'gap' or n_gone > 0 union all
    select 6, 'top', query, searches from classified) l""", ("classified", "baseline"))


@query("srt_02_audit_candidates", sql("""select query, position, string_agg(reason, '|' order by round, no) as reasons from (
    select a.query, a.reason, a.round, a.no, p.position from audit a join (select query, row_number() over (order by r, n) as position, max(r) over () as stop from (
      select query, min(round) as r, arg_min(no, (round, no)) as n from audit group by 1 order by r, n limit 8)) p on p.query = a.query where a.round <= p.stop) group by 1, 2""", "audit"))
def audit_candidates(spark, sf):
    return D.report(spark, sf).audit(8).select("query", "position", F.array_join("reasons", "|").alias("reasons"))


@query("agg_22_tracking_issues", sql("""select * from (
    select 'source_wishlist' as code, 'warning' as severity, 0::double as a, cast(null as double) as b union all
    select 'truncated_cart', 'warning', (select count(*) from raw where event_type = 'signup'), null union all
    select 'catalog_id_mismatch', 'warning', (select match_rate from match_rate), null where (select match_rate from match_rate) < 0.9 union all
    select 'purchases_missing_currency', 'info', (select count(*) from orders_), null union all
    select 'experiment_starved', 'warning', 1, (select count(*) from search) union all
    select 'duplicate_orders', 'info', (select count(*) from purchase) - (select count(*) from orders_), null union all
    select 'search_log_gap', 'warning', n, null from (select count(*) as n from (select cast(timezone('Asia/Jerusalem', timezone('UTC', t)) as date) as d,
        count(*) filter (kind = 'search') as x, count(*) filter (kind in ('click', 'cart')) as y from (select t, 'search' as kind from search union all select t, kind from stage) group by 1)
        where x = 0 and y > 0) where n > 0 union all
    select 'synthetic_query', 'warning', search_sessions, null from funnel where search_sessions >= (select searched from store) * 0.1 and coalesce(click_rate, 0) < 0.01 and coalesce(cart_rate, 0) < 0.05)""",
       "raw", "match_rate", "orders_", "purchase", "search", "stage", "funnel", "store"))
def tracking_issues(spark, sf):
    from storelens.operators import events as E
    ev = D.events(spark, sf)
    ev.sources = E.source_status(D.source_rows(spark, sf).withColumn("truncated", F.col("source") == "cart"), D.SOURCES + ["wishlist"])
    funnel = U.store_funnel(ev)
    synthetic = C.suspected_synthetic(U.query_funnel(ev), ev.searches, min_sessions=100, share=0.1, click=0.01, cart=0.05)
    experiments = spark.createDataFrame([("e1", True, 3), ("e2", False, 0)], "name string, started boolean, exposures bigint")
    rate = B.catalog_match_rate(B.match_catalog(B.chosen_products(ev), D.products(spark, sf)))
    return B.tracking_issues(U.coverage(ev), funnel, U.order_assistance(ev), ev.sources, U.daily_activity(ev),
                             U.revenue_by_currency(ev), synthetic, experiments, rate)
