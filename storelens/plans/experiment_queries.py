"""Experiments, rollout and weekly review."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import attribution as A, classify as C, events as E, experiments as X, funnel as U
from storelens.operators.baseline import chosen_products
from storelens.plans import baseline_queries  # noqa: F401  (shares its SQL fragments)
from storelens.plans import demo as D
from storelens.plans.oracle import CTES, sql
from storelens.plans.registry import query

ASKED = [f"q{i}" for i in range(0, 20, 2)]
ts = lambda v: F.lit(v).cast("timestamp")

CTES["exposure"] = ("""select event_id, q, s, t, case when s is not null and (cast(s as bigint) % 11 = 0) and event_id % 2 = 0 then 'v1' when cast(s as bigint) % 2 = 0 then 'control' else 'v1' end as arm,
    event_id % 3 = 0 as confirmed from search""", ("search",))
CTES["exposed"] = ("""select s, min(t) as t, arg_min(arm, (t, event_id)) as arm, arg_min(confirmed, (t, event_id)) as confirmed, min(arm) <> max(arm) as contaminated
    from exposure where s is not null and cast(substr(q, 2) as bigint) % 2 = 0 and t >= timestamp '2024-01-03' and t <= timestamp '2024-01-28' group by s""", ("exposure",))


def exposures(spark, sf):
    n = F.col("s").cast("bigint")
    arm = F.when((n % 11 == 0) & (F.col("event_id") % 2 == 0), "v1").when(n % 2 == 0, "control").otherwise("v1")
    feats = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("weekly-serp-v1"))).otherwise(F.array().cast("array<string>"))
    return D.searches(spark, sf).select("event_id", "q", "s", "t", arm.alias("arm"), feats.alias("features"))


@query("win_05_first_exposure", sql("""select s, epoch_us(min(t)) as t_us, arg_min(arm, (t, event_id)) as arm, min(arm) <> max(arm) as contaminated from exposure where s is not null group by s""", "exposure"))
def first_exposure(spark, sf):
    return X.first_exposure(exposures(spark, sf).filter("s is not null")).select("s", F.unix_micros("t").alias("t_us"), "arm", "contaminated")


def metrics(spark, sf):
    ev = D.events(spark, sf)
    return X.experiment_metrics(exposures(spark, sf), ev, ["control", "v1"], ASKED, ts("2024-01-03"), ts("2024-01-28"),
                                "purchase", True, A.WINDOWS_24H, feature="weekly-serp-v1")


CTES["hit24"] = ("""select o.s, o.t, coalesce(nullif(o.q, ''), (select arg_max(x.q, (x.t, -x.event_id)) from search x where x.s = o.s and x.t <= o.t and x.t >= o.t - interval 24 hour)) as aq from orders_ o where o.s is not null""", ("orders_", "search"))
CTES["arm"] = ("""select arm, count(*) as exposures, count(*) filter (mature) as sessions, count(*) - count(*) filter (mature) as pending,
    count(*) filter (mature and hit) as conversions, count(*) filter (mature and hit) / nullif(count(*) filter (mature), 0) as rate, count(*) filter (confirmed) as presentation_confirmed
    from (select e.*, t + interval 24 hour <= timestamp '2024-01-28' as mature, exists (select 1 from hit24 h where h.s = e.s and h.t >= e.t and h.t <= e.t + interval 24 hour
      and cast(substr(h.aq, 2) as bigint) % 2 = 0 and exists (select 1 from search x where x.s = h.s and x.q = h.aq and x.t <= h.t and x.t >= h.t - interval 24 hour)) as hit
      from exposed e where not contaminated) group by 1""", ("exposed", "hit24", "search"))
Z = "3.8414588206941285::double"
CTES["armw"] = (f"""select *, greatest(0, (rate + {Z} / (2 * sessions)) / (1 + {Z} / sessions) - 1.95996398454::double * sqrt(rate * (1 - rate) / sessions + {Z} / (4 * sessions * sessions)) / (1 + {Z} / sessions)) as lo,
    least(1, (rate + {Z} / (2 * sessions)) / (1 + {Z} / sessions) + 1.95996398454::double * sqrt(rate * (1 - rate) / sessions + {Z} / (4 * sessions * sessions)) / (1 + {Z} / sessions)) as hi from arm""", ("arm",))
r9 = lambda c: F.round(c, 9).alias(c)


@query("agg_30_experiment_metrics", sql("select arm, exposures, sessions, pending, conversions, rate, round(lo, 9) as lo, round(hi, 9) as hi, presentation_confirmed from armw", "armw"))
def experiment_metrics(spark, sf):
    return metrics(spark, sf).withColumn("lo", r9("lo")).withColumn("hi", r9("hi"))


@query("cls_06_experiment_signal", sql("""select round(v.rate - c.rate, 9) as difference, round(v.rate / c.rate - 1, 9) as relative_lift, round(v.lo - c.hi, 9) as lo, round(v.hi - c.lo, 9) as hi, c.sessions >= 20 and v.sessions >= 20 and c.conversions + v.conversions >= 5 as sufficient,
    case when not (c.sessions >= 20 and v.sessions >= 20 and c.conversions + v.conversions >= 5) then 'inconclusive' when v.lo - c.hi > 0 then 'positive' when v.hi - c.lo < 0 then 'negative' else 'inconclusive' end as signal
    from armw c, armw v where c.arm = 'control' and v.arm = 'v1'""", "armw"))
def experiment_signal(spark, sf):
    out = X.experiment_signal(metrics(spark, sf), [], 20, 5)
    return out.select(*[r9(c) for c in ("difference", "relative_lift", "lo", "hi")], "sufficient", "signal")


# Rollout groups: visitors not divisible by 3 are exposed through searches, the others only through cart and checkout tags.
CTES["rgroup"] = ("""select s, arg_max(grp, (p, t, event_id)) as grp from (
    select s, t, event_id, 1 as p, case when (cast(s as bigint) + event_id // 5000) % 2 = 0 then 'new' else 'native' end as grp from search where cast(s as bigint) % 3 <> 0 union all
    select s, t, event_id, 0, case when event_id % 4 < 2 then 'new' else 'native' end from (select s, t, event_id from cart union all select s, t, event_id from checkout) where event_id % 8 = 0) where s is not null group by s""", ("search", "cart", "checkout"))
CTES["rorder"] = ("""select * from (select event_id, s, case when event_id % 3 = 1 then value else 0 end as amount, row_number() over (partition by case when event_id % 4 < 2 then 'o' || event_id // 2 else 'e' || event_id end order by t, event_id) as rn
    from raw where event_type = 'purchase' and (event_id % 6 <> 0 or event_id % 12 = 0) and event_id % 12 = 0 or event_type = 'purchase' and event_id % 12 = 0) where rn = 1""", ("raw",))
CTES["rev_"] = ("""select s, 'search' as k, 0.0::double as amount from search union all select s, 'click', 0 from click union all select s, 'cart', 0 from cart union all select s, 'start', 0 from checkout union all select s, 'order', amount from rorder""", ("search", "click", "cart", "checkout", "rorder"))
CTES["rper"] = ("""select coalesce(g.grp, 'unknown') as grp, g.s is not null as visitor, coalesce(r.s, g.s) as s, coalesce(searches, 0) as searches, coalesce(clicks, 0) as clicks, coalesce(carts, 0) as carts, coalesce(starts, 0) as starts, coalesce(orders, 0) as orders, coalesce(revenue, 0) as revenue
    from (select s, count(*) filter (k = 'search') as searches, count(*) filter (k = 'click') as clicks, count(*) filter (k = 'cart') as carts, count(*) filter (k = 'start') as starts, count(*) filter (k = 'order') as orders, sum(amount) as revenue from rev_ group by s) r
    full join rgroup g on g.s = r.s""", ("rev_", "rgroup"))
CTES["rollout"] = ("""select grp, count(*) filter (visitor) as visitors, count(*) filter (visitor and searches > 0) as searchers, cast(sum(searches) as bigint) as searches,
    count(*) filter (visitor and clicks > 0) as clickers, cast(sum(clicks) as bigint) as clicks, count(*) filter (visitor and carts > 0) as carters, cast(sum(carts) as bigint) as carts,
    count(*) filter (visitor and starts > 0) as checkout_starters, count(*) filter (visitor and orders > 0) as buyers, cast(sum(orders) as bigint) as orders, round(sum(revenue), 2) as revenue,
    count(*) filter (visitor and clicks > 0 and searches > 0) as searchers_who_clicked, count(*) filter (visitor and carts > 0 and searches > 0) as searchers_who_carted,
    count(*) filter (visitor and orders > 0 and searches > 0) as searchers_who_bought from rper group by 1""", ("rper",))


def groups(spark, sf):
    n, e = F.col("s").cast("bigint"), F.col("event_id")
    ex = D.searches(spark, sf).filter(n % 3 != 0).withColumn("grp", F.when((n + F.floor(e / 5000)) % 2 == 0, "new").otherwise("native"))
    tags = D.carts(spark, sf).select("event_id", "s", "t").unionByName(D.checkouts(spark, sf).select("event_id", "s", "t"))
    tags = tags.filter(e % 8 == 0).withColumn("grp", F.when(e % 4 < 2, "new").otherwise("native"))
    return X.assign_group(ex, tags)


def rollout(spark, sf):
    raw = D.raw_checkouts(spark, sf)
    orders = X.rollout_orders(raw, E.event_time(raw), E.session_key(raw), F.col("total_price").try_cast("double"))
    return X.rollout_report(groups(spark, sf), D.searches(spark, sf), D.clicks(spark, sf), D.carts(spark, sf), D.checkouts(spark, sf), orders)


@query("joi_09_assign_group", sql("select s, grp from rgroup", "rgroup"))
def assign_group(spark, sf):
    return groups(spark, sf)


@query("agg_31_rollout_report", sql("""select *, buyers / nullif(visitors, 0) as conversion, searchers_who_bought / nullif(searchers, 0) as search_conversion,
    round(revenue / nullif(visitors, 0), 6) as revenue_per_visitor, round(revenue / nullif(orders, 0), 6) as average_order from rollout""", "rollout"))
def rollout_report(spark, sf):
    return rollout(spark, sf).withColumn("revenue_per_visitor", F.round("revenue_per_visitor", 6)).withColumn("average_order", F.round("average_order", 6))


@query("agg_31_rollout_lift", sql("""select measure, case when p2 > 0 then round((p1 - p2) / p2, 9) end as lift, case when p > 0 and p < 1 then round((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 9) end as z, p > 0 and p < 1 and abs((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2))) >= 1.96 as significant from (
    select measure, x1 / n1 as p1, x2 / n2 as p2, (x1 + x2) / (n1 + n2) as p, n1, n2 from (
    select 'search_conversion' as measure, a.searchers_who_bought as x1, a.searchers as n1, b.searchers_who_bought as x2, b.searchers as n2 from rollout a, rollout b where a.grp = 'new' and b.grp = 'native' union all
    select 'conversion', a.buyers, a.visitors, b.buyers, b.visitors from rollout a, rollout b where a.grp = 'new' and b.grp = 'native' union all
    select 'search_cart_rate', a.searchers_who_carted, a.searchers, b.searchers_who_carted, b.searchers from rollout a, rollout b where a.grp = 'new' and b.grp = 'native' union all
    select 'search_click_rate', a.searchers_who_clicked, a.searchers, b.searchers_who_clicked, b.searchers from rollout a, rollout b where a.grp = 'new' and b.grp = 'native'))""", "rollout"))
def rollout_lift(spark, sf):
    return X.rollout_lift(rollout(spark, sf), "new", "native").select("measure", r9("lift"), r9("z"), F.coalesce("significant", F.lit(False)).alias("significant"))


@query("joi_07_buyers_among_searchers", sql("select count(distinct s) as n from orders_ where s in (select s from search where s is not null)", "orders_", "search"))
def buyers_among_searchers(spark, sf):
    ev = D.events(spark, sf)
    return X.buyers_among_searchers(ev.orders, ev.searches)


CTES["pairs"] = ("""select q, a, b, count(*) as sessions from (
    with f as (select distinct l_shipmode_ as q, l_orderkey as s, '' || p as product_id from (select l_returnflag as l_shipmode_, l_orderkey, l_partkey % 40 as p from lineitem)),
    g as (select q, s from f group by 1, 2 having count(*) between 2 and 30)
    select x.q, x.s, x.product_id as a, y.product_id as b from f x join f y on x.q = y.q and x.s = y.s and x.product_id < y.product_id join g on g.q = x.q and g.s = x.s) group by 1, 2, 3 having count(*) >= 3""", ())


def pairs(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("q"), F.col("l_orderkey").alias("s"), (F.col("l_partkey") % 40).cast("string").alias("product_id"))
    return X.co_cart_pairs(li)


@query("agg_32_co_cart_pairs", sql("select * from pairs", "pairs"))
def co_cart_pairs(spark, sf):
    return pairs(spark, sf)


CTES["observed"] = ("""select distinct query, product_id from (select query, product_id from matched where known union all
    select f.query, p.id from (select query, unnest(delivered) as name from per_search) f join product p on p.name = f.name)""", ("matched", "per_search", "product"))
CTES["review"] = ("""select f.query, searches, search_sessions as sessions, clicks, carts, purchases, zero_searches, search_sessions >= (select searched from store) * 0.1 and coalesce(click_rate, 0) < 0.01 and coalesce(cart_rate, 0) < 0.05 as synthetic, coalesce(n, 0) as candidates
    from funnel f left join (select query, count(*) as n from observed group by 1) o using (query) where searches > 0""", ("funnel", "store", "observed"))


def observed(spark, sf, ev):
    return X.candidates(chosen_products(ev), U.latest_delivered(ev.searches), D.products(spark, sf))


def review(spark, sf):
    ev = D.events(spark, sf)
    rows = U.query_funnel(ev)
    bad = C.suspected_synthetic(rows, ev.searches, min_sessions=100, share=0.1, click=0.01, cart=0.05)
    return ev, X.weekly_review(rows, bad, observed(spark, sf, ev))


@query("set_02_candidates", sql("select query, product_id from observed", "observed"))
def candidates(spark, sf):
    return observed(spark, sf, D.events(spark, sf))


@query("agg_33_weekly_review", sql("select * from review", "review"))
def weekly_review(spark, sf):
    return review(spark, sf)[1]


@query("agg_33_review_eligibility", sql("""select (select searched from store) >= 20 and (select max(sessions) from review where not synthetic) >= 5 and (select cart_rate is not null or purchase_rate is not null from store_rates) as eligible, 'purchase' as metric""", "review", "store_rates"))
def review_eligibility(spark, sf):
    ev, rows = review(spark, sf)
    return X.review_eligibility(rows, U.store_funnel(ev))


@query("flt_11_actionable_queries", sql("select query, sessions from review where sessions >= 5 and not synthetic", "review"))
def actionable_queries(spark, sf):
    return X.actionable_queries(review(spark, sf)[1]).select("query", "sessions")


TARGETS = [{"id": "night", "mode": "all", "window": {"start_hour": 22, "end_hour": 6}},
           {"id": "ones", "mode": "queryMatch", "patterns": ["Q1"], "match": "contains"},
           {"id": "exact", "mode": "queryMatch", "patterns": ["q7", "q8"], "match": "exact", "window": {"start_hour": 8, "end_hour": 20, "timezone": "UTC"}}]


@query("flt_12_targeting_match", sql("""select event_id, unnest(list_filter([case when h >= 22 or h < 6 then 'night' end, case when contains(q, 'q1') then 'ones' end,
    case when q in ('q7', 'q8') and hour(t) >= 8 and hour(t) < 20 then 'exact' end], lambda x: x is not null)) as target_id from (select *, hour(timezone('Asia/Jerusalem', timezone('UTC', t))) as h from search)""", "search"))
def targeting_match(spark, sf):
    return X.targeting_match(D.searches(spark, sf), TARGETS).select("event_id", "target_id")


@query("flt_13_targeting_conflicts", """select c_custkey as id, case when c_nationkey % 3 = 0 then 'boosts' else '' end || case when c_nationkey % 2 = 0 then '|pins' else '' end as shared
    from customer where (c_custkey % 20 = 0 or contains('building blocks', lower(c_mktsegment)) or contains(lower(c_mktsegment), 'building blocks')) and (c_nationkey % 3 = 0 or c_nationkey % 2 = 0)""")
def targeting_conflicts(spark, sf):
    n = F.col("c_nationkey")
    keys = F.array_compact(F.array(F.when(n % 3 == 0, "boosts"), F.when(n % 2 == 0, "pins"), F.lit("notes")))
    active = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 20 == 0, "all").otherwise("queryMatch").alias("mode"),
                                                   F.array("c_mktsegment").alias("patterns"), keys.alias("patch_keys"))
    out = X.targeting_conflicts(active, {"mode": "queryMatch", "patterns": ["Building Blocks"], "patch_keys": ["boosts", "pins"]})
    has = lambda k: F.array_contains("shared_keys", k)
    return out.select("id", F.concat(F.when(has("boosts"), "boosts").otherwise(""), F.when(has("pins"), "|pins").otherwise("")).alias("shared"))


PLAN = "select c_custkey // 8 as proposal_id, c_custkey // 4 as action_id, case c_custkey // 4 % 4 when 0 then 'reorder' when 1 then 'demote' when 2 then 'exclude' else 'bundle' end as type, 'q' || (c_custkey // 8 % 25) as query, '' || (c_nationkey * 3 + c_custkey % 2) as product_id from customer where c_custkey % 4 < 2"
CTES["plan_"] = (PLAN, ())
CTES["plan_state"] = ("select p.*, c.id is not null as known, coalesce(not c.hidden and c.stock_status in ('instock', 'in_stock') and c.status in ('ACTIVE', 'active', 'publish', 'published'), false) as available from plan_ p left join product c on c.id = p.product_id", ("plan_", "product"))


@query("cls_10_proposal_rules", sql("""select distinct * from (
    select proposal_id, 'too_few_sessions' as code, query, cast(null as varchar) as product_id from plan_ where query not in (select query from review where sessions >= 5 and not synthetic) union all
    select proposal_id, 'unknown_product', query, product_id from plan_state where not known union all
    select proposal_id, 'unavailable', query, product_id from plan_state where known and not available and type not in ('demote', 'exclude') union all
    select proposal_id, 'not_observed', query, product_id from plan_ p where not exists (select 1 from observed o where o.query = p.query and o.product_id = p.product_id) union all
    select proposal_id, 'duplicate_product', query, product_id from plan_ group by proposal_id, action_id, query, product_id having count(*) > 1 union all
    select proposal_id, 'contradiction', query, product_id from plan_ group by proposal_id, query, product_id having (count(*) filter (type = 'exclude') > 0 and count(*) > count(*) filter (type = 'exclude')) or (count(*) filter (type = 'demote') > 0 and count(*) filter (type = 'reorder') > 0) union all
    select a.proposal_id, 'weak_bundle', a.query, a.product_id from plan_ a join plan_ b on a.action_id = b.action_id and a.proposal_id = b.proposal_id and a.query = b.query and a.product_id < b.product_id where a.type = 'bundle' and b.type = 'bundle'
      and not exists (select 1 from pairs p where p.q = a.query and p.a = a.product_id and p.b = b.product_id) union all
    select proposal_id, 'thin_proposal', null, null from (select distinct proposal_id, query from plan_) join review using (query) where sessions >= 5 and not synthetic group by proposal_id having sum(sessions) < 20 union all
    select proposal_id, 'overlapping', query, null from (select distinct proposal_id, query, min(proposal_id) over (partition by query) as f from plan_) where proposal_id <> f)""", "plan_state", "review", "observed", "pairs"))
def proposal_rules(spark, sf):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("reorder", "demote", "exclude", "bundle")]), (F.floor(k / 4) % 4 + 1).cast("int"))
    plan = D.table(spark, sf, "customer").filter(k % 4 < 2).select(
        F.floor(k / 8).alias("proposal_id"), F.floor(k / 4).alias("action_id"), kind.alias("type"),
        F.concat(F.lit("q"), F.floor(k / 8) % 25).alias("query"), (F.col("c_nationkey") * 3 + k % 2).cast("string").alias("product_id"))
    ev, rows = review(spark, sf)
    from storelens.operators.catalog import available
    state = D.products(spark, sf).select(F.col("id").alias("product_id"), available().alias("available"))
    return X.proposal_rules(plan, rows, observed(spark, sf, ev), state, pairs(spark, sf))


@query("set_06_new_queries_only", """with p as (select c_custkey as proposal_id, 'k' || (c_custkey % 400) as dedupe_key, ['s' || c_nationkey, 't' || (c_custkey % 30)] as queries from customer)
    select proposal_id from p where dedupe_key not in (select 'k' || (o_orderkey * 7) from orders) and not list_has_any(queries, ['s3', 't4', 's20'])""")
def new_queries_only(spark, sf):
    k = F.col("c_custkey")
    qs = F.array(F.concat(F.lit("s"), F.col("c_nationkey")), F.concat(F.lit("t"), k % 30))
    props = D.table(spark, sf, "customer").select(k.alias("proposal_id"), F.concat(F.lit("k"), k % 400).alias("dedupe_key"), qs.alias("queries"))
    recent = D.table(spark, sf, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey") * 7).alias("dedupe_key"))
    active = D.table(spark, sf, "nation").filter("n_nationkey in (3, 20)").select(F.array(F.concat(F.lit("s"), F.col("n_nationkey")), F.lit("t4")).alias("queries"))
    return X.new_queries_only(props, recent, active).select("proposal_id")


@query("cls_11_experiment_expiry", """select c_custkey as id from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and date '2024-01-01' + cast(c_custkey % 60 as integer) <= date '2024-01-31'""")
def experiment_expiry(spark, sf):
    k = F.col("c_custkey")
    rows = D.table(spark, sf, "customer").select(k.alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "pending").when(
        F.col("c_mktsegment") == "MACHINERY", "running").otherwise("done").alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).cast("timestamp").alias("expires_at"))
    return C.experiment_expiry(rows, ts("2024-01-31")).select("id")


@query("cls_12_resolve_platform", """select shop, case when count(distinct own) > 1 then 'conflict' when coalesce(arg_min(own, ord), arg_min(p, ord)) is null then 'unknown' else 'known' end as state,
    case when count(distinct own) <= 1 then coalesce(arg_min(own, ord), arg_min(p, ord)) end as platform from (
    select *, case when p <> 'custom' then p end as own from (select c_nationkey as shop, c_custkey as ord, case c_custkey % 400 when 1 then 'woocommerce' when 2 then 'woocommerce' when 3 then 'shopify' when 4 then 'magento' when 5 then 'custom' end as p from customer)) group by 1""")
def resolve_platform(spark, sf):
    k = F.col("c_custkey")
    label = F.when(k % 400 == 1, "Woo").when(k % 400 == 2, "wordpress").when(k % 400 == 3, "Shopify").when(k % 400 == 4, "magento2").when(k % 400 == 5, "custom").otherwise("other")
    sig = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("shop"), k.alias("source_order"), label.alias("platform"))
    return C.resolve_platform(sig)
