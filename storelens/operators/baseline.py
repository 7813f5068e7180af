"""What shoppers chose and whether search still answers it (JOI-04..06, AGG-12..18, 36, CLS-05, SRT-02, WIN-03..04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions.numbers import ratio
from storelens.functions.text import DROPPED, query_key, squash
from storelens.functions.urls import decoded, path_key, url_tail
from storelens.operators.attribution import WINDOWS
from storelens.operators.containment import contained
from storelens.operators.funnel import Events
from storelens.session import large

STATUS_ORDER = {"lost": 0, "partial": 1, "kept": 2}


def _keyed(products: DataFrame, order: str) -> DataFrame:
    """(key, product struct, _o): every key a product answers to, names in their own key space.

    A product makes up to a dozen rows, and few row groups hold many products: they are dealt over all tasks first.
    """
    products = products.repartition(order)
    has = lambda c: F.col(c).cast("string") if c in products.columns else F.lit(None).cast("string")
    pid = has("id")
    keys = [pid, F.when(pid != "", F.concat(F.lit("woo_product_"), pid)), F.nullif(F.regexp_extract(pid, "/(\\d+)$", 1), F.lit("")),
            has("numeric_id"), has("sku"), has("slug"), decoded(has("handle")), url_tail(has("url")), url_tail(has("permalink")),
            has("ItemID"), has("Makat")]
    stock = F.col("stock_status")
    card = F.struct(pid.alias("id"), F.coalesce(has("name"), has("title"), F.lit("")).alias("name"),
                    (~F.col("hidden") & F.coalesce(stock == "instock", F.lit(False))).alias("available"),
                    F.col("hidden").alias("hidden"), stock.alias("stock_status"))
    plain = F.filter(F.transform(F.array(*keys), lambda k: F.concat(F.lit("k:"), F.lower(F.trim(k)))),
                     lambda k: k.isNotNull() & (k != "k:"))
    name = F.when(card["name"] != "", F.concat(F.lit("n:"), query_key(card["name"])))
    every = F.array_compact(F.concat(plain, F.array(name)))
    return products.select(F.explode(F.array_distinct(every)).alias("key"), card.alias("product"), F.col(order).alias("_o"))


def catalog_keys(products: DataFrame, order: str = "id", wanted: DataFrame | None = None) -> DataFrame:
    """(key, product struct): every key a product answers to; on a shared key the last product wins.

    With ``wanted`` (key) only those keys: the others leave before products are sorted by key, which a maximum of structs needs.
    """
    rows = _keyed(products, order)
    if wanted is not None:
        rows = large(rows).join(wanted.select("key").distinct(), "key", "left_semi")
    return rows.groupBy("key").agg(F.max_by("product", "_o").alias("product"))


def match_catalog(refs: DataFrame, products: DataFrame, order: str = "id") -> DataFrame:
    """JOI-04: adds ``product`` (struct or null) to rows with pid, name and url.

    Keys are tried in the order id, trailing number of a global id, id without
    platform prefix, url tail, name. Distinct references are matched, not events,
    so a product holding most events costs one row. Any of the three may be null.
    """
    distinct = refs.select("pid", "name", "url").distinct()
    pid = F.lower(F.trim("pid"))
    usable = (pid != "") & (pid != "---")
    key = lambda c: F.concat(F.lit("k:"), c)
    tried = F.array(
        F.when(usable, key(pid)), F.when(usable, key(F.nullif(F.regexp_extract(pid, "/(\\d+)$", 1), F.lit("")))),
        F.when(usable, key(F.regexp_replace(pid, "^woo_product_", ""))), F.when(F.col("url") != "", key(url_tail(F.col("url")))),
        F.when(F.col("name") != "", F.concat(F.lit("n:"), query_key(F.col("name")))))
    asked = distinct.select("pid", "name", "url", F.posexplode(tried).alias("rank", "key")).filter("key is not null")
    found = asked.join(large(catalog_keys(products, order, asked)), "key").groupBy("pid", "name", "url").agg(
        F.min_by("product", "rank").alias("product"))
    parts = ["pid", "name", "url"]
    found = found.select(*[F.col(p).alias(f"_{p}") for p in parts], "product")
    same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
    return refs.join(found, same, "left").select(*parts, *[x for x in refs.columns if x not in parts], "product")


def last_segment(url: Column) -> Column:
    """Last path segment of a link, query and trailing slash cut, case kept."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "\\?.*$", ""), "/$", ""), "/"), -1)


def plain_title(x: Column) -> Column:
    """Title key of the click lookup: quotes dropped, white space collapsed, lower-case."""
    return squash(F.lower(F.regexp_replace(x, DROPPED, "")))


def match_by_url_or_title(clicks: DataFrame, products: DataFrame) -> DataFrame:
    """JOI-05: adds ``card`` by url tail, else by title (columns url, name of the click)."""
    card = F.struct("id", "title", "hidden", "stock_status")
    by_tail = products.select(last_segment(F.col("url")).alias("_tail"), card.alias("_c"), F.col("id").alias("_o")).groupBy(
        "_tail").agg(F.max_by("_c", "_o").alias("_by_tail"))
    by_title = products.select(plain_title(F.col("name")).alias("_title"), card.alias("_c"), F.col("id").alias("_o")).groupBy(
        "_title").agg(F.max_by("_c", "_o").alias("_by_title"))
    refs = clicks.select("url", "name").distinct().withColumn("_tail", last_segment(F.col("url"))).withColumn(
        "_title", plain_title(F.col("name")))
    found = refs.join(by_tail, "_tail", "left").join(by_title, "_title", "left").select(
        "url", "name", F.coalesce("_by_tail", "_by_title").alias("card"))
    return clicks.join(found, ["url", "name"], "left")


def lookup_first(links: DataFrame, products: DataFrame, site: str, href: str = "href") -> DataFrame:
    """JOI-06: adds the id of the first product under each link's path key."""
    keys = products.select(path_key(F.col("url"), site).alias("_k"), "id").filter("_k is not null").groupBy("_k").agg(
        F.min("id").alias("product_id"))
    return links.withColumn("_k", path_key(F.col(href), site)).join(keys, "_k", "left").drop("_k")


def chosen_products(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """AGG-12: clicks, carts and purchase lines per (query, product key), explicit or inferred."""
    rows = ev.attributed(windows).filter("kind <> 'checkout' and aq is not null")
    item = F.posexplode("items").alias("line", "i")
    bought = rows.filter("kind = 'purchase'").select("aq", "kind", "t", "event_id", item).select(
        "aq", "kind", "t", "event_id", "line", F.col("i.pid").alias("pid"), F.col("i.name").alias("name"), F.lit("").alias("url"))
    picks = rows.filter("kind <> 'purchase'").select("aq", "kind", "t", "event_id", F.lit(0).alias("line"), "pid", "name", "url").unionByName(bought)
    key = F.when(F.col("pid") != "", F.col("pid")).otherwise(F.col("name"))
    k = F.col("kind")
    seq = F.struct(F.when(k == "click", 0).when(k == "cart", 1).otherwise(2).alias("k"), "t", "event_id", "line")
    named = F.col("name") != ""
    return picks.withColumn("key", key).filter("key <> ''").groupBy(F.col("aq").alias("query"), "key").agg(
        F.count_if(k == "click").alias("clicks"), F.count_if(k == "cart").alias("carts"),
        F.count_if(k == "purchase").alias("purchases"), F.min_by("pid", seq).alias("pid"), F.min_by("url", seq).alias("url"),
        F.coalesce(F.min_by(F.when(named, F.col("name")), F.when(named, seq)), F.lit("")).alias("name"))


def catalog_match_rate(matched: DataFrame) -> DataFrame:
    """AGG-13: event-weighted share of chosen products found in the catalog (one row); null without events."""
    w = F.col("clicks") + F.col("carts") + F.col("purchases")
    return matched.agg(ratio(F.sum(F.when(F.col("product").isNotNull(), w).otherwise(0)), F.sum(w)).alias("match_rate"))


def click_share(tallies: DataFrame) -> DataFrame:
    """WIN-03: each product's share of its query's clicks, null when the query has none."""
    totals = tallies.groupBy("query").agg(F.sum("clicks").alias("total_clicks"))
    return tallies.join(totals, "query").withColumn("share", ratio(F.col("clicks"), F.col("total_clicks")))


def top_per_query(tallies: DataFrame, n: int) -> DataFrame:
    """WIN-04: the best ``n`` products of each query by purchases, carts, clicks."""
    w = Window.partitionBy("query").orderBy(*[F.col(c).desc() for c in ("purchases", "carts", "clicks")], "key")
    return tallies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def clear_picks(tallies: DataFrame, n: int = 8) -> DataFrame:
    """Products clearly chosen for a query: carted, bought, or clicked three times with 10 % of the clicks."""
    strong = (F.col("carts") > 0) | (F.col("purchases") > 0)
    clear = strong | ((F.col("clicks") >= 3) & (F.coalesce("share", F.lit(1.0)) >= 0.1))
    return top_per_query(click_share(tallies).filter(clear), n)


def baseline_targets(tallies: DataFrame, products: DataFrame) -> DataFrame:
    """The picks of every query with their catalog state; ``gone`` marks those that cannot be shown.

    A product missing from the catalog counts as gone only when at least 90 % of all
    chosen events resolve; otherwise it is unknown.
    """
    matched = match_catalog(tallies, products)
    reliable = F.coalesce(catalog_match_rate(matched).select((F.col("match_rate") >= 0.9).alias("r")).scalar(), F.lit(False))
    picks = clear_picks(tallies).select("query", "key", "rank", "total_clicks", "share")
    known = F.col("product").isNotNull()
    return matched.join(picks, ["query", "key"]).withColumn("_reliable", reliable).withColumn(
        "gone", F.when(known, ~F.col("product.available")).otherwise(F.col("_reliable"))).drop("_reliable")


def query_baseline(rows: DataFrame, tallies: DataFrame, products: DataFrame, min_searches: int = 3) -> DataFrame:
    """AGG-14: works / fails / unclear / gap per query with its targets and unavailable picks."""
    picks = baseline_targets(tallies, products).groupBy("query").agg(
        F.count("*").alias("picked"), F.count_if(~F.col("gone")).alias("n_targets"), F.count_if("gone").alias("n_gone"),
        F.sum(F.when(F.col("gone"), F.col("clicks") + F.col("carts")).otherwise(0)).alias("gone_clicks"),
        F.sum(F.col("clicks") + F.col("carts")).alias("picked_clicks"),
        F.sort_array(F.collect_list(F.struct("rank", "key", "gone"))).alias("picks"))
    clicks = tallies.groupBy("query").agg(F.sum("clicks").alias("_total"))
    base = rows.filter(F.greatest("searches", "clicks") >= min_searches)
    j = base.join(picks, "query", "left").join(clicks, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    production = F.when(zero("picked") > 0, "works").when(
        (F.coalesce("zero_rate", F.lit(0.0)) >= 0.5) | ((F.col("searches") >= 5) & (zero("_total") == 0)), "fails").otherwise("unclear")
    out = j.withColumn("production", production)
    status = F.when((F.col("production") == "works") & (zero("n_targets") == 0), "gap").otherwise(F.col("production"))
    names = lambda gone: F.transform(F.filter("picks", lambda p: p["gone"] == gone), lambda p: p["key"])
    empty = F.array().cast("array<string>")
    return out.select("query", "searches", "zero_rate", "clicks", "carts", "purchases", "production", status.alias("status"),
                      zero("n_targets").alias("n_targets"), zero("n_gone").alias("n_gone"), zero("gone_clicks").alias("gone_clicks"),
                      zero("picked_clicks").alias("picked_clicks"), F.coalesce(names(False), empty).alias("targets"),
                      F.coalesce(names(True), empty).alias("unavailable"))


def baseline_summary(baseline: DataFrame) -> DataFrame:
    """AGG-14, summary: queries and searches per status (one row)."""
    s = F.col("status")
    searches = lambda x: F.coalesce(F.sum(F.when(s == x, F.col("searches"))), F.lit(0))
    return baseline.agg(
        F.count("*").alias("queries"), *[F.count_if(s == x).alias(n) for x, n in
                                         (("works", "works"), ("gap", "gaps"), ("fails", "fails"), ("unclear", "unclear"))],
        searches("works").alias("searches_working"), searches("fails").alias("searches_failing"),
        searches("gap").alias("searches_in_gaps"),
        F.count_if((s == "works") & (F.col("n_gone") > 0)).alias("partial_gaps"))


def production_baseline(queries: DataFrame, clicks: DataFrame, carts: DataFrame, cards: DataFrame,
                        min_searches: int = 3) -> DataFrame:
    """AGG-15: the same verdicts from plain logs.

    ``queries`` is (key, form, delivered array or null, event_id); events carry (key, url, name).
    A missing result list counts as an empty one here.
    """
    merged = queries.groupBy("key").agg(
        F.min_by("form", "event_id").alias("query"), F.count("*").alias("searches"),
        F.count_if(F.coalesce(F.size("delivered"), F.lit(0)) <= 0).alias("zero"),
        F.max_by(F.slice(F.coalesce("delivered", F.array().cast("array<string>")), 1, 5), "event_id").alias("production_top")).filter(
        F.col("searches") >= min_searches)
    part = lambda df, k: df.select("key", last_segment(F.col("url")).alias("tail"), F.col("name"), F.lit(k).alias("k"))
    events = part(clicks, "click").unionByName(part(carts, "cart"))
    per = events.groupBy("key", "tail").agg(F.count_if(F.col("k") == "click").alias("clicks"),
                                            F.count_if(F.col("k") == "cart").alias("carts"), F.min("name").alias("name"))
    shown = ~F.col("hidden") & (F.col("stock_status") == "instock")
    tails = cards.select(last_segment(F.col("url")).alias("tail"), F.col("id"), shown.alias("visible")).groupBy("tail").agg(
        F.max_by(F.struct("id", "visible"), "id").alias("card"))
    total = per.groupBy("key").agg(F.sum("clicks").alias("all_clicks"), F.sum("carts").alias("all_carts"))
    share_ok = (F.col("all_clicks") == 0) | (F.col("clicks") / F.greatest("all_clicks", F.lit(1)) >= 0.1) | (F.col("carts") > 0)
    clear = ((F.col("carts") > 0) | (F.col("clicks") >= 3)) & share_ok
    w = Window.partitionBy("key").orderBy(F.col("carts").desc(), F.col("clicks").desc(), "tail")
    picks = (per.join(total, "key").filter(clear).withColumn("rank", F.row_number().over(w)).filter("rank <= 8")
             .join(tails, "tail", "left").withColumn("ok", F.coalesce("card.visible", F.lit(False)))
             .groupBy("key").agg(F.count_if("ok").alias("n_targets"), F.count_if(~F.col("ok")).alias("n_unavailable")))
    j = merged.join(total, "key", "left").join(picks, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    zero_rate = F.col("zero") / F.col("searches")
    production = F.when(zero("n_targets") + zero("n_unavailable") > 0, "works").when(
        (zero_rate >= 0.5) | ((F.col("searches") >= 5) & (zero("all_clicks") == 0)), "fails").otherwise("unclear")
    return j.select("query", "key", "searches", (F.floor(zero_rate * 100 + 0.5) / 100).alias("production_zero_rate"),
                    zero("all_clicks").alias("clicks"), zero("all_carts").alias("carts"), production.alias("production"),
                    zero("n_targets").alias("n_targets"), zero("n_unavailable").alias("n_unavailable"), "production_top")


def popularity(clicks: DataFrame, carts: DataFrame, cards: DataFrame) -> DataFrame:
    """AGG-16: clicks + 3 x carts per catalog product, whatever the query."""
    part = lambda df, w: df.filter("url <> ''").select(last_segment(F.col("url")).alias("tail"), F.lit(w).alias("w"))
    score = part(clicks, 1).unionByName(part(carts, 3)).groupBy("tail").agg(F.sum("w").alias("w"))
    tails = cards.select(last_segment(F.col("url")).alias("tail"), "id").groupBy("tail").agg(F.max("id").alias("id"))
    return score.join(tails, "tail").groupBy("id").agg(F.sum("w").alias("popularity"))


def evaluate_baseline(baseline: DataFrame, targets: DataFrame, results: DataFrame, cards: DataFrame, top: int = 24) -> DataFrame:
    """AGG-17: kept / partial / lost / gap per working query, answers / empty for the others.

    baseline (query, searches, production); targets (query, product_id); results (query, product_id, rank).
    """
    shown = cards.filter(~F.col("hidden") & (F.col("stock_status") == "instock")).select(F.col("id").alias("product_id"), F.lit(True).alias("_ok"))
    ranked = results.filter(F.col("rank") <= top).select("query", "product_id", "rank")
    t = targets.join(shown, "product_id", "left").join(ranked, ["query", "product_id"], "left").groupBy("query").agg(
        F.count_if("_ok").alias("targets"), F.count_if(F.col("_ok") & F.col("rank").isNotNull()).alias("found"),
        F.count_if(F.col("_ok").isNull()).alias("unavailable_now"), F.min(F.when(F.col("_ok"), F.col("rank"))).alias("best_rank"))
    totals = results.groupBy("query").agg(F.count("*").alias("total"))
    j = baseline.join(t, "query", "left").join(totals, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    works = F.col("production") == "works"
    status = F.when(works & (zero("targets") == 0), "gap").when(works & (F.col("found") == F.col("targets")), "kept").when(
        works & (F.col("found") > 0), "partial").when(works, "lost").when(zero("total") > 0, "answers").otherwise("empty")
    return j.select("query", "searches", "production", status.alias("status"), zero("total").alias("total"),
                    zero("targets").alias("targets"), zero("found").alias("found"),
                    zero("unavailable_now").alias("unavailable_now"), "best_rank")


def evaluation_summary(evaluation: DataFrame) -> DataFrame:
    """AGG-17, summary: search-weighted kept share and the status counts (one row)."""
    s, works = F.col("status"), F.col("production") == "works"
    weight = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("searches"))), F.lit(0))
    share = ratio(weight(s == "kept"), weight(works & (s != "gap")))
    return evaluation.agg((F.floor(share * 1000 + 0.5) / 1000).alias("kept_share"),
                          *[F.count_if(s == x).alias(x) for x in ("kept", "partial", "lost", "gap")],
                          F.count_if(F.col("production") == "fails").alias("production_fails"),
                          F.count_if((F.col("production") == "fails") & (s == "answers")).alias("fails_we_answer"))


def baseline_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-18: working queries whose status fell from kept or partial."""
    order = F.create_map(*[x for k, v in STATUS_ORDER.items() for x in (F.lit(k), F.lit(v))])
    old = before.select("query", F.col("status").alias("was"))
    return after.filter("production = 'works'").join(old, "query").filter(
        F.try_element_at(order, F.col("status")) < F.try_element_at(order, F.col("was"))).select(
        "query", "searches", "was", F.col("status").alias("now"))


def clicked_products(clicks: DataFrame, products: DataFrame, words: list[str]) -> DataFrame:
    """AGG-36: per product the clicks on queries holding the given words in a row."""
    import re

    pattern = "(?i)" + "\\s+".join(re.escape(w) for w in words)
    hits = match_by_url_or_title(clicks.filter(F.col("q").rlike(pattern)), products)
    key = F.coalesce("card.id", F.nullif(plain_title(F.col("name")), F.lit("")), last_segment(F.col("url")))
    visible = F.coalesce(~F.col("card.hidden") & (F.col("card.stock_status") == "instock"), F.lit(False))
    return hits.groupBy(key.alias("product"), F.col("card").isNotNull().alias("in_catalog"), visible.alias("visible")).agg(
        F.count("*").alias("clicks"))


def _of(rows: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Rows of the requested queries (column query)."""
    return rows.join(queries.select(F.col("query").alias(key)).distinct(), key, "left_semi")


def searches_per_day(searches: DataFrame, queries: DataFrame) -> DataFrame:
    """CLS-05, days: searches per UTC day of the requested queries (column query)."""
    return _of(searches, queries, "q").groupBy(
        F.col("q").alias("query"), F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("searches"))


def results_shown(searches: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """CLS-05, lists: the result lists (first five names) shown most often per requested query (column query)."""
    lists = _of(searches.filter(F.size("names") > 0), queries, "q").groupBy(
        F.col("q").alias("query"), F.slice("names", 1, 5).alias("names")).agg(F.count("*").alias("searches"))
    w = Window.partitionBy("query").orderBy(F.col("searches").desc(), "names")
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def related_queries(rows: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """CLS-05, related: queries containing or contained in a requested one (column query), most searched first.

    ``rows`` is (query, searches), one row per query. Both directions are equi-joins (``contained``); blank queries relate to none.
    """
    asked = queries.select(F.col("query").alias("asked")).distinct()
    own = rows.select(F.col("query").alias("product_id"), F.col("query").alias("text"))
    longer = contained(asked, own).select("asked", F.col("product_id").alias("query"))
    shorter = contained(rows.select(F.col("query").alias("asked")), asked.select(F.col("asked").alias("product_id"), F.col("asked").alias("text"))).select(
        F.col("product_id").alias("asked"), F.col("asked").alias("query"))
    hits = longer.unionByName(shorter).filter("asked <> query").distinct().join(rows.select("query", "searches"), "query")
    w = Window.partitionBy("asked").orderBy(F.col("searches").desc(), "query")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def gap_share(tallies: DataFrame, products: DataFrame, queries: DataFrame, n: int = 15) -> DataFrame:
    """CLS-05, gap: share of the chosen products' clicks and carts that cannot be bought now, per requested query (column query)."""
    top = top_per_query(_of(tallies, queries, "query"), n)
    m = match_catalog(top, products)
    w = F.col("clicks") + F.col("carts")
    ok = F.coalesce("product.available", F.lit(False))
    share = ratio(F.sum(F.when(~ok, w).otherwise(0)), F.sum(w))
    return m.groupBy("query").agg((F.floor(share * 100 + 0.5) / 100).alias("gap_share"), F.count("*").alias("products"))


def audit_candidates(rows: DataFrame, baseline: DataFrame, limit: int = 12) -> DataFrame:
    """SRT-02: the queries to diagnose first, interleaved over seven reason lists.

    Every list is ranked on its own; lists are read round by round. Each round the
    list of all queries yields a new one, so no list is needed past ``limit`` rows.
    """
    b = baseline.select("query", "status", "gone_clicks", "picked_clicks", "n_gone")
    r = rows.join(b, "query", "left")
    c, zero = F.col, lambda x: F.coalesce(x, F.lit(0))
    stage, below = c("leak_stage"), zero("sessions_below_average")
    idle = (c("search_sessions") >= 5) & (c("clicks") == 0) & (zero("zero_rate") < 0.5)
    lists = [("zero_results", stage == "zero_results", c("searches")),
             ("no_click", (stage == "no_click") | idle, c("search_sessions")),
             ("click_no_cart", stage == "click_no_cart", below), ("cart_no_purchase", stage == "cart_no_purchase", below),
             ("production_fails", c("status") == "fails", c("searches")),
             ("catalog_gap", (c("status") == "gap") | (zero("n_gone") > 0), c("searches")),
             ("top", F.lit(True), c("searches"))]
    member = F.filter(F.array(*[F.when(cond, F.struct(F.lit(i).alias("no"), F.lit(name).alias("reason"), by.cast("double").alias("by")))
                                for i, (name, cond, by) in enumerate(lists)]), lambda x: x.isNotNull())
    w = Window.partitionBy("l.no").orderBy(c("l.by").desc(), "query")
    ranked = r.withColumn("l", F.explode(member)).withColumn("round", F.row_number().over(w)).filter(c("round") <= limit)
    per = ranked.groupBy("query").agg(F.min(F.struct("round", "l.no")).alias("first"),
                                      F.collect_list(F.struct("round", "l.no", "l.reason")).alias("seen"))
    order = Window.orderBy("first")
    picked = per.orderBy("first").limit(limit).withColumn("position", F.row_number().over(order))
    stop = F.max(F.col("first.round")).over(Window.partitionBy(F.lit(1)))
    picked = picked.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn(
        "_stop", F.when(c("_n") >= limit, stop).otherwise(F.lit(1 << 30)))
    reasons = F.transform(F.sort_array(F.filter("seen", lambda x: x["round"] <= c("_stop"))), lambda x: x["reason"])
    out = picked.withColumn("reasons", reasons).select("query", "position", "reasons").join(r, "query")
    from storelens.operators.classify import catalog_gap
    label = catalog_gap(zero("gone_clicks"), zero("picked_clicks"), c("status"), c("search_sessions"),
                        F.element_at("reasons", 1) == "zero_results")
    return out.select("query", "position", "reasons", "searches", "search_sessions", label.alias("classification"))


def tracking_issues(cov: DataFrame, funnel: DataFrame, orders: DataFrame, sources: DataFrame, days: DataFrame,
                    revenue: DataFrame, synthetic: DataFrame, experiments: DataFrame, match_rate: DataFrame) -> DataFrame:
    """AGG-22: measurement problems as (code, severity, a, b), the numbers being the evidence of the check."""
    one = lambda df, *cols: df.agg(F.struct(*cols)).scalar()
    x = cov.withColumn("o", orders.select(F.struct("duplicates")).scalar()).withColumn(
        "d", one(days, F.max(F.col("searches") > 0).alias("logging"), F.count_if("search_log_gap").alias("log_gaps"),
                 F.count_if("tracking_gap").alias("track_gaps"))).withColumn(
        "r", one(revenue, F.count_if((F.col("scope") == "total") & (F.col("currency") == "—")).alias("unknown"))).withColumn(
        "m", match_rate.select("match_rate").scalar())
    c = F.col
    share = lambda a, b: ratio(c(a), c(b))
    active = c("clicks") + c("carts") > 0
    num = lambda v: v.cast("double")

    def issue(code, severity, cond, a, b=F.lit(None)):
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), sev.alias("severity"),
                                                               num(a).alias("a"), num(b).alias("b")))

    checks = [
        issue("catalog_id_mismatch", "warning", (c("m") < 0.9) & (c("clicks") + c("carts") >= 100), c("m")),
        issue("no_search_logging", "critical", (c("queries") == 0) & active, c("clicks"), c("carts")),
        issue("queries_missing_session", "critical", (c("queries") >= 20) & (share("queries_with_session", "queries") < 0.5), c("queries_with_session"), c("queries")),
        issue("no_purchase_tracking", F.when(c("carts") > 0, "critical").otherwise("warning"), active & ~c("purchase_tracking"), c("purchases")),
        issue("purchases_missing_session", "warning", (c("purchases") >= 10) & (share("purchases_with_session", "purchases") < 0.7), c("purchases_with_session"), c("purchases")),
        issue("session_mismatch", "warning", (c("purchases") >= 20) & (c("purchase_sessions_seen_before") < 0.3), c("purchase_sessions_seen_before")),
        issue("purchases_missing_currency", "info", (c("purchases") >= 10) & (c("r.unknown") > 0), c("purchases")),
        issue("no_result_counts", "warning", (c("queries") >= 50) & (share("queries_with_result_count", "queries") < 0.5), c("queries_with_result_count"), c("queries")),
        issue("clicks_untagged", "info", (c("clicks") >= 200) & (share("clicks_tagged", "clicks") < 0.3), c("clicks_tagged"), c("clicks")),
        issue("search_log_gap", "warning", c("d.logging") & (c("d.log_gaps") > 0), c("d.log_gaps")),
        issue("tracking_gap", "warning", c("d.track_gaps") > 0, c("d.track_gaps")),
        issue("duplicate_orders", "info", c("o.duplicates") > 0, c("o.duplicates"))]
    found = x.select(F.inline(F.array_compact(F.array(*checks))))
    bad = sources.filter("status <> 'ok'").select(
        F.concat(F.lit("source_"), "source").alias("code"), F.when(c("status") == "unavailable", "critical").otherwise("warning").alias("severity"),
        num(c("rows")).alias("a"), F.lit(None).cast("double").alias("b"))
    cut = sources.filter("truncated").select(F.concat(F.lit("truncated_"), "source").alias("code"), F.lit("warning").alias("severity"),
                                             num(c("rows")).alias("a"), F.lit(None).cast("double").alias("b"))
    auto = synthetic.select(F.lit("synthetic_query").alias("code"), F.lit("warning").alias("severity"),
                            num(c("search_sessions")).alias("a"), F.lit(None).cast("double").alias("b"))
    queries = cov.select("queries").scalar()
    starved = experiments.withColumn("_q", queries).filter(
        c("started") & (c("_q") >= 100) & (c("exposures") < F.greatest(F.lit(10.0), c("_q") * 0.01))).agg(
        F.count("*").alias("n"), F.max("_q").alias("q")).filter("n > 0").select(
        F.lit("experiment_starved").alias("code"), F.lit("warning").alias("severity"), num(c("n")).alias("a"), num(c("q")).alias("b"))
    rank = F.when(c("severity") == "critical", 0).when(c("severity") == "warning", 1).otherwise(2)
    return found.unionByName(bad).unionByName(cut).unionByName(auto).unionByName(starved).orderBy(rank, "code")
