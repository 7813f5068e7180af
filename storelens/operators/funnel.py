"""Conversion funnels, coverage and activity (AGG-01..11, 19..24, 39, 40; SRT-01, 05)."""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions.numbers import local_day, money, ratio
from storelens.operators.attribution import WINDOWS, attributed_stages, stage_events, unique_purchases
from storelens.session import written

STAGES = ("click", "cart", "checkout", "purchase")


class Events:
    """The five normalised event tables and the source status table of one store.

    Reports do not read the raw tables. ``log`` is written once, a folder per kind, with orders
    already unique; every table of the bundle is a scan of its kinds. ``attributed`` is the
    stage table after both as-of joins, written once per set of windows: all reports on
    what followed a search aggregate it and join nothing. Copies of a bundle share both.
    """

    SEARCH = ("event_id", "q", "s", "t", "delivered", "zero", "names")
    PRODUCT = ("event_id", "kind", "q", "s", "t", "pid", "name", "url")
    STAGE = (*PRODUCT, "order_id", "total", "currency", "items", "copies")

    def __init__(self, searches: DataFrame, clicks: DataFrame, carts: DataFrame, checkouts: DataFrame,
                 purchases: DataFrame, sources: DataFrame | None = None):
        self._raw, self.sources, self._kept = (searches, clicks, carts, checkouts, purchases), sources, {}

    def _keep(self, name, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(make(), "kind")
        return self._kept[name]

    @property
    def log(self) -> DataFrame:
        searches, clicks, carts, checkouts, purchases = self._raw
        stages = lambda: stage_events(clicks, carts, checkouts, unique_purchases(purchases))
        asked = searches.withColumn("kind", F.lit("search")).select("kind", *self.SEARCH)
        return self._keep("log", lambda: stages().unionByName(asked, allowMissingColumns=True))

    def _of(self, kind: str, *columns: str) -> DataFrame:
        return self.log.filter(F.col("kind") == kind).select(*columns)

    @property
    def searches(self) -> DataFrame:
        return self._kept["searches"] if "searches" in self._kept else self._of("search", *self.SEARCH)

    @property
    def clicks(self) -> DataFrame:
        return self._of("click", *self.PRODUCT)

    @property
    def carts(self) -> DataFrame:
        return self._of("cart", *self.PRODUCT)

    @property
    def checkouts(self) -> DataFrame:
        return self._of("checkout", "event_id", "q", "s", "t")

    @property
    def orders(self) -> DataFrame:
        """Unique purchases, with the number of rows each stands for."""
        return self._of("purchase", "event_id", "q", "s", "t", "order_id", "total", "currency", "items", "copies")

    @property
    def stages(self) -> DataFrame:
        return self.log.filter(F.col("kind") != "search").select(*self.STAGE)

    def attributed(self, windows: dict[str, int] = WINDOWS) -> DataFrame:
        """The stage rows with hit_q, hit_t, aq, how and searched (``attribution.attributed_stages``)."""
        return self._keep(tuple(sorted(windows.items())), lambda: attributed_stages(self.stages, self.searches, windows))

    def with_searches(self, searches: DataFrame) -> "Events":
        """The same stage rows with other searches."""
        new = copy(self)
        new._kept = {"log": self.log, "searches": searches}
        return new


def _flag(cond: Column) -> Column:
    return F.max(F.coalesce(cond, F.lit(False)).cast("int"))


def session_stages(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """One row per session: searched, any cart / order, and the stages reached after a search."""
    found = ev.attributed(windows).filter("s is not null")
    long = found.select("s", "kind", F.col("hit_q").isNotNull().alias("hit")).unionByName(
        ev.searches.filter("s is not null").select("s", F.lit("search").alias("kind"), F.lit(True).alias("hit")))
    k, hit = F.col("kind"), F.col("hit")
    return long.groupBy("s").agg(
        _flag(k == "search").alias("searched"),
        *[_flag((k == x) & hit).alias(f"{x}_after") for x in STAGES],
        *[_flag(k == x).alias(f"any_{x}") for x in STAGES])


def store_funnel(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """AGG-01: distinct sessions per stage and their rates over searching sessions (one row)."""
    one = session_stages(ev, windows).agg(
        F.count("*").alias("sessions"), F.sum("searched").alias("searched"), F.sum("click_after").alias("clicked"),
        F.sum("cart_after").alias("carted"), F.sum("checkout_after").alias("checkout"),
        F.sum("purchase_after").alias("purchased"))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in one.columns}
    bought = ev.orders.agg((F.count("*") > 0).alias("b")).scalar()
    return one.select(*[v.alias(k) for k, v in n.items()],
                      ratio(n["clicked"], n["searched"]).alias("click_rate"),
                      ratio(n["carted"], n["searched"]).alias("cart_rate"),
                      ratio(n["checkout"], n["searched"]).alias("checkout_rate"),
                      F.when(bought, ratio(n["purchased"], n["searched"])).alias("purchase_rate"))


def assisted_orders(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Unique orders with ``via`` = explicit / inferred / null; a tag counts without a session."""
    via = F.when(F.col("q") != "", "explicit").when(F.col("hit_q").isNotNull(), "inferred")
    return ev.attributed(windows).filter("kind = 'purchase'").select(
        "event_id", "kind", "q", "s", "t", "order_id", "total", "currency", "copies", via.alias("via"))


def order_assistance(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """AGG-02: orders, dropped duplicates and how many came through search (one row)."""
    via = F.col("via")
    return assisted_orders(ev, windows).agg(
        F.count("*").alias("orders"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count(via).alias("search_assisted"), F.count_if(via == "explicit").alias("explicit"),
        F.count_if(via == "inferred").alias("inferred"), F.count("s").alias("with_session"))


def revenue_by_currency(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """AGG-03: amount, orders and average order per currency, in total and search-assisted."""
    rows = assisted_orders(ev, windows).filter("total is not null")
    scoped = rows.withColumn("scope", F.explode(F.when(
        F.col("via").isNotNull(), F.array(F.lit("total"), F.lit("search_assisted"))).otherwise(F.array(F.lit("total")))))
    return scoped.groupBy("scope", F.coalesce("currency", F.lit("—")).alias("currency")).agg(
        money(F.sum("total")).alias("amount"), F.count("*").alias("orders")).withColumn(
        "average_order", money(F.col("amount") / F.col("orders")))


def cart_session_purchase_rate(ev: Events) -> DataFrame:
    """AGG-04: purchase share of cart sessions, with and without a search (one row)."""
    bit = lambda df, name: df.filter("s is not null").select("s", F.lit(name).alias("k"))
    per = bit(ev.carts, "cart").unionByName(bit(ev.orders, "order")).unionByName(bit(ev.searches, "search"))
    flags = per.groupBy("s").agg(*[_flag(F.col("k") == x).alias(x) for x in ("cart", "order", "search")])
    bought = ev.orders.agg((F.count("*") > 0).alias("b")).scalar()
    carted, searched = F.col("cart") == 1, F.col("search") == 1
    one = flags.agg(F.count_if(carted & searched).alias("with_search_sessions"),
                    F.count_if(carted & ~searched).alias("without_search_sessions"),
                    F.count_if(carted & searched & (F.col("order") == 1)).alias("_w"),
                    F.count_if(carted & ~searched & (F.col("order") == 1)).alias("_o"))
    return one.select("with_search_sessions", "without_search_sessions",
                      F.when(bought, ratio(F.col("_w"), F.col("with_search_sessions"))).alias("with_search"),
                      F.when(bought, ratio(F.col("_o"), F.col("without_search_sessions"))).alias("without_search"))


def coverage(ev: Events) -> DataFrame:
    """AGG-05: how many events carry a session, a tag or a result count, and the tracking flags (one row)."""
    def part(df, kind, tag=F.lit(False), zero=F.lit(None).cast("boolean")):
        return df.select(F.lit(kind).alias("k"), "s", tag.alias("tag"), zero.alias("z"))

    tag = F.col("q") != ""
    rows = (part(ev.searches, "query", zero=F.col("zero")).unionByName(part(ev.clicks, "click", tag))
            .unionByName(part(ev.carts, "cart", tag)).unionByName(part(ev.checkouts, "checkout"))
            .unionByName(part(ev.orders, "order", tag)))
    k = F.col("k")
    n = lambda cond, name: F.count_if(cond).alias(name)
    seen = rows.filter("s is not null").groupBy("s").agg(
        _flag(k.isin("click", "cart")).alias("early"), _flag(k == "order").alias("bought"))
    share = seen.agg(ratio(F.sum(F.col("early") * F.col("bought")), F.sum("bought")).alias("r")).scalar()
    counts = rows.agg(
        n(k == "query", "queries"), n((k == "query") & F.col("s").isNotNull(), "queries_with_session"),
        n((k == "query") & F.col("z").isNotNull(), "queries_with_result_count"), n(k == "click", "clicks"),
        n((k == "click") & F.col("tag"), "clicks_tagged"), n(k == "cart", "carts"),
        n((k == "cart") & F.col("tag"), "carts_tagged"), n(k == "order", "purchases"),
        n((k == "order") & F.col("tag"), "purchases_tagged"),
        n((k == "order") & F.col("s").isNotNull(), "purchases_with_session"),
        (F.count_if(k == "checkout") > 0).alias("checkout_tracking"))
    tracked = F.col("purchases") > 0
    if ev.sources is not None:
        ok = ev.sources.agg(F.coalesce(F.bool_or((F.col("source") == "checkout_events") & (F.col("status") == "ok")),
                                       F.lit(False)).alias("ok")).scalar()
        tracked = tracked & ok
    return counts.withColumn("purchase_tracking", tracked).withColumn("purchase_sessions_seen_before", share)


def query_funnel(ev: Events, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """AGG-06: one row per query with counts, distinct stage sessions and rates.

    (query, session) is aggregated before query, so distinct counts need no
    row expansion and a query or a null session holding most rows is combined
    before the shuffle.
    """
    attributed = ev.attributed(windows).filter("aq is not null")
    searches = ev.searches.select(
        F.col("q").alias("aq"), "s", F.lit("search").alias("kind"), F.lit(None).cast("string").alias("how"),
        F.lit(False).alias("searched"), "zero",
        F.when(F.size("names") > 0, F.struct("t", (-F.col("event_id")).alias("i"),
                                             F.slice("names", 1, 6).alias("names"))).alias("shown"))
    rows = attributed.select("aq", "s", "kind", "how", "searched").unionByName(searches, allowMissingColumns=True)
    k = F.col("kind")
    per_session = rows.groupBy("aq", "s").agg(
        F.count_if(k == "search").alias("searches"), F.count("zero").alias("measured"),
        F.count_if(F.col("zero")).alias("zeros"), F.max("shown").alias("shown"),
        *[F.count_if(k == x).alias(f"n_{x}") for x in STAGES],
        *[_flag((k == x) & F.col("searched")).alias(f"r_{x}") for x in STAGES],
        F.count_if((k == "purchase") & (F.col("how") == "explicit")).alias("n_explicit"))
    in_session = F.col("s").isNotNull()
    per_query = per_session.groupBy(F.col("aq").alias("query")).agg(
        F.sum("searches").alias("searches"),
        F.count_if(in_session & (F.col("searches") > 0)).alias("search_sessions"),
        F.coalesce(F.sum(F.when(~in_session, F.col("searches"))), F.lit(0)).alias("missing_session"),
        F.sum("zeros").alias("zero_searches"), F.sum("measured").alias("measured_searches"),
        F.sum("n_click").alias("clicks"), F.sum("n_cart").alias("carts"), F.sum("n_checkout").alias("checkouts"),
        F.sum("n_purchase").alias("purchases"), F.sum("n_explicit").alias("explicit_purchases"),
        *[F.sum(F.when(in_session, F.col(f"r_{x}")).otherwise(0)).alias(f"{x}_sessions") for x in STAGES],
        F.max("shown").alias("shown"))
    revenue = (attributed.filter((k == "purchase") & F.col("total").isNotNull())
               .groupBy(F.col("aq").alias("query"), "currency").agg(money(F.sum("total")).alias("amount"),
                                                                    F.count("*").alias("orders"))
               .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("amount", "currency", "orders")), False)
                                     .alias("attributed_revenue")))
    bought = ev.orders.agg((F.count("*") > 0).alias("b")).scalar()
    d = F.col("search_sessions")
    empty = F.array().cast("array<string>")
    return per_query.join(revenue, "query", "left").filter(
        "searches > 0 or clicks > 0 or carts > 0 or purchases > 0").select(
        "query", "searches", "search_sessions", "missing_session", "zero_searches", "measured_searches",
        "clicks", "carts", "checkouts", "purchases", "explicit_purchases",
        (F.col("purchases") - F.col("explicit_purchases")).alias("inferred_purchases"),
        "click_sessions", "cart_sessions", "checkout_sessions", "purchase_sessions",
        ratio(F.col("zero_searches"), F.col("measured_searches")).alias("zero_rate"),
        ratio(F.col("click_sessions"), d).alias("click_rate"), ratio(F.col("cart_sessions"), d).alias("cart_rate"),
        F.when(bought, ratio(F.col("purchase_sessions"), d)).alias("purchase_rate"),
        "attributed_revenue", F.coalesce(F.col("shown.names"), empty).alias("delivered"))


def latest_delivered(searches: DataFrame, n: int = 6) -> DataFrame:
    """AGG-07: the newest non-empty result list of each query, first ``n`` names."""
    return searches.filter(F.size("names") > 0).groupBy(F.col("q").alias("query")).agg(
        F.max_by(F.slice("names", 1, n), F.struct("t", -F.col("event_id"))).alias("delivered"))


def measurable(cov: DataFrame, sources: DataFrame) -> DataFrame:
    """Which stages may carry rates: complete sources, 70 % sessions, purchase sessions that were seen (one row)."""
    whole = lambda name: F.coalesce(F.bool_or((F.col("source") == name) & (F.col("status") == "ok")
                                              & ~F.col("truncated")), F.lit(False))
    flags = sources.agg(F.struct(*[whole(n).alias(n) for n in
                                   ("queries", "product_clicks", "cart", "checkout_events")]).alias("w")).scalar()
    c, w = F.col, F.col("_w")
    search = w["queries"] & F.coalesce(ratio(c("queries_with_session"), c("queries")) >= 0.7, F.lit(False))
    seen = c("purchase_sessions_seen_before")
    orders_ok = F.coalesce(ratio(c("purchases_with_session"), c("purchases")) >= 0.7, F.lit(False)) & \
        ~((c("purchases") >= 20) & F.coalesce(seen < 0.3, F.lit(False)))
    return cov.withColumn("_w", flags).select(
        (search & w["product_clicks"]).alias("click"), (search & w["cart"]).alias("cart"),
        (search & w["checkout_events"] & c("checkout_tracking")).alias("checkout"),
        (search & w["checkout_events"] & c("purchase_tracking") & orders_ok).alias("purchase"))


def measured_funnel(funnel: DataFrame, can: DataFrame) -> DataFrame:
    """AGG-08, store part: rates nulled where the stage is not measurable."""
    m = can.select(F.struct("click", "cart", "checkout", "purchase")).scalar()
    out = funnel.withColumn("_m", m)
    for x in STAGES:
        out = out.withColumn(f"{x}_rate", F.when(F.col("_m")[x], F.col(f"{x}_rate")))
    return out.drop("_m")


def measured_queries(rows: DataFrame, can: DataFrame) -> DataFrame:
    """AGG-08, query part: also needs 70 % of the query's own searches to carry a session."""
    m = can.select(F.struct("click", "cart", "purchase")).scalar()
    covered = (F.col("searches") > 0) & ((F.col("searches") - F.col("missing_session")) / F.col("searches") >= 0.7)
    out = rows.withColumn("_m", m).withColumn("_c", F.coalesce(covered, F.lit(False)))
    for x in ("click", "cart", "purchase"):
        out = out.withColumn(f"{x}_rate", F.when(F.col("_m")[x] & F.col("_c"), F.col(f"{x}_rate")))
    return out.drop("_m", "_c")


def measured_conversion(ev: Events, windows: dict[str, int] = WINDOWS) -> tuple[DataFrame, DataFrame]:
    """AGG-08: store funnel and query funnel with unmeasurable rates nulled."""
    can = measurable(coverage(ev), ev.sources)
    return measured_funnel(store_funnel(ev, windows), can), measured_queries(query_funnel(ev, windows), can)


def customer_report(ev: Events, windows: dict[str, int]) -> DataFrame:
    """AGG-09: the older per-query report: one window for all stages, rates only from complete sources
    and, for purchases, only when some purchase matched a searching session."""
    rows = query_funnel(ev, windows)
    whole = F.lit(True)
    if ev.sources is not None:
        whole = ev.sources.agg(F.bool_and((F.col("status") == "ok") & ~F.col("truncated")).alias("c")).scalar()
    evidence = rows.agg(F.coalesce(F.max("purchase_sessions"), F.lit(0)).alias("m")).scalar() > 0
    keep = lambda cond, c: F.when(cond, F.col(c)).alias(c)
    return rows.select("query", "searches", "search_sessions", "clicks", "carts", "purchases", "explicit_purchases",
                       "inferred_purchases", F.col("purchase_sessions").alias("converted_sessions"),
                       F.col("zero_searches").alias("zero_results"), F.col("measured_searches").alias("measured_results"),
                       keep(whole, "click_rate"), keep(whole, "cart_rate"), keep(whole & evidence, "purchase_rate"))


def product_totals(ev: Events, cards: DataFrame) -> DataFrame:
    """AGG-10: clicks, carts and purchase lines per product id, with the card's title and availability."""
    rows = (ev.clicks.unionByName(ev.carts).select("kind", "pid")
            .unionByName(ev.orders.select(F.lit("purchase").alias("kind"), F.explode("items").alias("i"))
                         .select("kind", F.col("i.pid").alias("pid"))).filter("pid <> ''"))
    k = F.col("kind")
    totals = rows.groupBy(F.col("pid").alias("id")).agg(
        F.count_if(k == "click").alias("clicks"), F.count_if(k == "cart").alias("carts"),
        F.count_if(k == "purchase").alias("purchases"))
    c = cards.select("id", "title", (~F.col("hidden") & (F.col("stock_status") == "instock")).alias("_ok"))
    return totals.join(c, "id", "left").select(
        "id", "clicks", "carts", "purchases", "title", F.col("_ok").isNotNull().alias("in_catalog"),
        F.coalesce("_ok", F.lit(False)).alias("available"))


def products_of(events: DataFrame) -> DataFrame:
    """AGG-11: events per product key (id, else name) with its first non-empty name and url."""
    key = F.when(F.col("pid") != "", F.col("pid")).otherwise(F.col("name"))
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(
        F.col(c) != "", F.struct("t", "event_id"))), F.lit("")).alias(c)
    return events.withColumn("product", key).filter("product <> ''").groupBy("product").agg(
        F.count("*").alias("events"), first("name"), first("url"))


def daily_activity(ev: Events, tz: str = "Asia/Jerusalem") -> DataFrame:
    """AGG-19: events per local day and stage, with the two kinds of gap days."""
    part = lambda df, k: df.select("t", F.lit(k).alias("k"))
    rows = part(ev.searches, "search").unionByName(ev.stages.select("t", F.col("kind").alias("k")))
    k = F.col("k")
    days = rows.groupBy(local_day(F.col("t"), tz).alias("day")).agg(
        F.count_if(k == "search").alias("searches"), F.count_if(k == "click").alias("clicks"),
        F.count_if(k == "cart").alias("carts"), F.count_if(k == "checkout").alias("checkouts"),
        F.count_if(k == "purchase").alias("purchases"))
    active = (F.col("clicks") > 0) | (F.col("carts") > 0)
    return days.withColumn("search_log_gap", active & (F.col("searches") == 0)).withColumn(
        "tracking_gap", (F.col("searches") >= 10) & ~active)


def shopper_activity(ev: Events) -> DataFrame:
    """AGG-20: events and sessions per query over the three logs; sessions of untagged visitors count as one."""
    part = lambda df, k: df.filter("q <> ''").select("q", F.lit(k).alias("k"), F.coalesce("s", F.lit("∅")).alias("s"))
    rows = part(ev.searches, "search").unionByName(part(ev.clicks, "click")).unionByName(part(ev.carts, "cart"))
    k = F.col("k")
    n = lambda x: F.count_if(k == x)
    per = rows.groupBy("q", "s").agg(n("search").alias("a"), n("click").alias("b"), n("cart").alias("c"))
    return per.groupBy(F.col("q").alias("query")).agg(
        F.sum("a").alias("searches"), F.count_if(F.col("b") > 0).alias("click_sessions"), F.sum("b").alias("clicks"),
        F.count_if(F.col("c") > 0).alias("cart_sessions"), F.sum("c").alias("carts"))


def logging_gap(ev: Events) -> DataFrame:
    """AGG-20, gap part: silent click days, and whether they are at least half of two or more (one row, UTC days)."""
    days = daily_activity(ev, "UTC")
    clicked = F.col("clicks") > 0
    one = days.agg(F.count_if(clicked).alias("click_days"),
                   F.count_if(clicked & (F.col("searches") == 0)).alias("silent_days"))
    return one.withColumn("gap", (F.col("click_days") >= 2) & (
        F.col("silent_days") >= F.ceil(F.col("click_days") / 2)))


def top_zero_searches(counters: DataFrame, since: Column, n: int = 15) -> DataFrame:
    """AGG-21: zero-result counters seen since, most hits first."""
    return counters.filter(F.col("last_seen") >= since).orderBy(F.col("hits").desc(), "query").limit(n)


def experiment_exposures(exposures: DataFrame, running: DataFrame, since: Column) -> DataFrame:
    """AGG-23: exposures of every running experiment since a date, zero-filled."""
    counts = exposures.filter(F.col("t") >= since).groupBy("experiment_id").agg(F.count("*").alias("n"))
    return running.join(counts, "experiment_id", "left").withColumn(
        "exposures", F.coalesce("n", F.lit(0))).drop("n")


def query_signals(ev: Events, raw_queries: DataFrame) -> DataFrame:
    """AGG-24: per query its most frequent spelling, result-count and interaction counts.

    ``raw_queries`` is (q, form, delivered); unknown result counts are not zero.
    """
    forms = raw_queries.groupBy("q", "form").agg(F.count("*").alias("n"), F.count("delivered").alias("measured"),
                                                 F.count_if(F.col("delivered") == 0).alias("zero"))
    spelled = forms.groupBy("q").agg(
        F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("query"), F.sum("n").alias("searches"),
        F.sum("measured").alias("measured_results"), F.sum("zero").alias("zero_results"))
    hits = ev.clicks.unionByName(ev.carts).filter("q <> ''").groupBy("q").agg(
        F.count_if(F.col("kind") == "cart").alias("carts"), F.count_if(F.col("kind") == "click").alias("clicks"))
    j = spelled.join(hits, "q", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.col("q").alias("key"), F.coalesce("query", "q").alias("query"), zero("searches"),
                    zero("measured_results"), zero("zero_results"), zero("carts"), zero("clicks"))


def signal_lists(signals: DataFrame, n: int = 30) -> DataFrame:
    """AGG-24, report lists: top, failed, converting, clicked and never-clicked queries with their rank."""
    c = F.col
    tracked = signals.agg((F.sum("clicks") > 0).alias("x")).scalar()
    lists = [("top", c("searches") > 0, c("searches")), ("failed", c("zero_results") > 0, c("zero_results")),
             ("converting", c("carts") > 0, c("carts")), ("clicked", c("clicks") > 0, c("clicks")),
             ("no_clicks", (c("searches") >= 3) & (c("clicks") == 0) & (c("carts") == 0) & c("_tracked"), c("searches"))]
    rows = signals.withColumn("_tracked", tracked).select("key", "query", F.explode(F.filter(F.array(
        *[F.when(cond, F.struct(F.lit(name).alias("list"), by.alias("score"))) for name, cond, by in lists]),
        lambda x: x.isNotNull())).alias("l")).select("key", "query", "l.list", "l.score")
    w = Window.partitionBy("list").orderBy(F.col("score").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rule_trigger_counts(counters: DataFrame, today: Column) -> DataFrame:
    """AGG-39: sum of the daily counters of today and yesterday per rule."""
    return counters.filter(F.col("day").between(F.date_sub(today, 1), today)).groupBy("rule_id").agg(
        F.sum("n").alias("triggers"))


def latency_stats(checks: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG-40: samples, upper median and maximum per group.

    The upper median is the element at position floor(n / 2) of the ordered
    values; equal values are counted first so that no group is collected.
    """
    v = checks.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = v.withColumn("upto", F.sum("c").over(w))
    total = checks.groupBy(*by).agg(F.count(value).alias("samples"), F.max(value).alias("max"))
    hit = F.col("upto") > F.floor(F.col("samples") / 2)
    return upto.join(total, by).groupBy(*by, "samples", "max").agg(F.min(F.when(hit, F.col(value))).alias("median"))


def rank_queries(rows: DataFrame, sort: str = "searches", limit: int = 20, min_sessions: int = 20,
                 query: str = "") -> DataFrame:
    """SRT-01: query rows in report order, eligible ones only when sorted by conversion."""
    c = F.col
    rate = F.coalesce("purchase_rate", "cart_rate")
    if query:
        rows = rows.filter(c("query").contains(query))
    elif sort in ("low_conversion", "high_conversion"):
        rows = rows.filter((c("search_sessions") >= min_sessions) & rate.isNotNull())
    order = {"low_conversion": [F.coalesce(rate, F.lit(0.0)), c("search_sessions").desc()],
             "high_conversion": [F.coalesce(rate, F.lit(0.0)).desc(), c("search_sessions").desc()],
             "opportunity": [F.coalesce("sessions_below_average", F.lit(0.0)).desc(), c("searches").desc()],
             }.get(sort) or [c(sort).desc(), c("searches").desc()]
    return rows.orderBy(*order, "query").limit(limit)


def compact_rows(rows: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """SRT-05: the leading rows whose JSON fits a character budget.

    A row takes at least two characters, so no row past ``budget / 2`` can fit and
    the running sum only has to see those.
    """
    rows = rows.orderBy(*order).limit(budget // 2)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.length(F.to_json(F.struct(*rows.columns)))).over(w)
    return rows.withColumn("_used", used).filter(F.col("_used") <= budget).drop("_used")


def report_digest(rows: DataFrame, n: int = 20) -> DataFrame:
    """AGG-44: the compact projection of a report's top queries, without any session id."""
    return rank_queries(rows, "searches", n).select(
        F.col("query").alias("q"), F.col("searches").alias("s"), F.col("search_sessions").alias("ss"),
        F.col("zero_rate").alias("zero"), F.col("click_rate").alias("click"), F.col("cart_rate").alias("cart"),
        F.col("purchase_rate").alias("buy"))
