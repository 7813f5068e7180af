"""Store-relative labels (CLS-01..04, 11, 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.operators.funnel import Events

# Spellings of the known platforms.
PLATFORMS = {"woo": "woocommerce", "woocommerce": "woocommerce", "wordpress": "woocommerce", "shopify": "shopify",
             "magento": "magento", "magento2": "magento", "custom": "custom"}


def classify_leaks(rows: DataFrame, funnel: DataFrame, cov: DataFrame, min_sessions: int = 5) -> DataFrame:
    """CLS-01: where each query loses shoppers, measured against half the store's own step ratios.

    Adds ``leak_stage`` and ``sessions_below_average`` (measured at the deepest stage
    the store tracks). A store rate of 0 is treated like an unknown one.
    """
    orders_ok = cov.select((F.col("purchase_tracking") & (F.col("purchases") > 0)
                            & (F.col("purchases_with_session") / F.greatest("purchases", F.lit(1)) >= 0.7)).alias("ok"))
    store = funnel.select(F.struct("click_rate", "cart_rate", "purchase_rate")).scalar()
    r = rows.withColumn("_f", store).withColumn("_ok", orders_ok.scalar())
    click, cart = F.col("_f.click_rate"), F.col("_f.cart_rate")
    buy = F.when(F.col("_ok"), F.col("_f.purchase_rate"))
    to_cart, to_buy = F.when(click > 0, cart / click), F.when(cart > 0, buy / cart)
    own_click, own_cart, own_buy = F.col("click_rate"), F.coalesce("cart_rate", F.lit(0.0)), F.col("purchase_rate")
    stage = (F.when((F.coalesce("zero_rate", F.lit(0.0)) >= 0.5) & (F.col("searches") >= 3), "zero_results")
             .when((F.col("search_sessions") < min_sessions) | own_click.isNull(), "unmeasured")
             .when(own_click < click * 0.5, "no_click")
             .when((own_click > 0) & (own_cart / own_click < to_cart * 0.5), "click_no_cart")
             .when(own_buy.isNotNull() & (own_cart > 0) & (own_buy / own_cart < to_buy * 0.5), "cart_no_purchase")
             .otherwise("healthy"))
    gap = F.when(buy > 0, buy - own_buy).when(cart > 0, cart - F.col("cart_rate")).otherwise(click - own_click)
    below = F.coalesce(F.greatest(F.lit(0.0), gap * F.col("search_sessions")), F.lit(0.0))
    below = F.when(gap.isNull(), F.lit(0.0)).otherwise(below)
    return r.withColumn("leak_stage", stage).withColumn(
        "sessions_below_average", F.floor(below * 10 + 0.5) / 10).drop("_f", "_ok")


def suspected_synthetic(rows: DataFrame, searches: DataFrame, min_sessions: int = 200, share: float = 0.25,
                        click: float = 0.01, cart: float = 0.005) -> DataFrame:
    """CLS-02: queries with a large share of all search sessions and next to no clicks or carts."""
    total = searches.filter("s is not null").select("s").distinct().agg(F.count("*").alias("n")).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.withColumn("_n", total).filter(
        (F.col("_n") >= min_sessions) & (F.col("search_sessions") >= F.col("_n") * share)
        & (zero("click_rate") < click) & (zero("cart_rate") < cart)).drop("_n")


def exclude_synthetic(ev: Events, synthetic: DataFrame) -> Events:
    """CLS-03: the same events without the searches of the given queries."""
    return ev.with_searches(ev.searches.join(synthetic.select(F.col("query").alias("q")), "q", "left_anti"))


def catalog_gap(unavailable: Column, chosen: Column, status: Column, sessions: Column, is_zero: Column) -> Column:
    """CLS-04: catalog_gap when 60 % of the chosen clicks and carts are unavailable, else unmeasured / search_problem."""
    gap = (status == "gap") | ((chosen > 0) & (unavailable / F.greatest(chosen, F.lit(1)) >= 0.6))
    return F.when(F.coalesce(gap, F.lit(False)), "catalog_gap").when(
        (sessions < 5) & ~is_zero, "unmeasured").otherwise("search_problem")


def experiment_expiry(df: DataFrame, now: Column) -> DataFrame:
    """CLS-11: pending proposals and running tests past their expiry."""
    return df.filter(F.col("status").isin("pending", "running") & (F.col("expires_at") <= now))


def resolve_platform(signals: DataFrame) -> DataFrame:
    """CLS-12: one platform per shop from several ordered sources; two specific ones are a conflict.

    ``signals`` is (shop, source_order, platform); unknown spellings are ignored and
    ``custom`` never conflicts with a specific platform.
    """
    names = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    p = F.try_element_at(names, F.lower("platform"))
    named = signals.withColumn("_p", p).withColumn("_own", F.when(p != "custom", p))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_order")))
    found = named.groupBy("shop").agg(F.array_sort(F.collect_set("_own")).alias("found"), first("_own").alias("own"),
                                      first("_p").alias("any"))
    clash = F.size("found") > 1
    value = F.when(~clash, F.coalesce("own", "any"))
    return found.select("shop", F.when(clash, "conflict").when(value.isNull(), "unknown").otherwise("known").alias("state"),
                        value.alias("platform"))
