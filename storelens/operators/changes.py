"""Changes to the catalog: feeds, crawls, tags, boosts and their audits (CAT-01..17, JOI-08, 10..12, SNK-02, 04)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from storelens.operators.baseline import baseline_regressions
from storelens.operators.catalog import EMPTY, find_by_words, legal_claim_check, map_of, merge_maps, source_specifications

c = F.col
ON_SALE = ("instock", "onbackorder")
FEED_FIELDS = ("price", "regular_price", "stock_status", "image", "price_range", "variants", "images")


def feed_guard(cards: DataFrame, feed: DataFrame) -> DataFrame:
    """CAT-02: live cards, published feed rows and whether the feed is refused as a failed read (one row)."""
    live = cards.agg(F.count_if(~c("hidden")).alias("n")).scalar()
    return feed.agg(F.count_if("published").alias("published")).withColumn("live", live).withColumn(
        "refused", (c("live") >= 20) & (c("published") < c("live") * 0.5))


def apply_feed(cards: DataFrame, feed: DataFrame, fields: tuple[str, ...] = FEED_FIELDS, check: bool = True) -> DataFrame:
    """CAT-01: cards after the feed, each with its outcome.

    Commerce fields are overlaid; new published rows are added; missing or
    unpublished products are hidden and marked; only what the feed hid is restored.
    Cards need hidden and feed_hidden; feed rows id, title, published and the fields.
    """
    used = [f for f in fields if f in cards.columns and f in feed.columns]
    f = feed.select("id", c("published").alias("_pub"), c("title").alias("_title"), *[c(x).alias(f"_n_{x}") for x in used])
    if check:
        stop = feed_guard(cards, feed).select("refused").scalar()
        f = f.withColumn("_pub", F.when(stop, F.raise_error(F.lit("feed lost most of the catalog")).cast("boolean")).otherwise(c("_pub")))
    j = cards.withColumn("_card", F.lit(True)).join(f, "id", "full_outer")
    old, new = c("_card").isNotNull(), c("_pub").isNotNull()
    take = lambda x: new & (c(f"_n_{x}").isNotNull() if x == "image" else F.lit(True))
    changed = F.lit(False)
    for x in used:
        changed = changed | (take(x) & ~c(x).eqNullSafe(c(f"_n_{x}")))
    hidden, by_feed = F.coalesce("hidden", F.lit(False)), F.coalesce("feed_hidden", F.lit(False))
    leaves = old & ~hidden & (~new | ~c("_pub"))
    returns = old & new & c("_pub") & by_feed
    outcome = (F.when(~old & c("_pub"), "added").when(~old, "ignored").when(leaves, "removed").when(returns, "restored")
               .when(new & changed, "updated").when(new, "unchanged").otherwise("kept"))
    out = j.withColumn("outcome", outcome).filter("outcome <> 'ignored'")
    keep = [x for x in cards.columns if x not in used + ["id", "hidden", "feed_hidden", "title"]]
    return out.select("id", F.coalesce("title", "_title").alias("title"), *keep,
                      *[F.when(take(x), c(f"_n_{x}")).otherwise(c(x)).alias(x) for x in used],
                      F.when(leaves, True).when(returns, False).otherwise(hidden).alias("hidden"),
                      F.when(leaves, True).when(returns, False).otherwise(by_feed).alias("feed_hidden"), "outcome")


def outcome_counts(applied: DataFrame) -> DataFrame:
    """CAT-01, counts: products per outcome."""
    return applied.groupBy("outcome").agg(F.count("*").alias("n"))


def merge_crawl(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """CAT-03: crawled pages laid over the cards by ``key``: missing specs, description and categories are
    filled, price and known stock refreshed, unseen products added; ``change`` says which."""
    p = pages.select("key", c("name").alias("_name"), c("price").alias("_price"), c("stock_status").alias("_stock"),
                     c("description").alias("_desc"), c("categories").alias("_cats"),
                     merge_maps(c("extra"), map_of({"author": c("author"), "publisher": c("publisher")})).alias("_specs"))
    j = cards.withColumn("_card", F.lit(True)).join(p, "key", "full_outer")
    old, new = c("_card").isNotNull(), c("_specs").isNotNull()
    j = j.withColumn("_all", F.when(new, merge_maps(c("_specs"), c("specifications"))).otherwise(c("specifications")))
    specs = c("_all")
    stock = F.when(new & (c("_stock") != "unknown"), c("_stock")).otherwise(c("stock_status"))
    price = F.coalesce("_price", "price")
    no_desc, no_cats = F.coalesce("description", F.lit("")) == "", F.coalesce(F.size("categories"), F.lit(0)) <= 0
    desc = F.when(no_desc, F.coalesce("_desc", "description")).otherwise(c("description"))
    cats = F.when(no_cats, F.coalesce("_cats", "categories")).otherwise(c("categories"))
    touched = new & (~stock.eqNullSafe(c("stock_status")) | ~price.eqNullSafe(c("price")) | ~desc.eqNullSafe(c("description"))
                     | ~cats.eqNullSafe(c("categories")) | (F.size(specs) > F.size("specifications")))
    return j.select("key", F.coalesce("title", "_name").alias("title"), price.alias("price"), F.coalesce(stock, F.lit("unknown")).alias("stock_status"),
                    desc.alias("description"), cats.alias("categories"), specs.alias("specifications"),
                    F.when(~old, "added").when(touched, "updated").otherwise("unchanged").alias("change"),
                    (old & ~stock.eqNullSafe(c("stock_status"))).alias("stock_changed"),
                    (old & F.coalesce(F.map_contains_key("_specs", "author"), F.lit(False))
                     & ~F.coalesce(F.map_contains_key("specifications", "author"), F.lit(False))).alias("author_filled"))


def apply_scan(rows: DataFrame, pages: DataFrame, max_lost: float = 0.2) -> DataFrame:
    """CAT-04: the writes a scan asks for (key, op, stock_status, price, regular_price, lost), all held back
    (``held_back``) when more than ``max_lost`` of the rows would leave sale."""
    p = pages.select("key", c("product_id").alias("_pid"), c("stock_status").alias("_stock"), c("price").alias("_price"),
                     c("regular_price").alias("_regular"))
    j = p.join(rows.select("key", "stock_status", "price", "regular_price", F.lit(True).alias("_row")), "key", "left")
    known = c("_row").isNotNull()
    stock = F.when(c("_stock").isNotNull() & (c("_stock") != "unknown") & ~c("_stock").eqNullSafe(c("stock_status")), c("_stock"))
    price = F.when(c("_price").isNotNull() & ~c("_price").eqNullSafe(c("price")), c("_price"))
    regular = F.when(c("_regular").isNotNull() & ~c("_regular").eqNullSafe(c("regular_price")), c("_regular"))
    op = F.when(~known & c("_pid").isNotNull() & c("_stock").isin(*ON_SALE), "insert").when(
        known & F.coalesce(stock, price.cast("string"), regular.cast("string")).isNotNull(), "update")
    new = lambda upd, val: F.when(known, upd).otherwise(val)
    writes = j.withColumn("op", op).filter("op is not null").select(
        "key", "op", new(stock, c("_stock")).alias("stock_status"), new(price, c("_price")).alias("price"),
        new(regular, F.coalesce("_regular", "_price")).alias("regular_price"),
        (known & c("stock_status").isin(*ON_SALE) & stock.isNotNull() & ~F.coalesce(stock.isin(*ON_SALE), F.lit(False))).alias("lost"))
    total = rows.agg(F.count("*").alias("n")).scalar()
    lost = writes.agg(F.count_if("lost").alias("n")).scalar()
    return writes.withColumn("held_back", lost > total * max_lost)


def sweep_listing(old: DataFrame, listing: DataFrame, fields: tuple[str, ...] = (
        "product_id", "name", "url", "image", "price", "regular_price", "stock_status")) -> DataFrame:
    """CAT-05: every listed key with whether it is new or differs in one of the compared fields."""
    o = old.select("key", F.struct(*fields).alias("_o"), F.lit(True).alias("_known"))
    j = listing.join(o, "key", "left")
    same = F.struct(*fields).eqNullSafe(c("_o"))
    return j.select("key", F.when(c("_known").isNull(), "new").when(same, "same").otherwise("changed").alias("state"))


def refresh_source_fields(cards: DataFrame, source: DataFrame) -> DataFrame:
    """CAT-06: the source's own fields copied over the cards' specifications; ``copied`` lists the fields."""
    s = source_specifications(source.withColumn("specifications", F.coalesce("specifications", F.create_map().cast("map<string,string>")))
                              if "specifications" in source.columns else source.withColumn("specifications", F.create_map().cast("map<string,string>")))
    s = s.select("id", c("specifications").alias("_s"))
    j = cards.join(s, "id", "left")
    return j.withColumn("specifications", merge_maps(c("specifications"), c("_s"))).withColumn(
        "copied", F.coalesce(F.array_sort(F.map_keys("_s")), EMPTY())).drop("_s")


def reusable_enrichment(cur: DataFrame, prev: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """CAT-07: reuse / redo per product: same source hash, no error and young enough."""
    p = prev.select("id", c("source_hash").alias("_h"), c("error").alias("_e"), c("enriched_at").alias("_at"))
    fresh = (c("_h") == c("content_hash")) & c("_e").isNull() & (
        F.unix_micros(now) - F.unix_micros("_at") < max_age_hours * 3_600_000_000)
    return cur.join(p, "id", "left").select("id", F.when(F.coalesce(fresh, F.lit(False)), "reuse").otherwise("redo").alias("plan"))


def reclassify_plan(products: DataFrame, tags: dict[str, str], prior: DataFrame) -> DataFrame:
    """CAT-08: (tag, product) pairs without a usable decision for the product's and the definition's current hash.

    ``tags`` maps a tag to its definition hash; ``prior`` is (tag, id, product_hash, definition_hash, status).
    """
    every = products.select("id", c("content_hash").alias("product_hash"), F.inline(F.array(*[
        F.struct(F.lit(t).alias("tag"), F.lit(h).alias("definition_hash")) for t, h in tags.items()])))
    keys = ["tag", "id", "product_hash", "definition_hash"]
    return every.join(prior.filter("status <> 'failed'").select(*keys), keys, "left_anti")


def apply_tag(df: DataFrame, tag: str, selection: Column, remove: bool = False) -> DataFrame:
    """CAT-09: the tag added to (or removed from) the selected products; ``changed`` marks them."""
    has = F.array_contains("tags", tag)
    change = selection & (has if remove else ~has)
    new = F.array_remove("tags", tag) if remove else F.concat("tags", F.array(F.lit(tag)))
    return df.withColumn("changed", change).withColumn("tags", F.when(change, new).otherwise(c("tags")))


def apply_filter_tag(products: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """CAT-10: selected visible products with the tag added (case-insensitively once) and the tags before it.

    ``complete`` is false on every row when a selected id is unknown or hidden.
    """
    chosen = ids.select("id").distinct()
    hit = products.filter(~c("hidden")).join(chosen, "id", "left_semi")
    asked, found = chosen.agg(F.count("*").alias("n")).scalar(), hit.agg(F.count_distinct("id").alias("n")).scalar()
    has = F.exists("tags", lambda t: F.lower(t) == tag.lower())
    return hit.select("id", c("tags").alias("tags_before"),
                      F.when(has, c("tags")).otherwise(F.concat("tags", F.array(F.lit(tag)))).alias("tags"),
                      (asked == found).alias("complete"))


def propose_boost(products: DataFrame, term: str, level: int, in_stock_only: bool = True) -> DataFrame:
    """CAT-11: products by words whose boost would change, with the value before."""
    level = max(0, min(3, level))
    change = c("boost").isNotNull() if level == 0 else ~c("boost").eqNullSafe(F.lit(level))
    return find_by_words(products, term, in_stock_only).filter(change).select(
        "id", c("boost").alias("boost_before"), F.lit(level or None).cast("int").alias("boost"))


def propose_visibility(products: DataFrame, term: str, hidden: bool) -> DataFrame:
    """CAT-11: products by words whose hidden flag would change, with the value before."""
    return find_by_words(products, term, False, True).filter(c("hidden") != hidden).select(
        "id", c("hidden").alias("hidden_before"), F.lit(hidden).alias("hidden"))


def apply_change(products: DataFrame, change: DataFrame, field: str) -> DataFrame:
    """CAT-12: the proposed boost (hidden products excluded) or hidden flag written; ``before`` audits changed rows."""
    ch = change.select("id", c(field).alias("_new"), F.lit(True).alias("_hit"))
    hit = c("_hit").isNotNull() & (~c("hidden") if field == "boost" else F.lit(True))
    return products.join(ch, "id", "left").withColumn("before", F.when(hit, c(field).cast("string"))).withColumn(
        "changed", hit).withColumn(field, F.when(hit, c("_new")).otherwise(c(field))).drop("_new", "_hit")


def undo_change(products: DataFrame, history: DataFrame, target: str | None = None, tag: str | None = None) -> DataFrame:
    """CAT-13: exactly what a run added removed again, for the ids of that run."""
    j = products.join(history.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = c("_hit").isNotNull()
    if tag:
        return j.withColumn("tags", F.when(hit, F.array_remove("tags", tag)).otherwise(c("tags"))).drop("_hit")
    return j.withColumn("specifications", F.when(hit, F.map_filter("specifications", lambda k, v: k != target)).otherwise(
        c("specifications"))).drop("_hit")


def trial_then_keep(cards: DataFrame, change: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame], DataFrame],
                    fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """CAT-14: cards with the change kept only when no working query regresses, and the regressions found."""
    changed = change(cards)
    lost = baseline_regressions(evaluate(cards), evaluate(changed))
    clean = lost.agg((F.count("*") == 0).alias("ok")).scalar()
    new = changed.select("id", *[c(f).alias(f"_{f}") for f in fields])
    j = cards.join(new, "id", "left").withColumn("kept", clean)
    return j.select(*[x for x in cards.columns if x not in fields],
                    *[F.when(c("kept"), c(f"_{f}")).otherwise(c(f)).alias(f) for f in fields], "kept"), lost


def existing_catalog(rows: DataFrame) -> DataFrame:
    """CAT-15: shop database rows as catalog products: united tag sources, first image, numeric price, hidden flag."""
    trimmed = lambda x: F.filter(F.transform(F.coalesce(x, EMPTY()), lambda v: F.trim(v)), lambda v: v != "")
    tags = F.array_distinct(F.concat(trimmed(c("tags")), trimmed(c("soft_categories")), trimmed(c("category"))))
    image = F.coalesce("image", F.try_element_at("images", F.lit(1)))
    hidden = F.coalesce("hidden", F.lit(False)) | F.coalesce("not_in_store", F.lit(False)) | F.coalesce(c("visibility") == "hidden", F.lit(False))
    return rows.select(c("id").cast("string").alias("id"), F.coalesce("name", "title", F.lit("")).alias("name"),
                       trimmed(c("categories")).alias("categories"), tags.alias("tags"), image.alias("image"),
                       c("price").cast("string").try_cast("double").alias("price"), F.coalesce("stock_status", F.lit("unknown")).alias("stock_status"),
                       F.coalesce("status", F.lit("ACTIVE")).alias("status"), hidden.alias("hidden"))


def merge_observations(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """CAT-16: badges per product and text; scraped badges of an older scan are replaced for scanned products.

    Both sides are (id, text, kind, origin); only rows of origin ``site-scraper`` are replaced.
    """
    scanned = observed.select("id").distinct()
    stays = existing.filter("origin <> 'site-scraper'").unionByName(
        existing.filter("origin = 'site-scraper'").join(scanned, "id", "left_anti"))
    return observed.unionByName(stays).groupBy("id", "text").agg(F.min(F.struct("kind", "origin")).alias("b")).select(
        "id", "text", "b.kind", "b.origin")


def verify_change(after: DataFrame, targets: DataFrame, tag: str, alcohol_free: bool = False) -> DataFrame:
    """CAT-17: problems after a bulk change: (id, problem).

    ``targets`` is (id, add, categories, needs_vector); ``after`` has tags, categories, vector, name, description.
    """
    j = targets.join(after.withColumn("_there", F.lit(True)).withColumnRenamed("categories", "_cats"), "id", "left")
    there = c("_there").isNotNull()
    checks = [(~there, "vanished"), (there & (F.array_contains("tags", tag) != c("add")), "tag verification failed"),
              (there & c("add") & c("categories").isNotNull() & ~c("categories").eqNullSafe(c("_cats")), "category verification failed"),
              (there & c("add") & c("needs_vector") & (F.coalesce(F.size("vector"), F.lit(0)) <= 0), "embedding missing")]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(x)) for cond, x in checks]))
    out = j.select("id", F.explode(found).alias("problem"))
    if alcohol_free:
        wrong = after.filter(F.array_contains("tags", tag) & ~c("hidden") & legal_claim_check(c("name"), c("description")).isNotNull())
        out = out.unionByName(wrong.select("id", F.lit("incompatible product still tagged").alias("problem")))
    return out


def merge_live(cards: DataFrame, rows: DataFrame, live: tuple[str, ...] = ("price", "regular_price", "stock_status", "image")) -> DataFrame:
    """JOI-10: cards that still exist (full id, else its last segment) with live fields laid over, new rows appended."""
    used = [f for f in live if f in rows.columns and f in cards.columns]
    keys = cards.withColumn("_full", c("id")).withColumn("_tail", F.regexp_extract("id", "([^:]*)$", 1))
    r = rows.select(c("id").alias("_rid"), *[c(f).alias(f"_{f}") for f in used])
    full = keys.join(r, keys["_full"] == r["_rid"])
    rest = keys.join(r, keys["_full"] == r["_rid"], "left_anti")
    tail = rest.join(r, rest["_tail"] == r["_rid"])
    both = full.unionByName(tail)
    kept = [x for x in cards.columns if x not in used]
    merged = both.select(*kept, *[F.coalesce(f"_{f}", f).alias(f) for f in used], F.lit(False).alias("is_new"))
    fresh = rows.join(both.select(c("_rid").alias("id")), "id", "left_anti").withColumn("is_new", F.lit(True))
    return merged.unionByName(fresh.select(*[x for x in merged.columns if x in fresh.columns]), allowMissingColumns=True)


def attach_source_fields(results: DataFrame, rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """JOI-11: source fields joined to results by id; a result's own value wins."""
    r = rows.select("id", *[c(f).alias(f"_{f}") for f in fields])
    own = lambda f: F.coalesce(f, f"_{f}") if f in results.columns else c(f"_{f}")
    return results.join(r, "id", "left").select(*[x for x in results.columns if x not in fields], *[own(f).alias(f) for f in fields])


def store_of(users: DataFrame) -> DataFrame:
    """JOI-12: one account per store: the first with a platform, else the first."""
    rest = [x for x in users.columns if x != "store"]
    return users.groupBy("store").agg(F.min_by(F.struct(*rest), F.struct(c("platform").isNull(), c("user_id"))).alias("r")).select("store", "r.*")


def upsert_products(target: DataFrame, docs: DataFrame) -> DataFrame:
    """SNK-04: target after an upsert by id, each row with its source (``inserted``, ``updated``, ``absent``)."""
    rest = [x for x in target.columns if x != "id"]
    t = target.select("id", F.struct(*rest).alias("_t"))
    d = docs.select("id", F.struct(*rest).alias("_d"))
    j = t.join(d, "id", "full_outer")
    state = F.when(c("_t").isNull(), "inserted").when(c("_d").isNull(), "absent").otherwise("updated")
    return j.select("id", F.coalesce("_d", "_t").alias("r"), state.alias("state")).select("id", "r.*", "state")


def upsert_pages(target: DataFrame, pages: DataFrame, key: str, content: list[str]) -> DataFrame:
    """SNK-02: target with pages of a changed content signature replaced and new ones added; ``written`` marks them."""
    sign = F.sha2(F.to_json(F.struct(*content)), 256)
    t = target.select(key, F.struct(*content).alias("_t"), sign.alias("_ts"))
    p = pages.select(key, F.struct(*content).alias("_p"), sign.alias("_ps"))
    j = t.join(p, key, "full_outer")
    write = c("_ps").isNotNull() & ~c("_ps").eqNullSafe(c("_ts"))
    return j.select(key, F.when(write, c("_p")).otherwise(c("_t")).alias("r"), write.alias("written")).select(key, "r.*", "written")


def never_seen(queue: DataFrame, crawled: DataFrame, key: str = "key") -> DataFrame:
    """JOI-08: queued urls whose key was never crawled."""
    return queue.join(crawled.select(key), key, "left_anti")


def needs_page_read(queue: DataFrame, products: DataFrame, swept: DataFrame, sweep_complete: bool) -> DataFrame:
    """FLT-10: pages worth reading after a listing: unseen, changed by their sitemap date, or gone from a
    complete listing while last seen on sale. A page without a date is always read.

    ``queue`` is (url, key, lastmod); ``products`` (key, stock_status, crawled_at); ``swept`` (key).
    """
    j = queue.join(swept.select("key"), "key", "left_anti").join(products.select("key", "stock_status", "crawled_at"), "key", "left")
    gone = F.lit(sweep_complete) & c("stock_status").isin(*ON_SALE)
    stale = c("lastmod").isNull() | c("crawled_at").isNull() | (c("lastmod") > c("crawled_at"))
    return j.filter(c("stock_status").isNull() | gone | stale).select("url", "key")
