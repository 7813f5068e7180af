"""Catalog rows: normalising, deriving, selecting and summarising products (PRJ-12..32, FLT-02..09, AGG-25..29, 34, 41, 42, 45)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions.html import clean
from storelens.functions.text import search_normalize, text_list
from storelens.functions.urls import first_capture, host, product_url_key
from storelens.operators.containment import contained

JOINER = " · "
# Source fields copied into the specifications.
SOURCE_FIELDS = ("author", "publisher", "isbn", "language", "originalTitle", "originalLanguage", "translator",
                 "publicationYear", "series", "brand")
# Statuses of a published product.
PUBLISHED = ("active", "ACTIVE", "publish", "published")
# Alcohol claims, declared amounts and other drinks.
ALCOHOL_FREE = "(?i)ללא\\s+אלכוהול|alcohol[- ]free|non[- ]alcoholic"
ALCOHOL_AMOUNT = "(?i)(?:אחוז\\s*אלכוהול|alcohol(?:\\s*(?:content|percentage))?|abv)\\s*[:=]?\\s*(\\d+(?:[.,]\\d+)?)"
WINE, NOT_WINE = "(?i)יין|wine", "(?i)סודה|תמצית|סירופ|בירה|beer|soda"

c = F.col
EMPTY = lambda: F.array().cast("array<string>")
EMPTY_MAP = lambda: F.create_map().cast("map<string,string>")


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def merge_maps(base: Column, extra: Column) -> Column:
    """Both maps as one; entries of ``extra`` win."""
    base, extra = F.coalesce(base, EMPTY_MAP()), F.coalesce(extra, EMPTY_MAP())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)


def map_of(pairs: dict[str, Column]) -> Column:
    """A map of the non-null columns."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs.items()]))
    return F.map_from_entries(entries)


# ---- normalising ---------------------------------------------------------------------------------------------

def variant_price(variants: Column) -> Column:
    """PRJ-13: struct<price, regular_price, lo, hi, stock_status> of typed variants.

    The cheapest priced variant in stock counts, else the first; the range spans the
    priced ones in stock; stock is known only when every variant says so.
    """
    on_sale = F.filter(variants, lambda v: (v["stock_status"] == "instock") & v["price"].isNotNull())
    cheapest = F.array_min(F.transform(on_sale, lambda v: F.struct(v["price"].alias("price"), v["regular_price"].alias("regular_price"))))
    first = F.try_element_at(variants, F.lit(1))
    has = F.size(on_sale) > 0
    prices = F.transform(on_sale, lambda v: v["price"])
    stock = F.when(F.exists(variants, lambda v: v["stock_status"] == "instock"), "instock").when(
        (F.size(variants) > 0) & F.forall(variants, lambda v: v["stock_status"] == "outofstock"), "outofstock").otherwise("unknown")
    return F.struct(F.when(has, cheapest["price"]).otherwise(first["price"]).alias("price"),
                    F.when(has, cheapest["regular_price"]).otherwise(first["regular_price"]).alias("regular_price"),
                    F.array_min(prices).alias("lo"), F.array_max(prices).alias("hi"), stock.alias("stock_status"))


def _finish(df: DataFrame, origin: str) -> DataFrame:
    """Absolute urls, a reject reason instead of an exception, and the content hash."""
    absolute = F.when(c("url").rlike("^(?i)[a-z][a-z0-9+.-]*:"), c("url")).otherwise(
        F.concat(F.lit(origin), F.when(c("url").startswith("/"), c("url")).otherwise(F.concat(F.lit("/"), c("url")))))
    out = df.withColumn("url", absolute)
    reject = F.when((F.trim("id") == "") | c("id").isNull() | (c("name") == ""), "no id or name").when(
        ~F.coalesce(c("url").rlike("^(?i)https?://[^/]+"), F.lit(False)), "bad url")
    out = out.withColumn("reject", reject)
    return out.withColumn("content_hash", content_hash([x for x in out.columns if x != "reject"]))


def normalize_products(raw: DataFrame, platform: str, origin: str) -> DataFrame:
    """PRJ-12: platform rows as canonical products; unusable rows keep a ``reject`` reason.

    shopify: id, title, handle, body_html, vendor, product_type, tags, currency, images, variants.
    woocommerce: id, name, permalink, sku, prices struct, is_in_stock, categories, tags, description.
    custom: id, name, url, sku, price, regular_price, currency, availability, category, tags, description.
    """
    if platform == "shopify":
        typed = F.transform("variants", lambda v: F.struct(
            v["id"].cast("string").alias("id"), F.coalesce(v["sku"], F.lit("")).alias("sku"),
            v["price"].try_cast("double").alias("price"), v["compare_at_price"].try_cast("double").alias("regular_price"),
            F.when(v["available"], "instock").when(~v["available"], "outofstock").otherwise("unknown").alias("stock_status")))
        out = raw.withColumn("_v", typed).withColumn("_p", variant_price(c("_v"))).select(
            c("id").cast("string").alias("id"), clean(c("title")).alias("name"),
            F.concat(F.lit(f"{origin}/products/"), "handle").alias("url"), c("_p.price"), c("_p.regular_price"),
            c("_p.lo").alias("price_min"), c("_p.hi").alias("price_max"), "currency", c("_p.stock_status"),
            text_list(c("product_type")).alias("categories"), c("tags"), clean(c("body_html")).alias("description"),
            F.coalesce("vendor", F.lit("")).alias("brand"))
    elif platform == "woocommerce":
        unit = F.pow(F.lit(10.0), F.coalesce(c("prices.currency_minor_unit"), F.lit(2)))
        price, regular = c("prices.price").try_cast("double") / unit, c("prices.regular_price").try_cast("double") / unit
        names = lambda col: F.filter(F.transform(col, lambda x: F.trim(x["name"])), lambda x: x != "")
        out = raw.select(
            c("id").cast("string").alias("id"), clean(c("name")).alias("name"), c("permalink").alias("url"), price.alias("price"),
            regular.alias("regular_price"), price.alias("price_min"), price.alias("price_max"), c("prices.currency_code").alias("currency"),
            F.when(c("is_in_stock"), "instock").when(~c("is_in_stock"), "outofstock").otherwise("unknown").alias("stock_status"),
            names("categories").alias("categories"), names("tags").alias("tags"), clean(c("description")).alias("description"),
            F.lit("").alias("brand"))
    else:
        price = c("price").cast("string").try_cast("double")
        stock = F.when(c("availability").rlike("/InStock$"), "instock").when(c("availability").rlike("/OutOfStock$"), "outofstock").otherwise("unknown")
        out = raw.select(
            F.coalesce(c("id").cast("string"), "sku").alias("id"), clean(c("name")).alias("name"), "url", price.alias("price"),
            c("regular_price").cast("string").try_cast("double").alias("regular_price"), price.alias("price_min"), price.alias("price_max"),
            "currency", stock.alias("stock_status"), text_list(c("category")).alias("categories"), text_list(c("tags")).alias("tags"),
            clean(c("description")).alias("description"), F.coalesce("brand", F.lit("")).alias("brand"))
    return _finish(out, origin)


def content_hash(cols: list[str], volatile: tuple[str, ...] = ("fetched_at", "content_hash")) -> Column:
    """PRJ-15: SHA-256 of the canonical JSON of a row without its volatile columns."""
    return F.sha2(F.to_json(F.struct(*sorted(x for x in cols if x not in volatile))), 256)


def evidence_row() -> Column:
    """PRJ-16: struct<id, quote>: the merchant text of a product and its stable id."""
    specs = F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    quote = F.array_join(F.concat(F.array("name", "description"), specs), "\n")
    key = F.concat_ws("|", "id", "url", F.sha2(quote, 256))
    return F.struct(F.substring(F.sha2(key, 256), 1, 24).alias("id"), quote.alias("quote"))


def collect_specifications(declared: Column, table: Column, attributes: Column, additional: Column) -> Column:
    """PRJ-14: declared specs, two-cell table rows, attributes (values joined) and additional properties; later ones win.

    ``attributes`` is array<struct<name, values>>, ``additional`` array<struct<name, value>>.
    """
    def as_map(entries, value):
        pairs = F.filter(F.transform(entries, lambda a: F.struct(a["name"].alias("key"), value(a).alias("value"))),
                         lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (e["value"] != ""))
        # A repeated name keeps its last value.
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
        return F.map_from_entries(last)

    attrs = as_map(attributes, lambda a: F.array_join(a["values"], JOINER))
    extra = as_map(additional, lambda a: a["value"])
    return merge_maps(merge_maps(merge_maps(declared, table), attrs), extra)


def source_specifications(df: DataFrame, fields: tuple[str, ...] = SOURCE_FIELDS) -> DataFrame:
    """PRJ-24: the known source fields copied into ``specifications``, arrays joined."""
    present = {}
    for f in fields:
        if f in df.columns:
            kind = df.schema[f].dataType.typeName()
            present[f] = F.array_join(f, JOINER) if kind == "array" else c(f).cast("string")
    return df.withColumn("specifications", merge_maps(c("specifications"), map_of(present)))


def derive_card(df: DataFrame, profile: dict) -> DataFrame:
    """PRJ-17: product type (only when exactly one matches), colours, finishes, badge candidates, hidden flag, issues."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else EMPTY()
    named = lambda rules, hit: F.array_compact(F.array(*[F.when(hit(k, v), F.lit(k)) for k, v in rules.items()])) if rules else EMPTY()
    in_categories = lambda cats: F.arrays_overlap("categories", lits(cats)) if cats else F.lit(False)
    types = named(profile.get("product_types", {}), lambda k, v: in_categories(v))
    colors = named(profile.get("colors", {}), lambda k, v: F.array_contains("colors", k) | in_categories(v))
    finishes = named(profile.get("finishes", {}), lambda k, v: in_categories(v))
    badges = [F.array_intersect(F.coalesce(c(f), EMPTY()), lits(vals)) for f, vals in profile.get("badges", {}).items()]
    known = c("status").isin(*profile.get("published", ("ACTIVE", "publish")))
    out = df.withColumn("_types", types)
    one = F.size("_types") == 1
    return out.select("*", F.when(one, c("_types")[0]).alias("product_type"), colors.alias("card_colors"), finishes.alias("finishes"),
                      (F.array_distinct(F.concat(*badges)) if badges else EMPTY()).alias("badge_candidates"),
                      (c("hidden") | ~known).alias("card_hidden"),
                      F.when(F.size("_types") > 1, F.array(F.lit("ambiguous-product-type"))).otherwise(EMPTY()).alias("issues")).drop("_types")


def verify_badges(cards: DataFrame, observations: DataFrame) -> DataFrame:
    """PRJ-18: badges seen on a product's page; a stock or sale badge the catalog contradicts becomes an issue.

    ``observations`` is (url, kind, text, observed_at). Returns (id, kind, text, verdict).
    """
    keyed = cards.withColumn("_k", product_url_key(c("url"))).filter("_k is not null").select("_k", "id", "price", "regular_price", "stock_status")
    seen = observations.withColumn("_k", product_url_key(c("url"))).groupBy("_k", "kind", "text").agg(F.min("observed_at").alias("observed_at"))
    on_sale = F.coalesce(c("regular_price") > c("price"), F.lit(False))
    verdict = F.when((c("kind") == "stock") & (c("stock_status") != "outofstock"), "source-stock-conflict").when(
        (c("kind") == "sale") & ~on_sale, "source-sale-conflict").otherwise("verified")
    return seen.join(keyed, "_k").select("id", "kind", "text", verdict.alias("verdict"), "observed_at")


def classify_model_tags(df: DataFrame, rules: list[dict], accessory: str, text: Column) -> DataFrame:
    """PRJ-19: tags of a pattern rule table on the product name, accessories excluded.

    A rule is {tag, pattern, any?}; ``{0}`` in the tag takes the first capture, ``any``
    also applies to accessories. Adds ``model_tags`` and ``is_accessory``.
    """
    out = df.withColumn("_t", F.lower(text)).withColumn("is_accessory", c("_t").rlike(accessory))

    def tag(r):
        hit = c("_t").rlike(r["pattern"]) & (F.lit(True) if r.get("any") else ~c("is_accessory"))
        name = F.replace(F.lit(r["tag"]), F.lit("{0}"), F.regexp_extract("_t", r["pattern"], 1)) if "{0}" in r["tag"] else F.lit(r["tag"])
        return F.when(hit, name)

    return out.withColumn("model_tags", F.array_distinct(F.array_compact(F.array(*[tag(r) for r in rules])))).drop("_t")


def apply_brand_pack(products: DataFrame, groups: dict[str, tuple[str, str]]) -> DataFrame:
    """PRJ-20: categories per product-type group by include / exclude pattern: (product_type, category)."""
    cats = products.select(F.explode("categories").alias("category")).distinct()
    hit = lambda inc, exc: c("category").rlike(inc) & (~c("category").rlike(exc) if exc else F.lit(True))
    types = F.array_compact(F.array(*[F.when(hit(*v), F.lit(k)) for k, v in groups.items()]))
    return cats.select(F.explode(types).alias("product_type"), "category")


def legal_claim_check(name: Column, description: Column, wine_only: bool = False) -> Column:
    """PRJ-21: null when an alcohol-free claim holds, else the reason against it."""
    text = F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))
    amounts = F.transform(F.regexp_extract_all(text, F.lit(ALCOHOL_AMOUNT), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    free = text.rlike(ALCOHOL_FREE) | F.exists(amounts, lambda a: a == 0)
    why = F.when(F.exists(amounts, lambda a: a > 0), "declares alcohol").when(~free, "no explicit evidence")
    return why.when(~text.rlike(WINE) | text.rlike(NOT_WINE), "not clearly wine") if wine_only else why


def field_text(df: DataFrame, field: str) -> Column:
    """A card field as text; arrays are joined, ``specifications.X`` reads the map."""
    if field.startswith("specifications."):
        return F.try_element_at("specifications", F.lit(field[15:]))
    kind = df.schema[field].dataType.typeName()
    return F.array_join(field, JOINER) if kind == "array" else c(field).cast("string")


def describe_fields(df: DataFrame, examples: int = 3) -> DataFrame:
    """PRJ-22: per (nested) field the filled rows, its type and a few examples."""
    from pyspark.sql.types import StructType

    def leaves(schema, prefix, depth):
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType) and depth < 3:
                yield from leaves(f.dataType, path + ".", depth + 1)
            else:
                yield path, f.dataType.typeName()

    cells = F.array(*[F.struct(F.lit(p).alias("field"), F.lit(t).alias("type"), (
        F.to_json(c(p)) if t in ("array", "map", "struct") else c(p).cast("string")).alias("value")) for p, t in leaves(df.schema, "", 1)])
    values = df.select(F.inline(cells)).filter("value is not null and value <> ''").groupBy("field", "type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("value")
    shown = values.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= examples).groupBy("field").agg(
        F.array_join(F.sort_array(F.collect_list(F.substring("value", 1, 120))), "|").alias("examples"))
    return values.groupBy("field", "type").agg(F.sum("n").alias("filled")).join(shown, "field")


def field_coverage(df: DataFrame, fields: tuple[str, ...] = ("title", "description", "tags", "categories"), examples: int = 4) -> DataFrame:
    """PRJ-23: filled rows, distinct values and examples per card field, every specification included."""
    base = F.array(*[F.struct(F.lit(f).alias("field"), field_text(df, f).alias("value")) for f in fields])
    specs = F.transform(F.map_entries("specifications"), lambda e: F.struct(
        F.concat(F.lit("specifications."), e["key"]).alias("field"), e["value"].alias("value")))
    values = df.select(F.inline(F.concat(base, specs))).filter("trim(value) <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("value")
    shown = values.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= examples).groupBy("field").agg(
        F.array_join(F.sort_array(F.collect_list(F.substring("value", 1, 80))), "|").alias("examples"))
    return values.groupBy("field").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct")).join(shown, "field")


def extract_pattern(text: Column, pattern: str) -> Column:
    """PRJ-26: first capture group, else the whole match, trimmed; empty without a match."""
    return F.trim(first_capture(text, "(?iu)" + pattern))


def add_catalog_field(df: DataFrame, target: str, category: str | None = None, value: str | None = None,
                      source: str | None = None, pattern: str | None = None) -> DataFrame:
    """PRJ-25: a constant, a copied field or a captured pattern as specification ``target`` on one category."""
    found = F.lit(value) if value is not None else field_text(df, source)
    if pattern:
        found = extract_pattern(found, pattern)
    scope = (F.array_contains("categories", category) | F.array_contains("tags", category)) if category else F.lit(True)
    new = F.when(scope & (found != ""), F.create_map(F.lit(target), found))
    return df.withColumn("specifications", merge_maps(c("specifications"), new))


def import_field(cards: DataFrame, source: DataFrame, field: str, target: str, limit: int | None = 2000) -> DataFrame:
    """PRJ-27: a source row's field copied into the specifications by product id; existing targets are left alone.

    Values are cut at ``limit`` characters, the reference's rule; None keeps them whole.
    """
    value = field_text(source, field)
    rows = source.select("id", (value if limit is None else F.substring(value, 1, limit)).alias("_v")).filter("_v <> ''")
    j = cards.join(rows, "id", "left")
    fresh = c("_v").isNotNull() & ~F.map_contains_key("specifications", target)
    new = F.when(fresh, F.create_map(F.lit(target), c("_v")))
    return j.withColumn("specifications", merge_maps(c("specifications"), new)).drop("_v")


def apply_distinct_mapping(df: DataFrame, source: str, target: str, mapping: DataFrame) -> DataFrame:
    """PRJ-28: a (value, result) table made for the distinct values of a field, fanned out to all products."""
    j = df.withColumn("_value", field_text(df, source)).join(mapping.select(c("value").alias("_value"), c("result").alias("_r")), "_value", "left")
    new = F.when(F.coalesce("_r", F.lit("")) != "", F.create_map(F.lit(target), c("_r")))
    return j.withColumn("specifications", merge_maps(c("specifications"), new)).drop("_value", "_r")


def document_text(limit: int | None = 20000) -> Column:
    """PRJ-29: the text a product is embedded by, cut at ``limit`` characters, the reference's rule; None keeps it whole."""
    specs = F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    text = F.array_join(F.concat(F.array("title", "description"), c("categories"), c("tags"), specs), "\n")
    return text if limit is None else F.left(text, F.lit(limit))


def public_product(df: DataFrame) -> DataFrame:
    """PRJ-31: the fields that may leave the shop, with an editable flag."""
    return df.select("id", F.coalesce("name", "title").alias("name"), "price", F.coalesce("url", F.lit("")).alias("url"),
                     F.coalesce("stock_status", F.lit("unknown")).alias("stock_status"), (~c("hidden")).alias("editable"))


def product_documents(cards: DataFrame, raw: DataFrame) -> DataFrame:
    """PRJ-32: card and raw row as a shop document: sale price only below regular, internal tags dropped, image fallback."""
    r = raw.select("id", c("description").alias("_rd"), c("images").alias("_ri"))
    sid = F.regexp_extract("id", "([^:]*)$", 1)
    regular = F.coalesce("regular_price", "price")
    sale = c("price") < regular
    images = F.when(F.size(F.coalesce("_ri", EMPTY())) > 0, c("_ri")).when(c("image").isNotNull(), F.array("image")).otherwise(EMPTY())
    return cards.join(r, "id", "left").select(
        sid.alias("id"), sid.try_cast("bigint").alias("numeric_id"), c("title").alias("name"), "price", regular.alias("regular_price"),
        F.when(sale, c("price")).alias("sale_price"), F.coalesce(sale, F.lit(False)).alias("on_sale"),
        F.when(c("hidden"), "private").otherwise("publish").alias("status"),
        F.coalesce(F.nullif(c("_rd"), F.lit("")), "description").alias("description"),
        F.filter("tags", lambda t: ~t.startswith("__")).alias("tags"), images.alias("images"), "stock_status")


# ---- selecting -----------------------------------------------------------------------------------------------

def sellable(policy: str = "hide") -> Column:
    """FLT-02: not hidden and in stock or on backorder; policies ``last`` and ``show`` also keep the rest."""
    stock = c("stock_status").isin("instock", "onbackorder")
    return ~c("hidden") & (F.lit(True) if policy in ("last", "show") else stock)


def available() -> Column:
    """FLT-03: visible, in stock and published."""
    return ~c("hidden") & c("stock_status").isin("instock", "in_stock") & (c("status").isNull() | c("status").isin(*PUBLISHED))


def shown() -> Column:
    return ~c("hidden") & (c("stock_status") == "instock")


def catalog_filter(df: DataFrame, text: str = "", visibility: str = "all", boosted: bool = False) -> DataFrame:
    """FLT-04: literal, case-insensitive match on name, sku, category or id; visible / hidden; boosted."""
    t = text.strip().lower()
    has = lambda x: F.contains(F.lower(x), F.lit(t))
    cond = [has(c("name")) | has(c("sku")) | has(c("id")) | F.exists("categories", has)] if t else []
    if visibility != "all":
        cond.append(c("hidden") if visibility == "hidden" else ~c("hidden"))
    if boosted:
        cond.append(c("boost") > 0)
    return df.filter(all_of(cond))


def card_text(ascii_only: bool = False) -> Column:
    """All searchable text of a card, normalised."""
    text = F.concat_ws(" ", "title", "description", F.array_join("categories", " "), F.array_join("tags", " "),
                       F.array_join(F.map_values("specifications"), " "))
    return search_normalize(text, ascii_only)


def select_cards(df: DataFrame, contains: str = "", title_contains: str = "", labels: tuple[str, ...] = (), field: str = "title",
                 values: tuple[str, ...] = (), exclude: tuple[str, ...] = (), visible_only: bool = False, ascii_only: bool = False) -> DataFrame:
    """FLT-05: one selection language; all given conditions hold, labels and values any-of, excluded values none.

    Arguments are normalised text.
    """
    norm = lambda x: search_normalize(x, ascii_only)
    cond = []
    if labels:
        cond.append(any_of([F.array_contains("categories", l) | F.array_contains("tags", l) for l in labels]))
    if title_contains:
        cond.append(norm(c("title")).contains(title_contains))
    if contains:
        cond.append(card_text(ascii_only).contains(contains))
    value = norm(F.coalesce(field_text(df, field), F.lit(""))) if values or exclude else None
    if values:
        cond.append(any_of([value.contains(v) for v in values]))
    if exclude:
        cond.append(~any_of([value.contains(v) for v in exclude]))
    if visible_only:
        cond.append(shown())
    return df.filter(all_of(cond))


def in_scope(df: DataFrame, category: str | None = None, title: str = "", field: str = "title", values: tuple[str, ...] = (),
             ascii_only: bool = False) -> DataFrame:
    """FLT-06: the products a processing step applies to."""
    return select_cards(df, title_contains=title, labels=(category,) if category else (), field=field, values=values, ascii_only=ascii_only)


def find_by_words(df: DataFrame, term: str, in_stock_only: bool = True, include_hidden: bool = False) -> DataFrame:
    """FLT-07: products whose name holds every one of up to six words."""
    ws = term.lower().split()[:6]
    cond = [F.contains(F.lower("name"), F.lit(w)) for w in ws] or [F.lit(False)]
    if not include_hidden:
        cond.append(~c("hidden"))
    if in_stock_only:
        cond.append(c("stock_status") == "instock")
    return df.filter(all_of(cond))


def out_of_stock_hits(cards: DataFrame, queries: DataFrame, n: int = 8, ascii_only: bool = False) -> DataFrame:
    """FLT-09: per query (column query) the first ``n`` sold-out products whose text holds every term of two letters or more.

    Products are met on the query's longest term, the others are tested on them; queries without such a term find nothing.
    """
    text = cards.filter(~c("hidden") & (c("stock_status") == "outofstock")).select(c("id").alias("product_id"), "title", card_text(ascii_only).alias("text"))
    terms = F.filter(F.split("query", "\\s+"), lambda t: F.length(t) >= 2)
    longest = F.reduce(terms, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    asked = queries.select("query").distinct().select("query", terms.alias("_terms"), longest.alias("asked")).filter("asked <> ''")
    near = asked.join(contained(asked, text), "asked").join(text, "product_id").filter(F.forall("_terms", lambda t: F.contains("text", t)))
    w = Window.partitionBy("query").orderBy("id")
    return near.select(c("product_id").alias("id"), "title", "query").withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n)


# ---- conversations -------------------------------------------------------------------------------------------

def conversation_turns(rows: DataFrame) -> DataFrame:
    """Transcript turns, else legacy messages, of nested conversation rows as (conv_id, turn, role, text)."""
    spoken = F.flatten(F.transform("transcript", lambda t, i: F.array(
        F.struct((i * 2).alias("turn"), F.lit("user").alias("role"), t["message"].alias("text")),
        F.struct((i * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), t["reply"].alias("text")))))
    legacy = F.transform("messages", lambda m, i: F.struct(i.alias("turn"), m["role"].alias("role"), m["text"].alias("text")))
    chosen = F.when(F.coalesce(F.size("transcript"), F.lit(0)) > 0, spoken).otherwise(legacy)
    return rows.select("conv_id", F.inline(chosen)).filter("role in ('user', 'assistant') and text is not null")


def conversation_detail(turns: DataFrame) -> DataFrame:
    """PRJ-30: readable turns only; system and tool messages stay internal."""
    return turns.filter("role in ('user', 'assistant') and text is not null").select("conv_id", "turn", "role", "text")


def conversation_summary(turns: DataFrame) -> DataFrame:
    """PRJ-30, head: opening query, number of readable turns and answers per conversation."""
    user = c("role") == "user"
    readable = c("role").isin("user", "assistant")
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.min_by("text", F.when(user, c("turn"))), F.lit("")).alias("query"), F.count_if(readable).alias("turns"),
        F.count_if(c("role") == "assistant").alias("replies"), (F.count_if(readable) > 0).alias("has_transcript"))


def conversation_filter(turns: DataFrame, heads: DataFrame, text: str = "", since: Column | None = None, content: str = "all") -> DataFrame:
    """FLT-08: conversations updated (else created) since a time, with a literal text in any readable turn, with or without a transcript."""
    out = heads
    if since is not None:
        out = out.filter(F.coalesce("updated_at", "created_at") >= since)
    if text:
        hit = turns.filter(c("role").isin("user", "assistant") & F.contains(F.lower("text"), F.lit(text.lower())))
        out = out.join(hit.select("conv_id"), "conv_id", "left_semi")
    readable = turns.filter(c("role").isin("user", "assistant")).select("conv_id")
    return out if content == "all" else out.join(readable, "conv_id", "left_semi" if content == "transcript" else "left_anti")


# ---- summaries -----------------------------------------------------------------------------------------------

def catalog_summary(df: DataFrame) -> DataFrame:
    """AGG-25: products, described ones and specification entries (one row)."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("with_description"),
                  F.sum(F.size("specifications")).alias("spec_entries"), F.count_if(shown()).alias("visible"))


def facet(df: DataFrame, field: str) -> DataFrame:
    """AGG-26: products, visible ones and three sample titles per value of a (multi-value) field."""
    kind = "string" if field.startswith("specifications.") else df.schema[field].dataType.typeName()
    values = c(field) if kind == "array" else F.split(field_text(df, field), JOINER)
    trimmed = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    empty = F.coalesce(F.size(trimmed), F.lit(0)) <= 0
    rows = df.select("id", "title", shown().alias("_s"), F.explode(F.when(empty, F.array(F.lit("(empty)"))).otherwise(trimmed)).alias("value"))
    w = Window.partitionBy("value").orderBy("id")
    sample = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("value").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), "|").alias("sample"))
    return rows.groupBy("value").agg(F.count("*").alias("products"), F.count_if("_s").alias("visible")).join(sample, "value")


def label_counts(df: DataFrame, contains: str = "") -> DataFrame:
    """AGG-27: products per category or tag label."""
    rows = df.select(F.explode(F.concat("categories", "tags")).alias("label"))
    if contains:
        rows = rows.filter(F.contains(F.lower("label"), F.lit(contains.lower())))
    return rows.groupBy("label").agg(F.count("*").alias("products"))


def catalog_facets(df: DataFrame, n: int = 40) -> DataFrame:
    """AGG-28: the commonest labels of the visible catalog with counts and price range."""
    rows = df.filter(~c("hidden")).select(F.explode(F.concat("categories", "tags")).alias("label"), "price", "stock_status")
    return rows.groupBy("label").agg(F.count("*").alias("visible"), F.count_if(c("stock_status") == "instock").alias("in_stock"),
                                     F.min("price").alias("min_price"), F.max("price").alias("max_price")).orderBy(
        c("visible").desc(), "label").limit(n)


def distinct_values(df: DataFrame, field: str, offset: int = 0, size: int = 50) -> DataFrame:
    """AGG-29: one page of a field's distinct values."""
    return df.select(field_text(df, field).alias("value")).filter("value <> ''").distinct().orderBy("value").offset(offset).limit(size)


def tag_summary(decisions: DataFrame) -> DataFrame:
    """AGG-34: decisions per tag and status."""
    return decisions.groupBy("tag", "status").agg(F.count("*").alias("n"))


def catalog_change_counts(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """AGG-41: added, updated, unchanged and absent products between two reads of (id, content_hash) (one row)."""
    p, n = prev.select("id", c("content_hash").alias("_p")), cur.select("id", c("content_hash").alias("_n"))
    j = n.groupBy("id").agg(F.max("_n").alias("_n"), F.count("*").alias("_copies")).join(p, "id", "full_outer")
    return j.agg(F.count_if(c("_p").isNull()).alias("added"), F.count_if(c("_p") != c("_n")).alias("updated"),
                 F.count_if(c("_p") == c("_n")).alias("unchanged"), F.count_if(c("_n").isNull()).alias("absent"),
                 F.coalesce(F.sum(c("_copies") - 1), F.lit(0)).alias("duplicates"))


def build_checks(cards: DataFrame, postings: DataFrame, identifiers: DataFrame) -> DataFrame:
    """AGG-42: readiness checks (name, passed) of a built catalog and its index."""
    from storelens.operators.ranks import absent
    docs = postings.select("product_id").unionByName(identifiers.select("product_id")).distinct()
    ids = cards.select(c("id").alias("product_id"))
    own = identifiers.select("product_id", "key")
    found = cards.filter(shown()).select(c("id").alias("product_id"), F.lower("id").alias("key")).join(own, ["product_id", "key"], "left_anti")
    one = cards.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.bool_and(
        (F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & c("url").isNotNull()).alias("valid"))
    zero = lambda df: df.agg((F.count("*") == 0).alias("z")).scalar()
    checks = [("document-count", one.select((c("n") == c("d")).alias("x")).scalar() & zero(absent(ids, docs, "product_id")) & zero(absent(docs, ids, "product_id"))),
              ("valid-cards", one.select("valid").scalar()), ("no-duplicate-product-ids", one.select((c("n") == c("d")).alias("x")).scalar()),
              ("id-lookup", zero(found))]
    base = cards.sparkSession.range(1)
    return base.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("passed")) for n, v in checks])))


def dominant_origin(products: DataFrame) -> DataFrame:
    """AGG-45: the host most product urls share, if it holds at least max(3, 60 %) of the catalog."""
    total = products.agg(F.count("*").alias("n")).scalar()
    hosts = products.filter(c("url").rlike("^https://")).groupBy(F.regexp_replace(host(c("url")), "^www\\.", "").alias("host")).agg(F.count("*").alias("n"))
    return hosts.orderBy(c("n").desc(), "host").limit(1).withColumn("_t", total).filter(
        c("n") >= F.greatest(F.lit(3), F.ceil(c("_t") * 0.6))).drop("_t")
