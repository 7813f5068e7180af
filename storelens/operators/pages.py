"""Saved pages: one parse per page, everything after it as columns (SCR-01..16, SRC-08..09, FLT-14..15, AGG-35, 37, 38, 43, CLS-08..09, SRT-07)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions import html as H
from storelens.functions.batches import map_parts
from storelens.functions.text import audit_normalize, search_normalize, title_matches
from storelens.functions.urls import bare_host, host, origin, product_key

c = F.col
EMPTY = lambda t="string": F.array().cast(f"array<{t}>")

# Paths, parameters, words and patterns of shop pages.
SKIP_PATH = ("(?i)/(cart|checkout|account|my-account|login|register|wp-admin|wp-login|wishlist|compare|search|feed|tag|author|blog|news|cdn-cgi)(/|$)"
             "|add-to-cart|\\.(jpe?g|png|gif|webp|avif|svg|ico|pdf|zip|css|js|json|xml|mp4|webm|woff2?|ttf)$")
PAGE_PARAMS = "(?i)^(page|p|pg|paged)=\\d{1,5}$"
PRODUCT_PATH = "(?i)/(products|product|items|product-page)/([^/?#]+)"
PLATFORM_OF_PATH = {"products": "shopify", "product": "woocommerce", "items": "konimbo", "product-page": "wix"}
PLATFORM_PATTERNS = {
    "shopify": "(?i:cdn\\.shopify\\.com)|Shopify\\.theme|(?i:myshopify\\.com|shopify-section)",
    "woocommerce": "(?i)wp-content/plugins/woocommerce|\\bwoocommerce\\b|wc-block",
    "magento": "Magento_[A-Z]|mage/cookies|(?i:/static/version\\d+/frontend/|data-mage-init)",
    "wordpress": "(?i)wp-content/|wp-json", "wix": "(?i)static\\.wixstatic\\.com|wix\\.com/|X-Wix",
    "bigcommerce": "(?i)cdn\\d*\\.bigcommerce\\.com", "prestashop": "(?i)prestashop"}
VENDOR_PATTERNS = {
    "Algolia": "(?i)algolia(net)?\\.(com|net)|instantsearch\\.js|algoliasearch", "Klevu": "(?i)klevu", "Doofinder": "(?i)doofinder",
    "Searchanise": "(?i)searchanise", "Boost Commerce": "(?i)boost-pfs|boostcommerce|bc-sf-filter", "Fast Simon": "(?i)fastsimon|instantsearchplus",
    "FiboSearch": "(?i)dgwt-wcas", "Searchspring": "(?i)searchspring", "Constructor.io": "(?i)cnstrc\\.com", "Bloomreach": "(?i)bloomreach|brsearch",
    "Findify": "(?i)findify", "Clerk": "(?i)clerk\\.io", "Luigi's Box": "(?i)luigisbox", "Nosto": "(?i)nosto"}
NO_RESULTS = ("(?i)לא נמצאו|לא נמצא (מוצר|פריט)|אין תוצאות|לא מצאנו|\\b0 תוצאות|תוצאות\\s*:\\s*0(?!\\d)|נמצאו 0(?!\\d)|results\\s*:\\s*0(?!\\d)"
              "|אין מוצרים התואמים|no (products|results)( were)? found|did not match any|nothing (was )?found|0 results")
BUY_PHRASE = "(?i)add.to.cart|הוסף?ה? ל(סל|עגלה)|הוספה לסל|לרכישה|buy now|קנה עכשיו"
CURRENCY_SIGN = "(₪|\\$|€|£|ש\"ח|ILS|USD|EUR)\\s?\\d|\\d[\\d,.]*\\s?(₪|ש\"ח)"
NAV_STOP = ("(?i)צור קשר|אודות|בלוג|מבצע|תקנון|החשבון|התחבר|הרשמ|סל|עגלה|דף הבית|כל המוצרים|חדש|contact|about|blog|sale|login|account|cart|home"
            "|shop all|faq|שאלות|משלוח|החזר|מועדון|גיפט|gift card|כרטיס")
EMAIL = "[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}"
JUNK_EMAIL = "(?i)\\.(png|jpe?g|gif|webp|svg)$|sentry|wixpress|example\\.|domain\\.|@2x|yourmail|email@"
PHONE = "(?:\\+972[-\\s]?|\\b0)(?:[23489]|5\\d|7\\d)[-\\s]?\\d{3}[-\\s]?\\d{4}\\b|\\*\\d{4}\\b"
COMPANY = "(?:ח\\.?\\s?פ\\.?|ע\\.?\\s?מ\\.?|עוסק מורשה|מספר חברה)\\s*[:\\-]?\\s*(\\d{8,9})"
SOCIAL = {"facebook": "(?i)facebook\\.com/(?!sharer)", "instagram": "(?i)instagram\\.com/", "linkedin": "(?i)linkedin\\.com/(company|in)/", "tiktok": "(?i)tiktok\\.com/@"}
CARDS = "li.product,article.product,.product-small,.product-item,div.product"
BADGES = ".onsale,.sold-out-label,.product-label,[class*=badge]"
CHROME = {"header", "nav", "footer", "aside"}
CHROME_CLASS = re.compile(r"related|recommend|upsell|cross-sell|recently|mini-?cart")
# Weights of the search check kinds.
CHECK_WEIGHTS = {"head": 25, "product": 10, "brand": 10, "typo": 15, "layout": 10, "prefix": 5, "translit": 8, "synonym": 9, "natural": 8}

PARSED = """page_id {id}, url string, title string, text string, body string, h1 array<string>, inputs string,
    links array<struct<href:string,text:string,title:string,chrome:boolean,nav:boolean>>, metas array<struct<name:string,content:string>>, itemtypes array<string>,
    specs array<struct<key:string,value:string>>, products array<string>, blocks array<string>"""
FACTS = frozenset("url title text body h1 inputs links metas itemtypes specs products blocks".split())


_dumps = json.JSONEncoder(ensure_ascii=False).encode


def _sold(n: dict) -> bool:
    kinds = n.get("@type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    product = any(k in ("Product", "ProductGroup", "IndividualProduct", "ProductModel") for k in kinds)
    return product or bool(n.get("name")) and isinstance(n.get("offers"), (dict, list))


def _nodes(v):
    """Every object of a JSON-LD document, outer ones first."""
    stack = [v]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            v = list(v.values())
        if isinstance(v, list):
            stack += reversed(v)


def _json_ld(scripts: list[H.Node]) -> Iterator:
    """The readable documents of JSON-LD scripts."""
    for s in scripts:
        try:
            yield json.loads("".join(p for p in s.parts if isinstance(p, str)))
        except (ValueError, RecursionError):  # broken, or nested deeper than the reader goes
            continue


def _top(doc) -> list[dict]:
    """The outer objects of a JSON-LD document."""
    top = doc if isinstance(doc, list) else doc.get("@graph") or [doc] if isinstance(doc, dict) else []
    return [b for b in top if isinstance(b, dict)]


def _is_ld(n: H.Node) -> bool:
    return n.tag == "script" and n.attrs.get("type") == "application/ld+json"


def _facts(url: str, html: str, want: frozenset[str] = FACTS) -> dict:
    """Those of the page operators' facts of one page that are wanted."""
    root = H.parse(html)
    by_tag = {t: [] for t in ("script", "tr", "dl", "body", "title", "h1", "input", "meta")}
    links, itemtypes = [], []
    stack = [(root, False, False)]
    while stack:  # every element once, with what holds for all below it: outside the page's content, part of a menu
        n, chrome, nav = stack.pop()
        attrs = n.attrs
        if attrs:
            kind = attrs.get("class")
            if kind:
                chrome = chrome or bool(CHROME_CLASS.search(kind))
                nav = nav or "menu" in kind
            nav = nav or attrs.get("role") == "navigation"
            if "itemtype" in attrs:
                itemtypes.append(attrs["itemtype"])
        chrome = chrome or n.tag in CHROME
        nav = nav or n.tag == "nav" or n.tag == "header"
        if n.tag == "a":
            if "href" in attrs and "links" in want:
                links.append({"href": attrs["href"], "text": n.text(), "title": attrs.get("title") or "", "chrome": chrome, "nav": nav})
        elif n.tag in by_tag:
            by_tag[n.tag].append(n)
        stack += [(p, chrome, nav) for p in reversed(n.parts) if not isinstance(p, str)]
    blocks, products = [], []
    for doc in _json_ld([s for s in by_tag["script"] if _is_ld(s)]) if want & {"blocks", "products"} else ():
        if "blocks" in want:
            blocks += [_dumps(b) for b in _top(doc)]
        if "products" in want:
            products += [_dumps(n) for n in _nodes(doc) if _sold(n)]
    specs = []
    for tr in by_tag["tr"] if "specs" in want else ():
        cells = [x.text() for x in tr.parts if isinstance(x, H.Node) and x.tag in ("th", "td")]
        if len(cells) == 2 and all(cells):
            specs.append({"key": cells[0], "value": cells[1]})
    for dl in by_tag["dl"] if "specs" in want else ():
        items = [x for x in dl.parts if isinstance(x, H.Node)]
        for a, b in zip(items, items[1:]):
            key, value = (a.text(), b.text()) if a.tag == "dt" and b.tag == "dd" else ("", "")
            if key and value:
                specs.append({"key": key, "value": value})
    body = by_tag["body"][0] if by_tag["body"] else root
    made = {"url": lambda: url, "title": lambda: " ".join(n.text() for n in by_tag["title"]), "text": root.text, "body": body.text,
            "h1": lambda: [n.text() for n in by_tag["h1"]], "inputs": lambda: " ".join(n.attrs.get("value", "") for n in by_tag["input"]),
            "links": lambda: links, "metas": lambda: [{"name": n.attrs.get("property") or n.attrs.get("name") or "", "content": n.attrs.get("content", "")} for n in by_tag["meta"]],
            "itemtypes": lambda: itemtypes, "specs": lambda: specs, "products": lambda: products, "blocks": lambda: blocks}
    return {k: make() for k, make in made.items() if k in want}


def parse_pages(pages: DataFrame, *facts: str) -> DataFrame:
    """One row per page (page_id, url, html) with its text, links, tables, meta tags and JSON-LD; with ``facts``, these columns only."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(PARSED.format(id=pages.schema["page_id"].dataType.simpleString()))}
    want = frozenset(facts or kinds) - {"page_id"}
    if want - set(kinds):
        raise ValueError(f"unknown facts: {sorted(want - set(kinds))}")

    def run(ids, urls, htmls):
        return [{"page_id": p, **_facts(u, h or "", want)} for p, u, h in zip(ids, urls, htmls)]

    return map_parts(pages.select("page_id", "url", "html"), run, ", ".join(f"{k} {t}" for k, t in kinds.items() if k == "page_id" or k in want))


def visible_text(parsed: DataFrame) -> DataFrame:
    """SCR-01: text of each page without script and style."""
    return parsed.select("page_id", "text")


def json_ld_products(parsed: DataFrame) -> DataFrame:
    """SCR-02: product-like JSON-LD objects: (page_id, url, node)."""
    return parsed.select("page_id", "url", F.explode("products").alias("node"))


def own_page_product(nodes: DataFrame) -> DataFrame:
    """SCR-03: the only product of a page, or those whose url is the page's."""
    own = F.get_json_object("node", "$.url") == c("url")
    return nodes.withColumn("_n", F.count("*").over(Window.partitionBy("page_id"))).filter(c("page_id").isNotNull()).filter((c("_n") == 1) | F.coalesce(own, F.lit(False))).drop("_n")


def _names(node: Column, path: str) -> Column:
    """A name that may be text, an object with a name or a list of either."""
    raw = F.get_json_object(node, path)
    many = F.from_json(F.get_json_object(node, f"{path}[*].name"), "array<string>")
    return F.nullif(F.coalesce(F.when(raw.startswith("["), F.array_join(F.coalesce(many, F.from_json(raw, "array<string>")), ", ")),
                               F.get_json_object(node, f"{path}.name"), raw), F.lit(""))


def product_from_page(parsed: DataFrame) -> DataFrame:
    """SCR-04: the first JSON-LD block with offers as (page_id, sku, name, price, currency, stock_status, author, publisher, isbn)."""
    get = lambda p: F.get_json_object("node", p)
    first = F.filter("blocks", lambda b: F.get_json_object(b, "$.offers").isNotNull() & (
        F.get_json_object(b, "$.sku").isNotNull() | F.get_json_object(b, "$.name").isNotNull()))
    offer = lambda f: F.coalesce(get(f"$.offers[0].{f}"), get(f"$.offers.{f}"))
    stock = F.lower(F.element_at(F.split(F.coalesce(offer("availability"), F.lit("")), "/"), -1))
    number = F.nullif(F.regexp_extract("url", "/(\\d{6,14})/?$", 1), F.lit(""))
    return parsed.select("page_id", "url", F.try_element_at(first, F.lit(1)).alias("node")).filter("node is not null").select(
        "page_id", F.coalesce(get("$.sku"), number).alias("sku"), F.trim(get("$.name")).alias("name"), offer("price").try_cast("double").alias("price"),
        offer("priceCurrency").alias("currency"), F.when(stock == "instock", "instock").when(stock != "", "outofstock").otherwise("unknown").alias("stock_status"),
        _names(c("node"), "$.author").alias("author"), _names(c("node"), "$.publisher").alias("publisher"), get("$.isbn").alias("isbn"))


def extract_by_spec(pages: DataFrame, spec: dict) -> DataFrame:
    """SCR-05: declarative fields per page: a JSON-LD path, else a selector (with attribute), then a capture pattern.

    ``spec`` is {product_url, fields {name: {jsonld?, selector?, attr?, pattern?, instock?}}}; pages without a name are dropped.
    """
    fields = spec["fields"]

    def pick(v, path):
        for k in path.split("."):
            v = v[0] if isinstance(v, list) and v else v
            v = v.get(k) if isinstance(v, dict) else None
        return v

    def flat(v):
        if isinstance(v, list):
            return ", ".join(filter(None, map(flat, v)))
        if isinstance(v, dict):
            return str(v.get("name") or v.get("url") or v.get("@id") or "")
        return "" if v is None else str(v)

    def one(html):
        root = H.parse(html)
        nodes = list(root.walk())
        blocks = [b for doc in _json_ld([n for n in nodes if _is_ld(n)]) for b in _top(doc)]
        product = next((b for b in blocks if b.get("offers") or b.get("sku")), blocks[0] if blocks else None)
        out = {}
        for name, f in fields.items():
            v = flat(pick(product, f["jsonld"])).strip() if f.get("jsonld") and product else ""
            if not v and f.get("selector"):
                hit = next((n for n in nodes if any(H.matches(n, s) for s in f["selector"].split(","))), None)
                v = (hit.attrs.get(f["attr"], "") if f.get("attr") else hit.text()).strip() if hit else ""
            if v and f.get("pattern"):
                m = re.search(f["pattern"], v, re.I)
                v = (m[1] if m.groups() else m[0]).strip() if m else ""
            out[name] = v
        return out

    def run(ids, urls, htmls):
        return [{"page_id": p, "url": u, **one(h or "")} for p, u, h in zip(ids, urls, htmls)]

    types = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, " + ", ".join(f"`{n}` string" for n in fields)
    out = map_parts(pages.select("page_id", "url", "html"), run, types).filter("name <> ''")
    if "availability" in fields:
        stock = fields["availability"].get("instock", "instock|in stock|במלאי")
        a = c("availability")
        out = out.withColumn("availability", F.when(a == "", "unknown").when(a.rlike(f"(?i){stock}"), "instock").when(
            a.rlike("(?i)backorder|preorder"), "onbackorder").otherwise("outofstock"))
    if "price" in fields:
        price = F.regexp_replace("price", "[^\\d.]", "").try_cast("double")
        out = out.withColumn("price", F.when(price > 0, price))
    return out.withColumn("key", product_key(c("url"), spec["product_url"]))


def score_extraction(rows: DataFrame, cards: DataFrame, pages: DataFrame | None = None, product_url: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """AGG-43: fill rate per extracted field and agreement with the catalog's titles by key (one row).

    With ``pages`` (page_id, url; one row per page) all rates count every page, also those without an extracted row, and a page
    meets its card by the key in its url (``product_url``); otherwise only extracted rows count. ``fields`` are further text columns to rate.
    """
    if pages is None:
        every = rows.withColumn("_key", c("key"))
    else:
        every = pages.select("page_id", product_key(c("url"), product_url).alias("_key")).join(rows.drop("url"), "page_id", "left")
    j = every.join(cards.select(c("key").alias("_key"), c("title").alias("_title")), "_key", "left")
    a, b = search_normalize(c("_title")), search_normalize(F.coalesce("name", F.lit("")))
    rate = lambda cond: F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))
    return j.agg(F.count("*").alias("pages"), rate(c("name") != "").alias("name"), rate(c("price").isNotNull()).alias("price"),
                 rate(c("availability") != "unknown").alias("stock"), rate(c("key").isNotNull()).alias("key"), *[rate(c(f) != "").alias(f) for f in fields],
                 F.avg(F.when(c("_title").isNotNull(), F.contains(b, a).cast("double"))).alias("agreement"))


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against its page."""
    site = F.regexp_extract(base, "^([a-zA-Z][\\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    return F.when(href.rlike("^[a-zA-Z][\\w+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href)).when(
        href.startswith("/"), F.concat(site, href)).when(href.rlike("^[?#]"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href)).otherwise(
        F.concat(folder, F.lit("/"), href))


def page_links(parsed: DataFrame) -> DataFrame:
    """SCR-06: same-origin links worth following, one row per page and link; only numeric pagination survives in the query."""
    rows = parsed.select("page_id", "url", F.explode("links").alias("l")).withColumn("_u", absolute(F.trim("l.href"), c("url")))
    path = F.regexp_replace(F.regexp_replace("_u", "[?#].*$", ""), "^[a-zA-Z][\\w+.-]*://[^/]*", "")
    query = F.split(F.regexp_extract(F.regexp_replace("_u", "#.*$", ""), "\\?(.*)$", 1), "&")
    kept = F.array_join(F.filter(query, lambda q: q.rlike(PAGE_PARAMS)), "&")
    link = F.concat(origin(c("_u")), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return rows.filter((origin(c("_u")) == origin(c("url"))) & ~path.rlike(SKIP_PATH)).select("page_id", link.alias("link")).distinct()


def _patterns(pages: DataFrame, patterns: dict[str, str], name: str) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(c("html").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return pages.select("page_id", F.explode(hit).alias(name))


def platform_signals(pages: DataFrame) -> DataFrame:
    """SCR-07: platforms whose patterns occur in a page."""
    return _patterns(pages, PLATFORM_PATTERNS, "platform")


def search_vendors(pages: DataFrame) -> DataFrame:
    """SCR-08: search providers whose patterns occur in a page."""
    return _patterns(pages, VENDOR_PATTERNS, "vendor")


def parse_result_page(parsed: DataFrame, query: str = "query") -> DataFrame:
    """SCR-09: result pages read by their distinct product links outside navigation: (page_id, measurable, count, titles).

    Needs an echo of the query; an explicit "no results" is 0, a silently empty page is unmeasurable.
    ``parsed`` also carries the query column.
    """
    site = bare_host(host(c("url")))
    outside = F.filter("links", lambda l: ~l["chrome"])
    keyed = F.transform(outside, lambda l: F.struct(absolute(F.trim(l["href"]), c("url")).alias("u"), F.coalesce(F.nullif(l["title"], F.lit("")), l["text"]).alias("t")))
    own = F.filter(keyed, lambda x: x["u"].rlike(PRODUCT_PATH) & (bare_host(host(x["u"])) == site))
    key = lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")
    keys = F.array_distinct(F.transform(own, lambda x: key(x["u"])))
    titles = F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(own, lambda x: key(x["u"]) == k), lambda x: F.trim(x["t"])),
                                                                     lambda t: t != ""), F.lit(1)), F.coalesce(F.try_url_decode(F.element_at(F.split(k, "/"), -1)), F.element_at(F.split(k, "/"), -1))))
    seen = parsed.withColumn("_echo", F.contains(audit_normalize(F.concat_ws(" ", "title", "inputs", "body")), audit_normalize(c(query)))).withColumn(
        "_none", c("body").rlike(NO_RESULTS)).withColumn("_titles", titles)
    ok = c("_echo") & ((F.size("_titles") > 0) | c("_none"))
    shown = F.when(ok & ~c("_none"), F.slice("_titles", 1, 10)).otherwise(EMPTY())
    return seen.select("page_id", query, ok.alias("measurable"), F.when(ok & ~c("_none"), F.size("_titles")).otherwise(0).alias("count"), shown.alias("titles"))


def product_evidence(parsed: DataFrame) -> DataFrame:
    """SCR-10: why a page is a product page: jsonld (one to three products), markup, or null."""
    meta = lambda name, rx: F.exists("metas", lambda m: (m["name"] == name) & m["content"].rlike(rx))
    typed = F.size(F.filter("itemtypes", lambda t: t.contains("schema.org/Product"))) == 1
    phrase = (F.size("h1") == 1) & c("body").rlike(BUY_PHRASE) & c("body").rlike(CURRENCY_SIGN)
    return parsed.select("page_id", F.when(F.size("products").between(1, 3), "jsonld").when(
        meta("og:type", "(?i)^product") | F.exists("metas", lambda m: m["name"] == "product:price:amount") | typed | phrase, "markup").alias("evidence"))


def nav_terms(parsed: DataFrame, n: int = 40) -> DataFrame:
    """SCR-11: menu words of a page (2 to 24 characters, up to three words, stop list), first ``n``."""
    t = F.transform(F.filter("links", lambda l: l["nav"]), lambda l: F.trim(l["text"]))
    good = F.array_distinct(F.filter(t, lambda x: F.length(x).between(2, 24) & (F.size(F.split(x, " ")) <= 3) & ~x.rlike(NAV_STOP)))
    return parsed.select("page_id", F.posexplode(F.slice(good, 1, n)).alias("pos", "term"))


def spec_tables(parsed: DataFrame) -> DataFrame:
    """SCR-12: key and value of two-cell rows and definition lists; a repeated key keeps its last value."""
    rows = parsed.select("page_id", F.posexplode("specs").alias("pos", "s"))
    return rows.groupBy("page_id", c("s.key").alias("key")).agg(F.max_by("s.value", "pos").alias("value"))


def badges(pages: DataFrame, products: DataFrame) -> DataFrame:
    """SCR-13: label texts inside a product's own card: (page_id, product_id, text, kind); hidden labels and cards of several products are left out."""
    hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

    def gone(n):
        return any("hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or hidden.search(x.attrs.get("style", "")) for x in n.up())

    def one(html):
        root = H.parse(html)
        cards = H.select(root, CARDS)
        marks = {id(x) for x in cards}
        nearest = lambda n: next((x for x in n.up() if id(x) in marks), None)
        for number, card in enumerate(cards):
            inside = [n for n in card.walk() if nearest(n) is card]
            hrefs = [n.attrs["href"] for n in inside if n.tag == "a" and n.attrs.get("href")]
            for n in inside:
                text = n.text() if any(H.matches(n, s) for s in BADGES.split(",")) and not gone(n) else ""
                if 0 < len(text) <= 100:
                    kind = "sale" if "onsale" in n.classes else "stock" if "sold-out-label" in n.classes else "merchant"
                    yield number, list(dict.fromkeys(hrefs)), text, kind

    def run(ids, urls, htmls):
        names = ("page_id", "url", "_card", "hrefs", "text", "kind")
        return [dict(zip(names, (p, u, *r))) for p, u, h in zip(ids, urls, htmls) for r in one(h or "")]

    from storelens.functions.urls import product_url_key
    t = pages.schema["page_id"].dataType.simpleString()
    seen = map_parts(pages.select("page_id", "url", "html"), run, f"page_id {t}, url string, _card int, hrefs array<string>, text string, kind string")
    links = seen.select("page_id", "_card", "text", "kind", F.explode("hrefs").alias("h"), "url").withColumn("_k", product_url_key(absolute(c("h"), c("url"))))
    known = products.select(product_url_key(c("url")).alias("_k"), c("id").alias("product_id"))
    hit = links.join(known, "_k").groupBy("page_id", "_card", "text", "kind").agg(F.min("product_id").alias("product_id"), F.max("product_id").alias("_last"))
    return hit.filter("product_id = _last").select("page_id", "product_id", "text", "kind").distinct()


def text_contacts(text: Column) -> Column:
    """FN-29: struct<emails, phones, company>: e-mails without junk, phones in one form, company number."""
    emails = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){EMAIL}"), 0), lambda e: F.lower(e)), lambda e: ~e.rlike(JUNK_EMAIL)))
    return F.struct(emails.alias("emails"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), 0), phone_key)).alias("phones"),
                    F.nullif(F.regexp_extract(text, COMPANY, 1), F.lit("")).alias("company"))


def phone_key(p: Column) -> Column:
    """One form per phone number: digits, national prefix 0; short star numbers as they are."""
    return F.when(p.startswith("*"), p).otherwise(F.regexp_replace(F.regexp_replace(p, "[^\\d+]", ""), "^\\+972", "0"))


def contacts(parsed: DataFrame) -> DataFrame:
    """SCR-14: contact facts per host from page text and mailto, tel, WhatsApp and social links: (host, kind, value)."""
    found = text_contacts(c("body"))
    hrefs = F.transform("links", lambda l: F.trim(l["href"]))
    of = lambda rx, fn: F.transform(F.filter(hrefs, lambda h: h.rlike(rx)), fn)
    s = lambda kind, arr: F.transform(arr, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    mail = F.filter(of("(?i)^mailto:", lambda h: F.lower(F.trim(F.regexp_replace(F.regexp_replace(h, "(?i)^mailto:", ""), "\\?.*$", "")))), lambda e: ~e.rlike(JUNK_EMAIL))
    tel = of("(?i)^tel:", lambda h: phone_key(F.regexp_replace(h, "(?i)^tel:", "")))
    chat = of("wa\\.me/|whatsapp\\.com/send", lambda h: F.coalesce(F.nullif(F.regexp_extract(h, "wa\\.me/(\\+?\\d+)", 1), F.lit("")), F.regexp_extract(h, "phone=(\\+?\\d+)", 1)))
    rows = F.concat(s("email", found["emails"]), s("email", mail), s("phone", found["phones"]), s("phone", tel), s("whatsapp", chat),
                    s("company", F.array_compact(F.array(found["company"]))), *[s(k, of(rx, lambda h: h)) for k, rx in SOCIAL.items()])
    out = parsed.select(bare_host(host(c("url"))).alias("host"), F.inline(rows)).filter("value <> ''")
    return out.filter((c("kind") != "phone") | c("value").startswith("*") | (F.length("value") >= 9)).distinct()


def link_frontier(links: DataFrame, visited: DataFrame, robots: DataFrame, agent: str = "storelens") -> DataFrame:
    """SCR-15: one breadth-first step: links not seen yet and allowed by robots.txt."""
    fresh = links.select(c("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
    return robots_allowed(fresh, robots, agent).filter("allowed").select("url")


def repeated_page(pages: DataFrame) -> DataFrame:
    """SCR-16: response pages (source, page, ids) with the same id list as the page before; pages are numbered one by one."""
    signed = pages.withColumn("_s", F.sha2(F.to_json("ids"), 256))
    before = signed.select("source", (c("page") + 1).alias("page"), c("_s").alias("_before"))
    same = (F.size("ids") > 0) & F.coalesce(c("_s") == c("_before"), F.lit(False))
    return signed.join(before, ["source", "page"], "left").select("source", "page", same.alias("repeated"))


def robots_rules(robots: DataFrame, agent: str = "storelens") -> DataFrame:
    """Rules of ``*`` and the named agent per host: (host, rules array<struct<allow, path>>)."""
    line = lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, "#.*", ""), "\\r", ""))
    lines = F.filter(F.transform(F.split("body", "\n"), line), lambda l: l.rlike("^[\\w-]+\\s*:"))
    key = lambda l: F.lower(F.regexp_extract(l, "^([\\w-]+)", 1))
    value = lambda l: F.regexp_extract(l, "^[\\w-]+\\s*:\\s*(.*)$", 1)
    rule_t = "array<struct<allow:boolean,path:string>>"
    start = F.struct(F.lit(False).alias("applies"), F.lit(False).alias("head"), F.array().cast(rule_t).alias("rules"))

    def step(acc, l):
        k, v = key(l), value(l)
        mine = (v == "*") | F.lower(v).contains(agent)
        rule = F.when(acc["applies"] & k.isin("allow", "disallow") & (v != ""), F.concat(
            acc["rules"], F.array(F.struct((k == "allow").alias("allow"), v.alias("path"))))).otherwise(acc["rules"])
        agent_line = F.struct((F.when(acc["head"], acc["applies"]).otherwise(False) | mine).alias("applies"), F.lit(True).alias("head"), acc["rules"].alias("rules"))
        return F.when(k == "user-agent", agent_line).otherwise(F.struct(acc["applies"].alias("applies"), F.lit(False).alias("head"), rule.alias("rules")))

    return robots.select("host", F.aggregate(lines, start, step)["rules"].alias("rules"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "storelens") -> DataFrame:
    """FLT-15: adds ``allowed``: the longest matching rule decides, allow wins ties, no rule means allowed."""
    target = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z][\\w+.-]*://[^/?#]*", ""), "#.*$", ""))
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    escaped = lambda p: F.regexp_replace(F.regexp_replace(p, "([.+?^${}()|\\[\\]\\\\])", "\\\\$1"), "\\*", ".*")
    regex = lambda p: F.concat(F.lit("^"), F.regexp_replace(escaped(p), "\\\\\\$$", "\\$"))
    j = urls.withColumn("_host", host(c("url"))).withColumn("_path", path).join(
        robots_rules(robots, agent).withColumnRenamed("host", "_host"), "_host", "left")
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<allow:boolean,path:string>>")), lambda r: F.rlike(c("_path"), regex(r["path"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return j.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_path", "rules")


def product_page_urls(urls: DataFrame, pattern: str, site: str) -> DataFrame:
    """FLT-14: https urls of the own site that match the product rule, the first per key: (key, url)."""
    own = F.regexp_replace(F.lit(site.lower()), "^[a-z]+://(www\\.)?", "")
    keyed = urls.filter(c("url").rlike("^https://") & (bare_host(host(c("url"))) == own)).withColumn("key", product_key(c("url"), pattern))
    return keyed.filter("key is not null").groupBy("key").agg(F.min("url").alias("url"))


def read_sitemaps(xml: DataFrame, keep: str = "", site: str | None = None) -> DataFrame:
    """SRC-08: (loc, lastmod, is_map) entries of sitemap documents (column ``body``), url sets and indexes alike."""
    rows = xml.select(F.explode(F.regexp_extract_all("body", F.lit("(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)).alias("e"),
                      c("body").rlike("(?i)<sitemapindex[\\s>]").alias("is_map"))
    loc = F.replace(F.regexp_extract("e", "<loc>\\s*(?:<!\\[CDATA\\[)?\\s*([^<\\s\\]]+)\\s*(?:\\]\\]>)?\\s*</loc>", 1), F.lit("&amp;"), F.lit("&"))
    mod = F.nullif(F.regexp_extract("e", "<lastmod>\\s*([^<\\s]+)", 1), F.lit(""))
    out = rows.select(loc.alias("loc"), F.try_to_timestamp(mod).alias("lastmod"), "is_map").filter("loc <> ''")
    if keep:
        out = out.filter(~c("is_map") | c("loc").rlike(f"(?i){keep}"))
    if site:
        out = out.filter(origin(c("loc")) == origin(F.lit(site + "/")))
    return out.groupBy("loc", "is_map").agg(F.max("lastmod").alias("lastmod"))


def read_url_index(lines: DataFrame) -> DataFrame:
    """SRC-09: product urls of JSON lines {url} (column ``value``): (host, url, hint)."""
    url = F.get_json_object("value", "$.url")
    names = F.create_map(*[F.lit(x) for kv in PLATFORM_OF_PATH.items() for x in kv])
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-zA-Z][\\w+.-]*://[^/]*", "")
    rows = lines.select(url.alias("url")).filter("url is not null").withColumn("_m", F.lower(F.regexp_extract(path, PRODUCT_PATH, 1)))
    return rows.filter("_m <> ''").select(bare_host(host(c("url"))).alias("host"), "url", F.try_element_at(names, c("_m")).alias("hint"))


def stores_by_host(urls: DataFrame) -> DataFrame:
    """AGG-37: product urls and the commonest platform hint per host."""
    per = urls.groupBy("host", "hint").agg(F.count("*").alias("n"))
    return per.groupBy("host").agg(F.sum("n").alias("product_urls"), F.min_by("hint", F.struct(-c("n"), c("hint"))).alias("hint"))


def clicked_urls(clicks: DataFrame, carts: DataFrame) -> DataFrame:
    """AGG-35: clicks plus carts per product url, most first."""
    return clicks.select("url").unionByName(carts.select("url")).filter("url <> ''").groupBy("url").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "url")


def judge_results(results: DataFrame) -> DataFrame:
    """CLS-08: adds ``pass``: null when unmeasurable, false without results, else relevant or overlapping its root query.

    ``results`` is (host, q, kind, of, measurable, count, titles, relevant); ``relevant`` of the first five comes from a judge, if any.
    """
    r = results.withColumn("_q", audit_normalize(c("q"))).withColumn("_of", audit_normalize(c("of"))).withColumn(
        "_t", F.transform(F.split(audit_normalize(F.concat_ws(" + ", F.slice("titles", 1, 10))), " \\+ "), lambda t: F.trim(t)))
    root = r.select("host", c("q").alias("of"), F.slice("titles", 1, 5).alias("_root"))
    j = r.join(root, ["host", "of"], "left")
    overlap = F.coalesce(F.arrays_overlap("titles", "_root"), F.lit(False))
    match = lambda q, ts: F.exists(ts, lambda t: title_matches(q, t))
    own = F.when(c("of").isNotNull(), overlap | match(c("_of"), c("_t"))).otherwise(match(c("_q"), F.slice("_t", 1, 5)))
    good = F.when(c("relevant").isNotNull(), c("relevant") / F.least(F.lit(5), F.size("titles")) >= 0.6).otherwise(own) | overlap
    return j.withColumn("pass", F.when(~c("measurable"), F.lit(None)).when(c("count") == 0, False).otherwise(good)).drop("_q", "_of", "_t", "_root")


def search_score(judged: DataFrame) -> DataFrame:
    """AGG-38: per host the weighted score 0-100, grade, zero-result rate and the check kinds to fix, worst first."""
    weights = F.create_map(*[F.lit(x) for kv in CHECK_WEIGHTS.items() for x in kv])
    rows = judged.filter(c("pass").isNotNull()).withColumn("_w", F.try_element_at(weights, c("kind")))
    kinds = rows.filter("_w is not null").groupBy("host", "kind", "_w").agg(F.count_if("pass").alias("p"), F.count("*").alias("n"))
    loss = c("_w") * (F.lit(1.0) - c("p") / c("n"))
    per = kinds.groupBy("host").agg(
        F.floor(F.sum(c("_w") * c("p") / c("n")) / F.sum("_w") * 100 + 0.5).cast("int").alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("p") < c("n"), F.struct((-loss).alias("l"), c("kind").alias("k"))))), lambda x: x["k"]), "|").alias("fixes"))
    zero = rows.groupBy("host").agg(F.floor(F.avg((c("count") == 0).cast("double")) * 100 + 0.5).cast("int").alias("zero_rate"))
    grade = F.when(c("score") >= 80, "good").when(c("score") >= 60, "fair").otherwise("poor")
    return per.join(zero, "host").withColumn("grade", F.when(c("score").isNotNull(), grade))


def unreadable_store(results: DataFrame) -> DataFrame:
    """CLS-09: stores measured in fewer than max(3, 60 %) checks, or showing one list for more than half of four or more."""
    per = results.groupBy("host").agg(F.count("*").alias("checks"), F.count_if("measurable").alias("measured"))
    lists = results.filter(c("measurable") & (c("count") > 0)).groupBy("host", F.array_join(F.slice("titles", 1, 5), "|").alias("list")).agg(
        F.count("*").alias("n")).groupBy("host").agg(F.max("n").alias("top"), F.sum("n").alias("lists"))
    few = c("measured") < F.greatest(F.lit(3.0), c("checks") * 0.6)
    same = (c("lists") >= 4) & (c("top") / c("lists") > 0.5)
    return per.join(lists, "host", "left").select("host", "checks", "measured", F.when(few, "few-measured").when(same, "same-list").alias("reason"))


def rank_leads(audits: DataFrame, threshold: int = 70) -> DataFrame:
    """SRT-07: audited stores, leads (below the threshold, not of low confidence) first, then by score."""
    lead = (c("score") < threshold) & (c("confidence") != "low")
    return audits.withColumn("lead", lead).orderBy(c("lead").desc(), "score", "host")
