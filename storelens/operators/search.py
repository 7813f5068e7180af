"""Search as batch jobs over a query table and a product table (SCH-01..15, 19, 24, 25, SET-03, 07, SRT-06, 08, WIN-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions.text import (PRICE_CLAUSE, apply_spelling, article_prefixed, inflections, keyboard_layout,
                                      prefix_stems, search_normalize, swap_typo, tokens)
from storelens.operators.catalog import EMPTY, sellable
from storelens.operators.containment import contained, words_holding
from storelens.operators.ranks import global_rank, rank_bucket
from storelens.session import cut, large, written

c = F.col
# Words that say nothing about a product.
STOP_WORDS = ("של", "עם", "את", "על", "לא", "כל", "גם", "או", "אם", "זה", "זו", "בין", "עד", "the", "and", "for", "with", "set", "new")


# ---- index ---------------------------------------------------------------------------------------------------

def index_text(df: DataFrame, ascii_only: bool = False) -> Column:
    """Normalised title, description, categories, tags and specification values."""
    parts = ["title", "description"] + [F.array_join(x, " ") for x in ("categories", "tags") if x in df.columns]
    if "specifications" in df.columns:
        parts.append(F.array_join(F.map_values("specifications"), " "))
    return search_normalize(F.concat_ws(" ", *parts), ascii_only)


def build_postings(products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """SCH-01: (term, product_id), one row per distinct token of a product."""
    return products.select(c("id").alias("product_id"), F.explode(F.array_distinct(tokens(index_text(products, ascii_only)))).alias("term"))


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings stored by term hash, so that a lookup reads only the partitions of its terms."""
    part = F.pmod(F.hash("term"), F.lit(buckets)).alias("part")
    (postings.select("*", part).repartition("part", "term").sortWithinPartitions("part", "term")
     .write.mode("overwrite").partitionBy("part").parquet(path))


def build_identifiers(products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """SCH-02: (key, product_id) of ids, skus, mpns and gtins, those of variants that are not sold out included."""
    own = [c(x).cast("string") for x in ("id", "sku", "mpn", "gtin") if x in products.columns]
    keys = F.array(*own)
    if "variants" in products.columns:
        have = products.schema["variants"].dataType.elementType.fieldNames()
        live = F.filter("variants", lambda v: ~F.coalesce(v["stock_status"] == "outofstock", F.lit(False)))
        keys = F.concat(keys, F.flatten(F.transform(live, lambda v: F.array(*[v[x].cast("string") for x in ("id", "sku", "mpn", "gtin") if x in have]))))
    rows = products.select(c("id").alias("product_id"), F.explode(F.array_compact(keys)).alias("k"))
    return rows.select(search_normalize(c("k"), ascii_only).alias("key"), "product_id").filter("key <> ''").distinct()


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df): the distinct terms with their number of products."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


# ---- query plans ---------------------------------------------------------------------------------------------

def _replace_first(text: Column, sub: Column, by: str = " ") -> Column:
    at = F.instr(text, sub)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + F.length(sub), F.length(text)))


def _consume(text: Column, rules: list[tuple[str, str]], once: bool = False) -> Column:
    """Fold (label, phrase) rules over the text in order: struct<rem, hits>; a found phrase is cut out once."""
    start = F.struct(text.alias("rem"), EMPTY().alias("hits"))
    if not rules:
        return start
    table = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(f" {p} ").alias("phrase")) for l, p in rules])

    def step(acc, r):
        hit = F.contains(acc["rem"], r["phrase"]) & (F.size(acc["hits"]) == 0 if once else F.lit(True))
        return F.when(hit, F.struct(_replace_first(acc["rem"], r["phrase"]).alias("rem"),
                                    F.array_union(acc["hits"], F.array(r["label"])).alias("hits"))).otherwise(acc)

    return F.aggregate(table, start, step)


def plan_queries(queries: DataFrame, profile: dict, ascii_only: bool = False) -> DataFrame:
    """SCH-03: what each query asks for: spelling, linked phrases, price, tags, one product type, colours,
    finishes and the remaining terms, each consumed from the text in this order.

    The profile is configuration: query_aliases {wrong: right}, scoped [{id, term, mode, product_ids}],
    tags {tag: [aliases]}, product_types {type: [aliases]}, colors [..], finishes {finish: [aliases]},
    semantic {phrase: [terms]}; all phrases normalised.
    """
    q = queries.withColumn("norm", search_normalize(c("query"), ascii_only))
    q = q.withColumn("spelled", apply_spelling(c("norm"), profile.get("query_aliases", {})))
    pad = F.concat(F.lit(" "), c("spelled"), F.lit(" "))
    by_length = lambda rules: sorted(rules, key=lambda r: -len(r[1]))
    scoped = by_length([(r["id"], r["term"]) for r in profile.get("scoped", [])])
    q = q.withColumn("_s", _consume(pad, scoped)).withColumn("scoped_rules", c("_s.hits")).withColumn("_rem", c("_s.rem"))
    clause = F.regexp_extract("_rem", PRICE_CLAUSE, 0)
    q = q.withColumn("max_price", F.regexp_extract("_rem", PRICE_CLAUSE, 1).try_cast("double")).withColumn(
        "_rem", F.when(clause != "", _replace_first(c("_rem"), clause)).otherwise(c("_rem")))
    tags = [(t, a) for t, al in profile.get("tags", {}).items() for a in [t.lower(), *al]]
    types = by_length([(t, a) for t, al in profile.get("product_types", {}).items() for a in al])
    colors = [(x, x) for x in profile.get("colors", [])]
    finishes = [(f, a) for f, al in profile.get("finishes", {}).items() for a in al]
    for name, rules, once in (("tags", tags, False), ("_types", types, True), ("colors", colors, False), ("finishes", finishes, False)):
        q = q.withColumn("_s", _consume(c("_rem"), rules, once)).withColumn(name, c("_s.hits")).withColumn("_rem", c("_s.rem"))
    terms = tokens(F.regexp_replace(F.trim("_rem"), " +", " "))
    extra = [F.when(F.contains("norm", F.lit(p)), F.array(*[F.lit(t) for t in ts])).otherwise(EMPTY())
             for p, ts in profile.get("semantic", {}).items()]
    q = q.withColumn("terms", F.array_distinct(F.concat(terms, *extra))).withColumn("product_type", F.try_element_at("_types", F.lit(1)))
    return q.drop("_s", "_rem", "_types")


def filters_hold() -> Column:
    """Whether a product row joined to a plan row satisfies the plan's filters."""
    lit_true = F.lit(True)
    return (sellable_struct() & (c("product_type").isNull() | c("p.product_type").eqNullSafe(c("product_type")))
            & F.forall("colors", lambda x: F.array_contains("p.colors", x))
            & F.forall("finishes", lambda x: F.array_contains("p.finishes", x))
            & F.forall("tags", lambda x: F.array_contains("p.tags", x))
            & (c("max_price").isNull() | F.coalesce(c("p.price") <= c("max_price"), F.lit(False))) & lit_true)


def sellable_struct() -> Column:
    return ~c("p.hidden") & c("p.stock_status").isin("instock", "onbackorder")


def search_cards(products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(product_id, p): what retrieval needs of a product, its title words, text and text tokens included."""
    opt = lambda name, default: c(name) if name in products.columns else default
    read = products.withColumn("_title", search_normalize(c("title"), ascii_only)).withColumn("_text", index_text(products, ascii_only))
    return read.select(c("id").alias("product_id"), F.struct(
        c("_title").alias("title"), F.array_distinct(tokens(c("_title"))).alias("words"), c("_text").alias("text"), F.array_distinct(tokens(c("_text"))).alias("tokens"),
        opt("product_type", F.lit(None).cast("string")).alias("product_type"), opt("colors", EMPTY()).alias("colors"),
        opt("finishes", EMPTY()).alias("finishes"), "tags", "price", "hidden", "stock_status",
        F.coalesce(opt("popularity", F.lit(0.0)), F.lit(0.0)).alias("popularity")).alias("p"))


def identifier_hits(plans: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(query_id, product_id) of queries that are an identifier."""
    return plans.select("query_id", c("norm").alias("key")).join(large(identifiers), "key").select("query_id", "product_id")


def _anchors(cards: DataFrame, words: str) -> DataFrame:
    """(key, product_id): every requirement a query can name; ``any`` serves queries that only bound the price."""
    key = lambda p, col: F.transform(col, lambda x: F.concat(F.lit(p), x))
    kind = F.when(c("p.product_type").isNotNull(), F.array(F.concat(F.lit("p:"), "p.product_type"))).otherwise(EMPTY())
    every = F.concat(key("t:", c(f"p.{words}")), kind, key("c:", c("p.colors")), key("f:", c("p.finishes")), key("g:", c("p.tags")), F.array(F.lit("any")))
    return cards.select("product_id", F.explode(F.array_distinct(every)).alias("key"))


def match_exact(plans: DataFrame, cards: DataFrame, identifiers: DataFrame) -> DataFrame:
    """SCH-04: identifier hits, else products meeting all filters with every term in the title: (query_id, product_id).

    Each query is driven by its rarest requirement only; the others are tested on
    the joined product, so a common word never multiplies rows.
    """
    exact = identifier_hits(plans, identifiers)
    by_id = exact.join(large(cards), "product_id").filter(sellable_struct()).select("query_id", "product_id")
    rest = plans.join(by_id.select("query_id").distinct(), "query_id", "left_anti")
    key = lambda p, col: F.transform(col, lambda x: F.concat(F.lit(p), x))
    kind = F.when(c("product_type").isNotNull(), F.array(F.concat(F.lit("p:"), "product_type"))).otherwise(EMPTY())
    need = F.concat(key("t:", c("terms")), kind, key("c:", c("colors")), key("f:", c("finishes")), key("g:", c("tags")))
    wants = rest.filter("norm <> ''").select("query_id", F.explode(F.when(F.size(need) > 0, need).otherwise(F.array(F.lit("any")))).alias("key"))
    anchors = _anchors(cards, "words")
    sizes = anchors.join(wants.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    driver = wants.join(sizes, "key", "left").groupBy("query_id").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), c("key"))).alias("key"))
    pairs = driver.join(large(anchors), "key").select("query_id", "product_id")
    fits = F.forall("terms", lambda t: F.array_contains("p.words", t)) & filters_hold()
    found = pairs.join(rest, "query_id").join(large(cards), "product_id").filter(fits).select("query_id", "product_id")
    return by_id.unionByName(found)


# ---- term resolution -----------------------------------------------------------------------------------------

def deletions(word: Column, edits: Column) -> Column:
    """The word and all its forms with one (or two) letters deleted: words within n edits share such a form."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(
        F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = drop(word)
    two = F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, drop(w)).otherwise(EMPTY())))
    return F.array_distinct(F.when(edits >= 2, F.concat(F.array(word), one, two)).otherwise(F.concat(F.array(word), one)))


def close_terms(words: DataFrame, vocab: DataFrame, limit: Column, col: str = "term") -> DataFrame:
    """(term, target, edits) of different words within ``limit`` (1 or 2) edits, without comparing all pairs."""
    left = words.select(c(col).alias("term"), limit.alias("_limit")).distinct()
    keys = left.select("term", "_limit", F.explode(deletions(c("term"), c("_limit"))).alias("_key"))
    # A vocabulary word below six letters can only be reached by a query word that allows one edit.
    right = vocab.select(c("term").alias("target"), F.explode(deletions(c("term"), F.when(F.length("term") >= 6, 2).otherwise(1))).alias("_key"))
    d = F.levenshtein(c("term"), c("target"), 2)
    return keys.join(right, "_key").filter("term <> target").select("term", "target", "_limit").distinct().withColumn(
        "edits", d).filter((c("edits") >= 0) & (c("edits") <= c("_limit"))).select("term", "target", "edits")


def resolve_terms(terms: DataFrame, vocab: DataFrame, relax: bool = False, max_terms: int = 10) -> DataFrame:
    """SCH-05: (term, target, cost, how, edits): the index terms a query term stands for.

    Exact 0, other grammatical number 0.5; without these (or with ``relax``) the first
    known prefix stem 1 and the words at the least edit distance 1 + edits, the
    commonest ``max_terms`` of them. Fuzzy needs four letters and no digit; one edit
    is allowed below eight letters, two from there.
    """
    t = terms.select("term").distinct()
    row = lambda how, cost: [c("term"), c("target"), cost.cast("double").alias("cost"), F.lit(how).alias("how")]
    exact = t.join(vocab.select("term"), "term", "left_semi").withColumn("target", c("term")).select(*row("exact", F.lit(0)))
    known = vocab.select(c("term").alias("target"))
    forms = t.select("term", F.explode(inflections(c("term"))).alias("target")).join(known, "target", "left_semi").select(*row("inflection", F.lit(0.5)))
    own = exact.unionByName(forms)
    rest = t if relax else t.join(own.select("term").distinct(), "term", "left_anti")
    stems = rest.select("term", F.posexplode(prefix_stems(c("term"))).alias("pos", "target")).join(known, "target", "left_semi").groupBy("term").agg(
        F.min_by("target", "pos").alias("target")).select(*row("prefix", F.lit(1)))
    wordy = rest.filter((F.length("term") >= 4) & ~c("term").rlike("\\d"))
    near = close_terms(wordy, vocab.filter(~c("term").rlike("\\d")), F.when(F.length("term") >= 8, 2).otherwise(1))
    least = near.groupBy("term").agg(F.min("edits").alias("edits"))
    sized = near.join(least, ["term", "edits"]).join(vocab.select(c("term").alias("target"), "df"), "target")
    w = Window.partitionBy("term").orderBy(c("df").desc(), "target")
    fuzzy = sized.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= max_terms).select(
        "term", "target", (c("edits") + 1).cast("double").alias("cost"), F.lit("fuzzy").alias("how"), c("edits").cast("int").alias("edits"))
    none = F.lit(None).cast("int").alias("edits")
    return own.select("*", none).unionByName(stems.select("*", none)).unionByName(fuzzy)


# ---- retrieval -----------------------------------------------------------------------------------------------

def _costed(wants: DataFrame, resolved: DataFrame, postings: DataFrame, cards: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, product_id, penalty) of products holding every term under some reading.

    ``wants`` is (query_id, no, term); resolution rows carry the term they answer and
    may be specific to (query_id, no) when they have those columns.
    """
    keys = [k for k in ("query_id", "no", "term") if k in resolved.columns]
    reading = wants.join(resolved.select(*keys, "target", "cost"), keys, "left")
    sizes = postings.join(reading.select(c("target").alias("term")).distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    per = reading.join(sizes.select(c("term").alias("target"), "n"), "target", "left").groupBy("query_id", "no").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list(F.when(c("target").isNotNull(), F.struct("target", "cost"))).alias("readings"))
    driver = per.groupBy("query_id").agg(F.min_by("readings", F.struct("n", "no")).alias("driver"), F.collect_list("readings").alias("needs"))
    pairs = driver.select("query_id", F.explode("driver").alias("d")).select("query_id", c("d.target").alias("term")).join(
        large(postings), "term").select("query_id", "product_id").distinct()
    best = F.transform("needs", lambda rs: F.array_min(F.transform(F.filter(rs, lambda r: F.array_contains("p.tokens", r["target"])), lambda r: r["cost"])))
    return pairs.join(driver.select("query_id", "needs"), "query_id").join(large(cards), "product_id").withColumn("_c", best).filter(
        F.forall("_c", lambda x: x.isNotNull())).join(plans.select("query_id", "norm", "terms", "scoped_rules", "product_type", "colors", "finishes", "tags", "max_price"), "query_id").filter(
        filters_hold()).withColumn("penalty", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x))


def ranked(found: DataFrame, n: int | None = None) -> DataFrame:
    """Results in retrieval order: penalty, title hits, exact title, popularity, id; the first ``n`` of each query if given."""
    hits, other = F.size(F.array_intersect("terms", "p.words")), c("p.title") != c("norm")
    slim = found.select("query_id", "product_id", "penalty", (-hits).alias("_h"), other.alias("_o"), c("p.popularity").alias("_p"))
    order = ["penalty", "_h", "_o", c("_p").desc(), "product_id"]
    if n:
        top = slim.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(c("rank") <= n)
        return top.select("query_id", "product_id", "penalty", "rank")
    # Products without popularity are in id order, so their bucket may follow the id.
    coarse = F.struct("penalty", "_h", "_o", -F.floor(F.log2(F.greatest("_p", F.lit(0.0)) + 1) * 4),
                      F.when(c("_p") == 0, F.left(c("product_id").cast("string"), F.lit(2))).otherwise(""))
    out = global_rank(cut(slim), order, coarse, ("query_id",))
    return out.select("query_id", "product_id", "penalty", (c("rn") + 1).cast("int").alias("rank"))


def term_rows(plans: DataFrame) -> DataFrame:
    """(query_id, no, term) of all plan terms."""
    return plans.select("query_id", F.posexplode("terms").alias("no", "term"))


def _links(rules: list[dict]) -> Column:
    """The linked phrases {id, term, mode, product_ids} of the profile as an array of structs; ``open`` ones also admit products that hold the phrase."""
    return F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["mode"] != "only").alias("open"), F.lit(r["term"]).alias("term"),
                              F.array(*[F.lit(str(x)) for x in r["product_ids"]]).cast("array<string>").alias("ids")) for r in rules])


def phrases_hold(rules: list[dict]) -> Column:
    """Whether a product joined to a plan satisfies every linked phrase of the query: it is linked, or (unless mode is only) its text holds the phrase."""
    if not rules:
        return F.lit(True)
    text = F.concat(F.lit(" "), "p.text", F.lit(" "))
    return F.forall(F.filter(_links(rules), lambda r: F.array_contains("scoped_rules", r["id"])), lambda r: F.array_contains(r["ids"], c("product_id")) | (
        r["open"] & F.contains(text, F.concat(F.lit(" "), r["term"], F.lit(" ")))))


def _phrase_only(plans: DataFrame, postings: DataFrame, cards: DataFrame, rules: list[dict]) -> DataFrame:
    """Products of queries that are linked phrases and nothing else but filters.

    The query's first phrase drives it: its linked products and, if it is open, the postings of its longest word.
    Title hits count the phrases, as there are no terms.
    """
    mine = plans.withColumn("_r", F.filter(_links(rules), lambda r: F.array_contains("scoped_rules", r["id"]))).withColumn("_d", F.try_element_at("_r", F.lit(1)))
    mine = mine.withColumn("terms", F.transform("_r", lambda r: r["term"]))
    words = F.array_sort(F.split("_d.term", " "), lambda x, y: F.length(y) - F.length(x))
    linked = mine.select("query_id", F.explode("_d.ids").alias("product_id"))
    holding = mine.filter("_d.open").select("query_id", words[0].alias("term")).join(large(postings), "term").select("query_id", "product_id")
    pairs = linked.unionByName(holding).distinct()
    return pairs.join(mine.drop("_r", "_d"), "query_id").join(large(cards), "product_id").filter(filters_hold() & phrases_hold(rules)).withColumn("penalty", F.lit(0.0))


def retrieve(plans: DataFrame, postings: DataFrame, cards: DataFrame, identifiers: DataFrame, n: int | None = None, rules: list[dict] | None = None) -> DataFrame:
    """SCH-06: ranked results of every query; an identifier overrides terms, phrases and filters.

    Terms are a conjunction over their readings, at summed cost. Linked phrases (``rules``, the profile's
    ``scoped``) narrow the results, and drive queries without terms; other queries without terms are driven by
    their filters.
    """
    rules = rules or []
    by_id = identifier_hits(plans, identifiers).join(large(cards), "product_id").filter(sellable_struct()).join(
        plans.select("query_id", "norm", "terms"), "query_id").withColumn("penalty", F.lit(0.0))
    rest = plans.join(identifier_hits(plans, identifiers).select("query_id").distinct(), "query_id", "left_anti")
    wants = term_rows(rest)
    # Query- and term-grained, read several times below.
    resolved = cut(resolve_terms(wants, vocabulary(postings)))
    found = _costed(wants, resolved, postings, cards, rest).filter(phrases_hold(rules))
    bare = rest.filter((F.size("terms") == 0) & (c("norm") != ""))
    phrased = F.size(F.array_intersect("scoped_rules", F.array(*[F.lit(r["id"]) for r in rules]).cast("array<string>"))) > 0
    key = F.coalesce(F.concat(F.lit("p:"), "product_type"), F.concat(F.lit("c:"), F.try_element_at("colors", F.lit(1))),
                     F.concat(F.lit("g:"), F.try_element_at("tags", F.lit(1))), F.concat(F.lit("f:"), F.try_element_at("finishes", F.lit(1))), F.lit("any"))
    only = bare.filter(~phrased).withColumn("key", key).join(large(_anchors(cards, "words")), "key").join(large(cards), "product_id").filter(filters_hold()).withColumn("penalty", F.lit(0.0))
    cols = ["query_id", "product_id", "penalty", "terms", "norm", "p"]
    every = by_id.select(*cols).unionByName(found.select(*cols)).unionByName(only.select(*cols))
    if rules:
        every = every.unionByName(_phrase_only(bare.filter(phrased), postings, cards, rules).select(*cols))
    return ranked(every, n)


def matched_variants(plans: DataFrame, products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """SCH-06, variant part: (query_id, product_id, variant) where the query is an id, sku, mpn or gtin of a product's variant, the first such variant."""
    have = products.schema["variants"].dataType.elementType.fieldNames()
    rows = products.select(c("id").alias("product_id"), F.posexplode("variants").alias("pos", "variant"))
    keys = rows.select("*", F.explode(F.array_compact(F.array(*[c(f"variant.{x}").cast("string") for x in ("id", "sku", "mpn", "gtin") if x in have]))).alias("_k"))
    keyed = keys.withColumn("norm", search_normalize(c("_k"), ascii_only)).filter("norm <> ''")
    return plans.select("query_id", "norm").join(keyed, "norm").groupBy("query_id", "product_id").agg(F.min_by("variant", "pos").alias("variant"))


def _not_identifiers(plans: DataFrame, identifiers: DataFrame | None) -> DataFrame:
    """Plans whose query is no identifier; those are neither relaxed nor explained."""
    return plans if identifiers is None else plans.join(identifier_hits(plans, identifiers).select("query_id").distinct(), "query_id", "left_anti")


def relax_one_term(plans: DataFrame, results: DataFrame, postings: DataFrame, cards: DataFrame, identifiers: DataFrame | None = None,
                   rules: list[dict] | None = None) -> DataFrame:
    """SCH-07: for empty queries of several existing terms, the results with one term approximated.

    The term needing the fewest edits wins, then the one with most results, then the first. With ``identifiers``
    queries that are one stay empty; ``rules`` are the linked phrases, which results have to satisfy here too.
    """
    empty = cut(_not_identifiers(plans, identifiers).filter(F.size("terms") > 1).join(results.select("query_id").distinct(), "query_id", "left_anti"))
    wants = term_rows(empty)
    vocab = cut(vocabulary(postings))
    plain = cut(resolve_terms(wants, vocab))
    exact = plain.filter("how = 'exact'").select("term").distinct()
    loose = cut(resolve_terms(wants.join(exact, "term", "left_semi"), vocab, relax=True))
    has_more = loose.filter("how in ('prefix', 'fuzzy')").groupBy("term").agg(F.coalesce(F.min("edits"), F.lit(0)).alias("edits"))
    picks = wants.join(has_more, "term").select("query_id", c("no").alias("slot"), "edits")
    every = wants.join(picks, "query_id").select(
        F.concat_ws("#", "query_id", "slot").alias("query_id"), "no", "term", (c("no") == c("slot")).alias("_relaxed"))
    both = plain.withColumn("_relaxed", F.lit(False)).unionByName(loose.withColumn("_relaxed", F.lit(True)))
    readings = cut(every.join(both, ["term", "_relaxed"]).select("query_id", "no", "term", "target", "cost"))
    trial = cut(picks.join(empty, "query_id").withColumn("query_id", F.concat_ws("#", "query_id", "slot")))
    found = _costed(every.select("query_id", "no", "term"), readings, postings, cards, trial).filter(phrases_hold(rules or []))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    split = F.split("query_id", "#")
    best = counts.join(trial.select("query_id", "slot", "edits"), "query_id").withColumn("root", split[0]).groupBy("root").agg(
        F.min_by("query_id", F.struct("edits", -c("n"), "slot")).alias("query_id"))
    chosen = ranked(found.join(best.select("query_id"), "query_id", "left_semi"))
    return chosen.withColumn("relaxed_term", F.split("query_id", "#")[1].cast("int")).withColumn("query_id", F.split("query_id", "#")[0])


def explain_empty(plans: DataFrame, results: DataFrame, postings: DataFrame, resolved: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """SCH-08: why a query found nothing: scoped-only, missing-terms, no-intersection or filtered, with the terms.

    With ``identifiers`` queries that are one are not explained.
    """
    empty = _not_identifiers(plans, identifiers).filter("norm <> ''").join(results.select("query_id").distinct(), "query_id", "left_anti")
    vocab = vocabulary(postings)
    hit = resolved.select("term").distinct().withColumn("_any", F.lit(1))
    rows = empty.select("query_id", "scoped_rules", F.size("terms").alias("_n"), F.posexplode_outer("terms").alias("no", "term")).join(
        large(vocab), "term", "left").join(large(hit), "term", "left")
    per = rows.groupBy("query_id", "scoped_rules", "_n").agg(
        F.count_if(c("term").isNotNull() & c("_any").isNull()).alias("missing"), F.count("df").alias("present"),
        F.array_join(F.array_sort(F.collect_list(F.when(c("_any").isNull(), c("term")))), ",").alias("missing_terms"))
    why = F.when((c("_n") == 0) & (F.size("scoped_rules") > 0), "scoped-only").when(c("missing") > 0, "missing-terms").when(
        (c("_n") > 1) & (c("present") == c("_n")), "no-intersection").otherwise("filtered")
    return per.select("query_id", why.alias("why"), "missing_terms")


def scoped_alias_filter(results: DataFrame, plans: DataFrame, cards: DataFrame, rules: list[dict]) -> DataFrame:
    """SCH-09: results that satisfy every linked phrase of their query: linked products, or (mode add) the phrase in the text."""
    j = results.join(plans.select("query_id", "scoped_rules"), "query_id").join(large(cards), "product_id")
    return j.filter(phrases_hold(rules)).select(*results.columns)


def intersect_scoped_ids(plans: DataFrame, rules: list[dict]) -> DataFrame:
    """SET-07: (query_id, product_id) linked by all phrases found in the query."""
    links = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.array(*[F.lit(x) for x in r["product_ids"]]).alias("ids")) for r in rules])
    mine = F.transform(F.filter(links, lambda r: F.array_contains("scoped_rules", r["id"])), lambda r: r["ids"])
    both = F.aggregate(F.slice(mine, 2, len(rules)), F.element_at(mine, 1), lambda a, x: F.array_intersect(a, x))
    return plans.filter(F.size("scoped_rules") > 0).select("query_id", F.explode(both).alias("product_id"))


# ---- spelling repair -----------------------------------------------------------------------------------------

def title_phrases(products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(compact, label, product_id): one- to three-word title phrases of 6 to 24 letters without digits."""
    words = F.filter(F.split(F.regexp_replace(search_normalize(c("title"), ascii_only), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    titled = products.filter(sellable()).select(c("id").alias("product_id"), words.alias("ws")).filter(F.size("ws") > 0)
    runs = F.flatten(F.transform("ws", lambda w, i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), F.size("ws") - i)), lambda n: F.slice("ws", i + 1, n))))
    rows = titled.select("product_id", F.explode(runs).alias("run")).select(
        "product_id", F.array_join("run", "").alias("compact"), F.array_join("run", " ").alias("label"))
    return rows.filter(F.length("compact").between(6, 24) & ~c("compact").rlike("\\d")).distinct()


def repair_spelling(plans: DataFrame, products: DataFrame, ascii_only: bool = False, cards: DataFrame | None = None) -> DataFrame:
    """SCH-10: (query_id, compact, edits, product_id): the title phrase a misspelt query means.

    One edit, two from ten letters. Equally close but dissimilar phrases are
    ambiguous and repair nothing; phrases within one edit of the best are united.
    With ``cards`` the products also satisfy the plan's own filters.
    """
    phrases = title_phrases(products, ascii_only)
    vocab = phrases.select(c("compact").alias("term")).distinct()
    ws = F.filter(F.split(F.regexp_replace(F.array_join("terms", " "), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    asked = plans.withColumn("_w", ws).filter(F.size("_w").between(1, 3)).select("query_id", F.array_join("_w", "").alias("term")).filter(
        F.length("term").between(6, 24) & ~c("term").rlike("\\d"))
    near = close_terms(asked, vocab, F.when(F.length("term") >= 10, 2).otherwise(1))
    same = asked.select("term").distinct().join(vocab, "term", "left_semi").select("term", c("term").alias("target"), F.lit(0).alias("edits"))
    cand = near.unionByName(same)
    best = cand.groupBy("term").agg(F.min(F.struct("edits", "target")).alias("b")).select("term", c("b.edits").alias("best_edits"), c("b.target").alias("best"))
    apart = F.levenshtein(c("target"), c("best"))
    j = cand.join(best, "term").withColumn("_apart", apart)
    clear = j.groupBy("term").agg(F.max(F.when(c("edits") == c("best_edits"), c("_apart"))).alias("m")).filter("m <= 1").select("term")
    meant = j.filter("_apart <= 1").join(clear, "term", "left_semi").select("term", "best", "best_edits", c("target").alias("compact"))
    hits = meant.join(large(phrases.select("compact", "product_id").distinct()), "compact")
    out = asked.join(hits, "term").select("query_id", c("best").alias("compact"), c("best_edits").alias("edits"), "product_id").distinct()
    if cards is None:
        return out
    wants = plans.select("query_id", "product_type", "colors", "finishes", "tags", "max_price")
    return out.join(wants, "query_id").join(large(cards), "product_id").filter(filters_hold()).select(*out.columns)


# ---- prefixes, scores, vectors -------------------------------------------------------------------------------

def autocomplete(prefixes: DataFrame, products: DataFrame, n: int = 8, ascii_only: bool = False, key_length: int = 8) -> DataFrame:
    """SCH-11: per prefix (two letters or more) the first ``n`` products by id whose title or a title word starts with it.

    Products are keyed by prefixes of up to ``key_length`` letters; longer prefixes are verified after the join.
    """
    title = search_normalize(c("title"), ascii_only)
    starts = F.array_distinct(F.concat(F.array(title), tokens(title)))
    cut = F.flatten(F.transform(starts, lambda s: F.when(F.length(s) >= 2, F.transform(
        F.sequence(F.lit(2), F.least(F.lit(key_length), F.length(s))), lambda i: F.struct(F.substring(s, F.lit(1), i).alias("key"), s.alias("s")))).otherwise(
        F.array().cast("array<struct<key:string,s:string>>"))))
    keys = products.filter(sellable()).select(c("id").alias("product_id"), F.inline(cut))
    asked = prefixes.select("prefix").distinct().filter(F.length("prefix") >= 2).withColumn("key", F.left("prefix", F.lit(key_length)))
    hits = asked.join(large(keys), "key").filter(F.startswith("s", "prefix")).select("prefix", "product_id").distinct()
    w = Window.partitionBy("prefix").orderBy("product_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n)


def lexical_score(products: DataFrame, requests: DataFrame, n: int | None = None, ascii_only: bool = False) -> DataFrame:
    """SCH-12: (query, product_id, score > 0): 4 per shared tag, 4 per shared category, 3 per term contained in the text.

    ``requests`` is (query, tags, categories, terms), one row per query; null lists are empty, blank terms hold nowhere.
    Tags, categories and terms are features that requests and products meet on, so only products with a hit make rows.
    With ``n`` the best rows of a query, ties by id.
    """
    text = search_normalize(F.concat_ws(" ", "title", "description", F.array_join(F.map_values("specifications"), " ")), ascii_only)
    p = products.filter(sellable()).select(c("id").alias("product_id"), "tags", "categories", text.alias("text"))
    keyed = lambda kind, keys, w: F.transform(F.coalesce(keys, EMPTY()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"), F.lit(w).alias("w")))
    want = requests.select("query", F.explode(F.concat(keyed("tag", F.array_distinct("tags"), 4), keyed("category", F.array_distinct("categories"), 4), keyed("term", c("terms"), 3))).alias("f"))
    want = want.select("query", "f.*").groupBy("query", "kind", "key").agg(F.sum("w").alias("w"))
    held = contained(want.filter("kind = 'term'").select(c("key").alias("asked")), p.select("product_id", "text")).select(
        F.lit("term").alias("kind"), c("asked").alias("key"), "product_id")
    for kind, column in (("tag", "tags"), ("category", "categories")):
        held = held.unionByName(p.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(column)).alias("key"), "product_id"))
    rows = want.join(large(held), ["kind", "key"]).groupBy("query", "product_id").agg(F.sum("w").cast("int").alias("score"))
    if n is None:
        return rows
    w = Window.partitionBy("query").orderBy(c("score").desc(), "product_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n)


BLOCK_PRODUCTS = 1 << 16


def score_postings(products: DataFrame, ascii_only: bool = False, block_products: int = BLOCK_PRODUCTS) -> DataFrame:
    """SCH-13, index: (term, product_id, block, weight) of sellable products, as a table in the shared folder.

    A word weighs 4 in the title, 1 in the rest, 5 in both; the empty term stands for the product itself. Blocks are
    ranges of ids of about ``block_products`` products.
    """
    title = search_normalize(c("title"), ascii_only)
    rest = search_normalize(F.concat_ws(" ", "description", F.array_join("categories", " "), F.array_join(F.map_values("specifications"), " ")), ascii_only)
    p = products.filter(sellable()).select(c("id").alias("product_id"), F.split(title, " ").alias("_t"), F.split(rest, " ").alias("_r"))
    blocks = max(1, -(-p.count() // block_products))
    placed = p.repartitionByRange(blocks, "product_id").withColumn("block", F.spark_partition_id())
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce("_t", EMPTY()), F.coalesce("_r", EMPTY())))
    has = lambda col, w: F.coalesce(F.array_contains(c(col), w), F.lit(False)).cast("int")
    return written(placed.select("product_id", "block", F.inline(F.transform(words, lambda w: F.struct(
        w.alias("term"), (has("_t", w) * 4 + has("_r", w)).alias("weight"))))))


def closest_score(products: DataFrame | None, queries: DataFrame, n: int = 100, ascii_only: bool = False, postings: DataFrame | None = None) -> DataFrame:
    """SCH-13: the ``n`` closest products per query (column query): 4 per term in the title, 1 per term in the rest.

    Ties go to the smaller id; a query with fewer hits is filled up with the first products, at score 0. ``postings``
    is a stored index (``score_postings``). A block's best weights of a query's terms bound the scores inside it: each
    query reads the block of the highest bound (ties: the first) and then only blocks that can still reach its n-th row.
    """
    posts = score_postings(products, ascii_only) if postings is None else postings
    asked = queries.select("query").distinct()
    terms = asked.select("query", F.explode(F.filter(F.split("query", "\\s+"), lambda t: t != "")).alias("asked")).groupBy("query", "asked").agg(F.count("*").alias("k"))
    # title and rest are told apart, as different words may hold a term in each
    holds = words_holding(terms, posts.select("term")).join(large(posts), "term").groupBy("asked", "block", "product_id").agg(
        (F.max((c("weight") >= 4).cast("int")) * 4 + F.max(c("weight") % 4)).alias("weight"))
    holds = written(holds)
    first_ids = posts.filter("term = ''").groupBy("block").agg(F.min("product_id").alias("first_id"))
    most = holds.groupBy("asked", "block").agg(F.max("weight").alias("weight"))
    bounds = written(terms.join(most, "asked").groupBy("query", "block").agg(F.sum(c("k") * c("weight")).alias("bound")).join(first_ids, "block"))
    order = Window.partitionBy("query").orderBy(c("score").desc(), "product_id")

    def best(blocks: DataFrame) -> DataFrame:
        rows = blocks.select("query", "block").join(terms, "query").join(holds, ["asked", "block"]).groupBy("query", "product_id").agg(F.sum(c("k") * c("weight")).alias("score"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= n)

    leading = bounds.groupBy("query").agg(F.min_by("block", F.struct(-c("bound"), c("block"))).alias("block"))
    floor = best(leading).filter(c("rank") == n).select("query", c("score").alias("_s"), c("product_id").alias("_id"))
    able = bounds.join(floor, "query", "left").filter(c("_s").isNull() | (c("bound") > c("_s")) | ((c("bound") == c("_s")) & (c("first_id") <= c("_id"))))
    heads = posts.filter("term = ''").select("product_id").distinct().orderBy("product_id").limit(n)
    fill = asked.withColumn("product_id", F.explode(heads.agg(F.collect_list("product_id")).scalar())).withColumn("score", F.lit(0).cast("bigint"))
    rows = best(able).drop("rank").unionByName(fill).groupBy("query", "product_id").agg(F.max("score").cast("int").alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= n)


QUERY_BLOCK, VECTOR_BLOCK = 1024, 1024


def _blocks(df: DataFrame, number: str | None = None) -> DataFrame:
    """Vectors (id, vector) as rows of (ids, unit, width): up to a block of unit vectors in one matrix, in order of id.

    With ``number`` a block is the rows of one value of that column; otherwise blocks are cut where the rows
    are, without a shuffle. A null vector is a zero one; vectors of a block must have equally many components.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema["id"].dataType)

    def pack(t) -> pa.RecordBatch:
        t = t.sort_by("id")
        raw = t.column("vector").to_pylist()
        width = len(next((v for v in raw if v is not None), ()))
        x = np.array([v if v is not None else [0.0] * width for v in raw], dtype=np.float64).reshape(len(raw), width)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return pa.RecordBatch.from_arrays([pa.array([t.column("id").to_pylist()], pa.list_(kind)), pa.array([unit.tobytes()]), pa.array([width], pa.int32())], names=["ids", "unit", "width"])

    schema = f"ids array<{df.schema['id'].dataType.simpleString()}>, unit binary, width int"
    if number:
        def one(key, t):
            block = pack(t.select(["id", "vector"]))
            return pa.Table.from_batches([block]).append_column(number, pa.array([key[0].as_py()], pa.int64()))

        return df.groupBy(number).applyInArrow(one, f"{schema}, {number} bigint")

    def cut_up(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, VECTOR_BLOCK):
                yield pack(pa.Table.from_batches([batch.slice(i, VECTOR_BLOCK)]))

    return df.mapInArrow(cut_up, schema)


def vector_rank(queries: DataFrame, vectors: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """SCH-14: the ``k`` nearest vectors per query by cosine, ties by id: (query_id, product_id, score, rank).

    ``queries`` is (query_id, vector), equal rows counting once, ``vectors`` (product_id, vector); a null vector
    scores 0. Queries are dealt over blocks by a hash, vectors packed into blocks where they lie.
    Blocks meet in a join on the query block's number: few query blocks are broadcast by their size,
    many are shuffled. A pair of blocks is one matrix product that keeps ``k`` rows a query.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    q = queries.select(c("query_id").alias("id"), "vector").distinct()
    count = q.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("bigint").alias("n"))
    asked = _blocks(q.withColumn("block", F.pmod(F.xxhash64("id", "vector"), count.scalar())), "block")
    asked = asked.select("block", c("ids").alias("query_ids"), c("unit").alias("query_unit"), c("width").alias("query_width"))
    packed = _blocks(vectors.select(c("product_id").alias("id"), "vector"))
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), count.scalar() - 1))).join(asked, "block").drop("block")
    qt, pt = queries.schema["query_id"].dataType, vectors.schema["product_id"].dataType
    names, kinds = ["query_id", "product_id", "score"], [to_arrow_type(qt), to_arrow_type(pt), pa.float64()]

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, unit, width, qids, qunit, qwidth = (batch.column(i)[r].as_py() for i in range(6))
                s = np.zeros((len(ids), len(qids)))
                if width and qwidth:
                    s = np.round(np.frombuffer(unit).reshape(len(ids), width) @ np.frombuffer(qunit).reshape(len(qids), qwidth).T, decimals)
                top = np.argsort(-s, axis=0, kind="stable")[:k]
                at = np.broadcast_to(np.arange(len(qids)), top.shape)
                columns = ([qids[i] for i in at.ravel().tolist()], [ids[i] for i in top.ravel().tolist()], s[top.ravel(), at.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, kinds)], names=names)

    partial = pairs.select("ids", "unit", "width", "query_ids", "query_unit", "query_width").mapInArrow(
        best, f"query_id {qt.simpleString()}, product_id {pt.simpleString()}, score double")
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), "product_id")
    return partial.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def zero_based_rank(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """WIN-07: zero-based position in each candidate list."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def rank_fusion(lists: list[DataFrame], cut: int = 100, k: int = 60) -> DataFrame:
    """SCH-15: reciprocal rank fusion of (query_id, product_id, pos) lists, each cut at ``cut``."""
    every = None
    for df in lists:
        part = df.filter(c("pos") < cut).select("query_id", "product_id", (F.lit(1.0) / (c("pos") + k)).alias("w"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "product_id").agg(F.round(F.sum("w"), 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), "product_id")
    return fused.withColumn("rank", F.row_number().over(w))


def stock_last(results: DataFrame) -> DataFrame:
    """SRT-08: out-of-stock results after all in-stock ones, order kept inside (rows carry stock_status and rank)."""
    out = c("stock_status") != "instock"
    new = global_rank(results, [c("rank")], F.struct(out, rank_bucket(c("rank"))), ("query_id",))
    return new.withColumn("rank", (c("rn") + 1).cast("int")).drop("rn")


def exact_then_extra(exact: DataFrame, extra: DataFrame) -> DataFrame:
    """SET-03: exact results, then the additional ones not among them."""
    keys = ["query_id", "product_id"]
    more = extra.join(exact.select(*keys), keys, "left_anti").select(*keys, "rank", F.lit(1).alias("part"))
    both = exact.select(*keys, "rank", F.lit(0).alias("part")).unionByName(more)
    new = global_rank(both, [c("rank")], F.struct(c("part"), rank_bucket(c("rank"))), ("query_id",))
    return new.withColumn("rank", (c("rn") + 1).cast("int")).drop("rn")


def merge_vectors(store: DataFrame, new: DataFrame, model: str, dimensions: int) -> DataFrame:
    """SCH-19: vector store after new entries; old ones stay only with the same model and size, new ones win.

    Rows are (id, text_hash, model, vector).
    """
    keep = store.filter((c("model") == model) & (F.size("vector") == dimensions)).join(new.select("id"), "id", "left_anti")
    return keep.unionByName(new)


def stale_vectors(products: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """SCH-19, work list: products (id, text_hash) without a stored vector of their text and model."""
    return products.join(store.filter(c("model") == model).select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def concept_terms(products: DataFrame, n: int = 150, latin: int = 100, ascii_only: bool = False) -> DataFrame:
    """SCH-24: the commonest title words (three letters, no digit) and the commonest plain Latin ones."""
    words = products.filter(~c("hidden")).select(F.explode(F.array_distinct(tokens(search_normalize(c("title"), ascii_only)))).alias("term")).filter(
        (F.length("term") >= 3) & ~c("term").rlike("\\d")).groupBy("term").agg(F.count("*").alias("df"))
    order = [c("df").desc(), c("term")]
    top = words.orderBy(*order).limit(n)
    plain = words.filter(c("term").rlike("^[a-z]+$")).orderBy(*order).limit(latin)
    return top.unionByName(plain).distinct()


def query_variants(queries: DataFrame) -> DataFrame:
    """SCH-25: typo, keyboard-layout and article variants of Hebrew root queries, one row per new query key.

    ``queries`` is (q, kind); returns (q, kind, of).
    """
    roots = queries.filter(c("kind").isin("head", "product", "brand") & c("q").rlike("[\\u05d0-\\u05ea]"))
    made = roots.select(c("q").alias("of"), F.inline(F.array(
        F.struct(F.lit(1).alias("o"), F.lit("typo").alias("kind"), swap_typo(c("q")).alias("q")),
        F.struct(F.lit(2).alias("o"), F.lit("layout").alias("kind"), keyboard_layout(c("q")).alias("q")),
        F.struct(F.lit(3).alias("o"), F.lit("prefix").alias("kind"), article_prefixed(c("q")).alias("q"))))).filter("q is not null")
    every = queries.select("q", "kind", F.lit(None).cast("string").alias("of"), F.lit(0).alias("o")).unionByName(made.select("q", "kind", "of", "o"))
    from storelens.functions.text import audit_normalize
    return every.withColumn("_k", audit_normalize(c("q"))).filter("_k <> ''").groupBy("_k").agg(
        F.min_by(F.struct("q", "kind", "of"), F.struct("o", "of", "q")).alias("r")).select("r.*")


def probe_queries(products: DataFrame, n: int = 6, lo: int = 8, hi: int = 400) -> DataFrame:
    """SRT-06: likely full-page queries: three frequent word pairs, then frequent words (lo to hi occurrences)."""
    ws = F.filter(F.split(F.lower("title"), "[^\\p{L}\\p{N}'\"׳״-]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS) & ~x.rlike("^\\d+$"))
    w = products.select(ws.alias("w"))
    words = w.select(F.lit(1).alias("part"), F.explode(F.array_distinct("w")).alias("q"))
    pairs = w.filter(F.size("w") > 1).select(F.lit(0).alias("part"), F.explode(F.zip_with(
        F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))).alias("q"))
    counts = pairs.unionByName(words).groupBy("part", "q").agg(F.count("*").alias("n")).filter(c("n").between(lo, hi))
    order = Window.partitionBy("part").orderBy(c("n").desc(), "q")
    top = counts.withColumn("rn", F.row_number().over(order)).filter(((c("part") == 0) & (c("rn") <= 3)) | ((c("part") == 1) & (c("rn") <= n)))
    return top.orderBy("part", "rn").limit(n).select("q", "n")
