"""Checks of extracted statements against their source text (EVD-01..09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions.text import search_normalize
from storelens.operators.catalog import merge_maps
from storelens.session import large

c = F.col
# Fact fields that belong to commerce data, never to extracted facts.
COMMERCE = "(?i)price|stock|sale|discount|מחיר|מלאי|מבצע"
# Materials a request can name.
MATERIALS = ("זכוכית", "קרמיקה", "פורצלן", "פלסטיק", "עץ", "נירוסטה")


def quoted_field(field: Column) -> Column:
    """The product text a quote must come from, by field name."""
    specs = F.array_join(F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    values = {"name": F.array("name"), "description": F.array("description"), "specifications": F.array(specs),
              "categories": c("categories"), "tags": c("tags")}
    out = None
    for name, value in values.items():
        out = F.when(field == name, value) if out is None else out.when(field == name, value)
    return out


def holds(values: Column, quote: Column) -> Column:
    """Some value contains the (non-blank) quote literally."""
    return F.coalesce((F.trim(quote) != "") & F.exists(values, lambda v: F.contains(v, quote)), F.lit(False))


def validate_tag_decisions(pairs: DataFrame, decisions: DataFrame, products: DataFrame, conflicts: DataFrame) -> DataFrame:
    """EVD-01: one status per (tag, product): a verdict needs exactly one decision and a verbatim quote from its
    field; a quote touching a conflicting fact becomes a conflict.

    ``pairs`` (tag, id); ``decisions`` (tag, id, status, field, quote); ``conflicts`` (id, field, value).
    """
    one = decisions.groupBy("tag", "id").agg(F.count("*").alias("n"), F.min(F.struct("status", "field", "quote")).alias("d")).filter(
        "n = 1").select("tag", "id", "d.*")
    j = pairs.join(one, ["tag", "id"], "left").join(products.select("id", "name", "description", "categories", "tags", "specifications"), "id")
    verdict = c("status").isin("matched", "not_matched")
    valid = holds(quoted_field(c("field")), c("quote"))
    checked = j.withColumn("status", F.when(verdict & ~valid, "unknown").when(
        c("status").isin("matched", "not_matched", "unknown", "conflict"), c("status")).otherwise("unknown")).withColumn(
        "quote", F.when(verdict & ~valid, "").otherwise(F.coalesce("quote", F.lit(""))))
    matched = checked.filter("status = 'matched'").select("tag", "id", "quote")
    touched = matched.join(conflicts.select("id", c("field").alias("_f"), c("value").alias("_v")), "id").filter(
        F.contains("quote", "_f") | F.contains("quote", "_v")).select("tag", "id", F.lit(True).alias("_clash")).distinct()
    return checked.join(touched, ["tag", "id"], "left").select(
        "tag", "id", F.when(c("_clash"), "conflict").otherwise(c("status")).alias("status"), "field", "quote")


def _mark_conflicts(facts: DataFrame) -> DataFrame:
    """Facts of one field with different (normalised) values conflict with each other; sized by aggregates, not pairs."""
    lo = facts.groupBy("id", "_nf").agg(F.min("_nv").alias("_lo"), F.max("_nv").alias("_hi"))
    return facts.join(lo, ["id", "_nf"]).withColumn(
        "status", F.when((c("_lo") != c("_hi")) | c("_clash"), "conflict").otherwise("verified"))


def validate_facts(facts: DataFrame, products: DataFrame, ascii_only: bool = False) -> DataFrame:
    """EVD-02: facts (id, field, value, quote) whose value is in the quote and the quote in the product text; each
    verified or in conflict with a declared specification or another fact. Commerce fields are refused."""
    usable = facts.filter((F.trim("field") != "") & (F.trim("value") != "") & (F.trim("quote") != "") & F.contains("quote", "value")
                          & ~c("field").rlike(COMMERCE))
    j = usable.join(products.select("id", "name", "description", "specifications"), "id").filter(
        F.contains("name", "quote") | F.contains("description", "quote"))
    norm = lambda x: search_normalize(x, ascii_only)
    specs = products.select("id", F.explode("specifications").alias("_k", "_sv")).select(
        "id", norm(c("_k")).alias("_nf"), c("_k").alias("_key"), norm(c("_sv")).alias("_sn")).groupBy("id", "_nf").agg(
        F.min("_key").alias("_key"), F.min("_sn").alias("_sn"))
    k = j.withColumn("_nf", norm(c("field"))).withColumn("_nv", norm(c("value"))).join(specs, ["id", "_nf"], "left").withColumn(
        "_clash", F.coalesce(c("_sn") != c("_nv"), F.lit(False))).withColumn("field", F.coalesce("_key", "field"))
    return _mark_conflicts(k).select("id", "field", "value", "quote", "status")


def apply_facts(products: DataFrame, facts: DataFrame) -> DataFrame:
    """EVD-03: verified facts fill missing specifications only (facts per product are at most one per field)."""
    best = facts.filter("status = 'verified'").groupBy("id", "field").agg(F.min("value").alias("value"))
    new = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_f"))
    return products.join(new, "id", "left").withColumn("specifications", merge_maps(c("_f"), c("specifications"))).drop("_f")


def validate_external_facts(facts: DataFrame, sources: DataFrame, products: DataFrame, span: int = 2000) -> DataFrame:
    """EVD-04: facts (id, url, field, value, quote, identity_quote) from a source naming the product's exact model.

    The model stands on its own in the source and in the identity quote, the two
    quotes are at most ``span`` characters apart and the value is in the quote.
    """
    model = products.select("id", F.lower("model").alias("model")).filter("trim(model) <> ''")
    j = facts.filter(~c("field").rlike(COMMERCE) & (F.trim("quote") != "")).join(model, "id").join(sources.select("url", "text"), "url")
    safe = F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), c("model"), F.lit("\\E(?![\\p{L}\\p{N}])"))
    a, b = F.instr(c("text"), c("quote")), F.instr(c("text"), c("identity_quote"))
    ok = (F.rlike(F.lower("text"), safe) & F.rlike(F.lower("identity_quote"), safe) & (a > 0) & (b > 0)
          & (F.abs(a - b) <= span) & F.contains(F.lower("quote"), F.lower("value")))
    k = j.filter(ok).withColumn("_nf", F.lower("field")).withColumn("_nv", F.lower("value")).withColumn("_clash", F.lit(False))
    return _mark_conflicts(k).select("id", "url", "field", "value", "status")


def validate_selection(selected: DataFrame, candidates: DataFrame, n_requirements: Column, material_asked: Column | None = None) -> DataFrame:
    """EVD-05: selected products that are candidates, quote every requirement verbatim and contradict no material.

    ``selected`` is (query, id, requirement, field, quote); ``candidates`` (query, product columns).
    """
    rows = selected.join(candidates, ["query", "id"])
    good = holds(quoted_field(c("field")), c("quote")) & (c("requirement") >= 0) & (c("requirement") < n_requirements)
    if material_asked is not None:
        own = F.coalesce(F.try_element_at("specifications", F.lit("material")), F.lit(""))
        other = F.exists(F.array(*[F.lit(m) for m in MATERIALS]), lambda m: F.contains(own, m))
        good = good & ~F.coalesce(material_asked.isNotNull() & ~F.contains(own, material_asked) & other, F.lit(False))
    per = rows.groupBy("query", "id", n_requirements.alias("_n")).agg(F.bool_and(good).alias("ok"), F.count_distinct("requirement").alias("covered"))
    return per.filter(c("ok") & (c("covered") == c("_n"))).select("query", "id")


# A character of a word.
WORD = "[\\p{L}\\p{N}]"
# Lengths of the windows on which statements meet texts; the longest that fits a quote is used.
WINDOWS = (16, 12, 8, 4)
# Numbers that the asked windows of a length below the longest fall on; the texts' other windows leave before a shuffle.
SLOTS = 1 << 19


def quote_keys(quotes: DataFrame) -> DataFrame:
    """Distinct quotes (source, quote) with the window on which they meet texts, as hash ``_h`` and length ``_k``; null if there is none."""
    most = WINDOWS[0]
    cut = quotes.withColumn("_tail", F.regexp_extract("quote", f"(?s)[^\\p{{L}}\\p{{N}}]({WORD}.*)$", 1)).withColumn("_run", F.regexp_extract("quote", f"{WORD}{{{most}}}", 0))
    tail, size = c("_tail"), F.length("_tail")
    key = F.when(size >= most, window(most, F.left(tail, F.lit(most)))).when(c("_run") != "", window(0, c("_run")))
    long = F.when((size >= most) | (c("_run") != ""), most)
    for k in WINDOWS[1:]:
        key, long = key.when(size >= k, window(k, F.left(tail, F.lit(k)))), long.when(size >= k, k)
    return cut.select("source", "quote", key.alias("_h"), long.cast("bigint").alias("_k"))


def window(k: int, text: Column) -> Column:
    return F.xxhash64("source", F.lit(k), text)


def quote_hits(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, quote, _u) of the texts that hold a quote's window; ``_u`` is a hash of the url."""
    most = WINDOWS[0]
    starts = F.regexp_extract_all("text", F.lit(f"(?s)(?<!{WORD})(?=({WORD}.{{0,{most - 1}}}))"), 1)
    runs = F.transform(F.regexp_extract_all("text", F.lit(f"(?=({WORD}{{{most}}}))"), 1), lambda w: F.concat(F.lit(" "), w))
    words = sources.select("source", F.xxhash64("url").alias("_u"), F.explode(F.concat(starts, runs)).alias("_w"))
    inner = c("_w").startswith(" ")  # of a long run, not only from its start
    of = lambda k: F.when(F.length("_w") >= k, window(k, F.left("_w", F.lit(k))))
    hashes = [(most, F.when(inner, window(0, F.substring("_w", 2, most))).otherwise(of(most))), *[(k, F.when(~inner, of(k))) for k in WINDOWS[1:]]]
    shown = words.select("_u", F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("_k"), h.alias("_h")) for k, h in hashes]))).filter("_h is not null")
    # at most SLOTS numbers per length below the longest: a broadcast of bounded size, whatever the statements
    slot = F.when(c("_k") == most, -1).otherwise(c("_k") * SLOTS + F.pmod("_h", F.lit(SLOTS)))
    slots = keyed.select(slot.alias("_s")).unionByName(keyed.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("_s"))).distinct()
    shown = shown.withColumn("_s", slot).join(F.broadcast(slots), "_s", "left_semi").select("_u", "_h")
    asked = shown.join(large(keyed.select("_h").distinct()), "_h", "left_semi")
    return asked.join(large(keyed.select("source", "quote", "_h")), "_h").select("_u", "source", "quote").distinct()


def quoted_only(statements: DataFrame, sources: DataFrame) -> DataFrame:
    """EVD-06: statements (row_id, source, value, quote) whose quote is in their source and holds the value, with the first such url.

    ``sources`` is (source, url, text). A word that begins inside the quote begins a word of any text holding
    it, so distinct quotes meet texts on the characters from such a place on, or on the first characters of a
    long run of letters and digits; only quotes without either are compared with every text of their source.
    Windows meet as hashes; the texts themselves are joined to the hits by url and decide.
    """
    st = statements.filter((F.trim("quote") != "") & F.contains("quote", "value"))
    quotes = quote_keys(st.select("source", "quote").distinct())
    hits = quote_hits(quotes.filter("_h is not null"), sources)
    texts = sources.select("source", "url", "text", F.xxhash64("url").alias("_u"))
    found = large(hits).join(texts, ["_u", "source"]).filter(F.contains("text", "quote"))
    rest = quotes.filter("_h is null").select("source", "quote").join(sources, "source").filter(F.contains("text", "quote"))
    cols = ["source", "quote", "url"]
    first = found.select(*cols).unionByName(rest.select(*cols)).groupBy("source", "quote").agg(F.min("url").alias("url"))
    return st.select("row_id", "source", "quote").join(large(first), ["source", "quote"]).groupBy("row_id").agg(F.min("url").alias("url"))


def accept_matches(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """EVD-07: per tag the accepted ids, scanned products and failed batches; answers outside their batch do not count.

    ``batches`` (tag, batch, id, failed); ``answers`` (tag, batch, id).
    """
    hit = answers.select("tag", "batch", "id").distinct().withColumn("_hit", F.lit(True))
    rows = batches.join(hit, ["tag", "batch", "id"], "left")
    per = rows.groupBy("tag", "batch").agg(F.count("*").alias("n"), F.count_if(c("_hit") & ~c("failed")).alias("m"), F.max(c("failed").cast("int")).alias("f"))
    return per.groupBy("tag").agg(F.sum("n").alias("scanned"), F.sum("m").alias("matched"), F.sum("f").alias("failed_batches"))


def rewrite_guard(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """EVD-08: rewrites (query, rewrite) that keep the numbers in order and do not drop words; adds ``accepted``."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit("\\d+(?:\\.\\d+)?"), 0)
    words = lambda x: F.size(F.filter(F.split(search_normalize(x, ascii_only), " +"), lambda w: F.length(w) >= 3))
    shorter = (words(c("query")) > 1) & (words(c("rewrite")) < words(c("query")))
    return df.withColumn("accepted", (numbers(c("query")) == numbers(c("rewrite"))) & ~shorter)


def open_conflicts(facts: DataFrame) -> DataFrame:
    """EVD-09: facts in conflict per product."""
    return facts.filter("status = 'conflict'").groupBy("id").agg(F.count("*").alias("conflicts"), F.count_distinct("field").alias("fields"))
