"""Ranking rules, layouts and example checks (SCH-16..18, 20..23, 26..28, CLS-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions.text import search_normalize, word_matches, words
from storelens.operators.catalog import any_of, field_text, shown
from storelens.operators.ranks import global_rank, rank_bucket
from storelens.session import large

c = F.col
# Fields whose values are labels and match exactly.
LABELS = ("categories", "tags", "product_type")


def _values(df: DataFrame, field: str, ascii_only: bool) -> Column:
    """Normalised values of a ranking field as an array."""
    array = field in df.columns and df.schema[field].dataType.typeName() == "array"
    raw = c(field) if array else F.array_compact(F.array(field_text(df, field)))
    if ascii_only:
        return F.filter(F.transform(raw, lambda v: search_normalize(v, True)), lambda v: v != "")
    # The Unicode step works on columns, so the values travel joined by a separator it keeps.
    return F.filter(F.split(search_normalize(F.array_join(raw, " ␟ ")), " ?␟ ?"), lambda v: v != "")


def in_target(df: DataFrame, rule: dict, ascii_only: bool = False) -> Column:
    """Whether a product belongs to a rule's group; labels match exactly, free text by containment."""
    have = _values(df, rule["field"], ascii_only)
    exact = rule["field"] in LABELS
    return any_of([F.exists(have, lambda h: (h == v) if exact else ((h == v) | h.contains(v))) for v in rule["values"]])


def rule_applies(query_words: Column, rule: dict) -> Column:
    """Whether a query holds all words of one of the rule's phrases; no phrase means every query."""
    if not rule.get("terms"):
        return F.lit(True)
    every = lambda t: [word_matches(F.lit(w), query_words) for w in t.split()]
    out = F.lit(False)
    for t in rule["terms"]:
        hit = F.lit(True)
        for m in every(t):
            hit = hit & m
        out = out | hit
    return out


def covers(query_words: Column, title_words: Column) -> Column:
    """The title names every query word."""
    return (F.size(query_words) > 0) & F.forall(query_words, lambda w: word_matches(w, title_words))


def apply_ranking_rules(results: DataFrame, products: DataFrame, rules: list[dict], ascii_only: bool = False) -> DataFrame:
    """SCH-16: results (query_id, query, product_id, rank) reordered by boost and bury rules, none added or removed.

    Order: title names every query word, rule score, title starts with a query word,
    original rank. Rules are configuration {id, action, field, values, terms, match, weight}
    of normalised phrases. A query no rule touched keeps its order.
    """
    p = products.withColumn("_tw", words(search_normalize(c("title"), ascii_only)))
    for i, r in enumerate(rules):
        p = p.withColumn(f"_in{i}", in_target(products, r, ascii_only))
    p = p.select(c("id").alias("product_id"), "_tw", *[f"_in{i}" for i in range(len(rules))])
    q = results.select("query_id", "query").distinct().withColumn(
        "_q", F.filter(words(search_normalize(c("query"), ascii_only)), lambda w: F.length(w) > 1))
    for i, r in enumerate(rules):
        q = q.withColumn(f"_on{i}", rule_applies(c("_q"), r))
    j = results.join(q.drop("query"), "query_id").join(large(p), "product_id").withColumn("_direct", covers(c("_q"), c("_tw")))
    score, touched = F.lit(0), F.lit(False)
    for i, r in enumerate(rules):
        hit = c(f"_on{i}") & c(f"_in{i}") & (F.lit(True) if r.get("match") == "any" else c("_direct"))
        score = score + F.when(hit, (-1 if r.get("action") == "bury" else 1) * r.get("weight", 1)).otherwise(0)
        touched = touched | hit
    first = F.try_element_at("_tw", F.lit(1))
    head = first.isNotNull() & F.exists("_q", lambda w: word_matches(w, F.array(first)))
    j = j.withColumn("score", score).withColumn("_touched", touched).withColumn("_head", (c("score") > 0) & head)
    any_rule = j.groupBy("query_id").agg(F.bool_or("_touched").alias("_any"))
    j = j.join(any_rule, "query_id")
    on = lambda x: F.when(c("_any"), -x).otherwise(F.lit(0))
    tier = F.struct(on(c("_direct").cast("int")), on(c("score")), on(c("_head").cast("int")), rank_bucket(c("rank")))
    out = global_rank(j, [c("rank")], tier, ("query_id",))
    return out.select("query_id", "product_id", "rank", "score", (c("rn") + 1).cast("int").alias("new_rank"))


def rule_target_counts(products: DataFrame, rules: list[dict], ascii_only: bool = False) -> DataFrame:
    """SCH-17: products in each rule's group."""
    ids = F.array_compact(F.array(*[F.when(in_target(products, r, ascii_only), F.lit(r["id"])) for r in rules]))
    return products.select(F.explode(ids).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("products"))


def apply_layout(results: DataFrame, pins: DataFrame, exclusions: DataFrame, demoted: DataFrame) -> DataFrame:
    """SCH-18: pinned products first in their order (added when missing), exclusions dropped, demoted ones last."""
    keys = ["query_id", "product_id"]
    pinned = pins.select(*keys, "position")
    d = demoted.select(*keys, F.lit(1).alias("_low"))
    j = results.select(*keys, "rank").join(pinned, keys, "full_outer").join(exclusions.select(*keys), keys, "left_anti").join(d, keys, "left")
    low = F.when(c("position").isNull(), F.coalesce("_low", F.lit(0))).otherwise(0)
    place = F.coalesce("position", "rank")
    out = global_rank(j, [place], F.struct(c("position").isNull(), low, rank_bucket(place)), ("query_id",))
    return out.select(*keys, (c("rn") + 1).cast("int").alias("new_rank"), c("position").isNotNull().alias("pinned"))


def evaluate_examples(examples: DataFrame, results: DataFrame, cards: DataFrame) -> DataFrame:
    """SCH-20: per example the wanted products missing or unavailable, the unwanted ones present, and whether it passes.

    Examples are (example_id, query, include_ids, exclude_ids); results (query, product_id).
    """
    got = results.select("query", "product_id").distinct().withColumn("_got", F.lit(True))
    ok = cards.select(c("id").alias("product_id"), shown().alias("_ok"))
    wants = examples.select("example_id", "query", F.explode("include_ids").alias("product_id"), F.lit(True).alias("want")).unionByName(
        examples.select("example_id", "query", F.explode("exclude_ids").alias("product_id"), F.lit(False).alias("want")))
    j = wants.join(got, ["query", "product_id"], "left").join(ok, "product_id", "left")
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    per = j.groupBy("example_id").agg(n(c("want") & c("_got").isNull(), "missing"), n(~c("want") & c("_got"), "unwanted"),
                                      n(c("want") & ~F.coalesce("_ok", F.lit(False)), "unavailable"))
    out = examples.select("example_id", "query").join(per, "example_id", "left").na.fill(0, ["missing", "unwanted", "unavailable"])
    return out.withColumn("passed", (c("missing") == 0) & (c("unwanted") == 0) & (c("unavailable") == 0))


def example_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """SCH-21: examples that passed before and fail now."""
    return after.filter(~c("passed")).join(before.filter("passed").select("example_id"), "example_id", "left_semi")


def targets_found(targets: DataFrame, results: DataFrame, k: int = 24) -> DataFrame:
    """SCH-22: chosen products found in the top ``k``, and all of them (one row)."""
    top = results.filter(c("rank") <= k).select("query", "product_id").distinct().withColumn("_hit", F.lit(True))
    return targets.join(top, ["query", "product_id"], "left").agg(F.count("_hit").alias("found"), F.count("*").alias("total"))


def failing_queries(evaluation: DataFrame, expected: list[str], n: int) -> DataFrame:
    """SCH-23: the expected queries, then lost, partial and production-failing ones by searches, ``n`` in all."""
    bad = evaluation.filter(c("status").isin("lost", "partial") | (c("production") == "fails")).select("query", F.lit(1).alias("part"), (-c("searches")).alias("o"))
    spark = evaluation.sparkSession
    first = spark.createDataFrame([(q, 0, i) for i, q in enumerate(expected)] or [("", 9, 0)], "query string, part int, o bigint").filter("part = 0")
    rows = first.unionByName(bad).groupBy("query").agg(F.min(F.struct("part", "o")).alias("k"))
    return rows.orderBy("k", "query").limit(n).select("query")


def proposal_gain(proposals: DataFrame, before: DataFrame, after: DataFrame, regressions: DataFrame) -> DataFrame:
    """SCH-26: proposals (proposal_id, example_id) kept: the example passes now, had more products missing, nothing regressed."""
    b = before.select("example_id", c("missing").alias("_b"))
    a = after.select("example_id", c("missing").alias("_a"), c("passed").alias("_p"))
    lost = regressions.agg((F.count("*") > 0).alias("x")).scalar()
    return proposals.join(b, "example_id").join(a, "example_id").withColumn("_lost", lost).select(
        "proposal_id", "example_id", (c("_p") & (c("_b") > c("_a"))).alias("improved"),
        (c("_p") & (c("_b") > c("_a")) & ~c("_lost")).alias("kept"))


def mine_examples(checks: DataFrame, cards: DataFrame, current: DataFrame, n: int = 20) -> DataFrame:
    """SCH-27: examples from past checks: shown catalog products to include, formerly shown and now absent ones to exclude.

    ``checks`` is (query_key, seq, side after/before, pos, product_id); ``current`` (query_key, product_id). The first
    check of a query counts; a check without included products makes no example.
    """
    first = checks.groupBy("query_key").agg(F.min("seq").alias("seq"))
    rows = checks.join(first, ["query_key", "seq"]).join(cards.select(c("id").alias("product_id")), "product_id", "left_semi")
    uniq = rows.groupBy("query_key", "side", "product_id").agg(F.min("pos").alias("pos"))
    inc, exc = uniq.filter("side = 'after'"), uniq.filter("side = 'before'")
    out = exc.join(inc.select("query_key", "product_id"), ["query_key", "product_id"], "left_anti").join(
        current.select("query_key", "product_id"), ["query_key", "product_id"], "left_anti")
    w = Window.partitionBy("query_key", "side").orderBy("pos", "product_id")
    top = inc.unionByName(out).withColumn("rn", F.row_number().over(w)).filter(c("rn") <= n)
    ids = lambda s: F.transform(F.sort_array(F.collect_list(F.when(c("side") == s, F.struct("rn", "product_id")))), lambda x: x["product_id"])
    return top.groupBy("query_key").agg(ids("after").alias("include_ids"), ids("before").alias("exclude_ids")).filter(F.size("include_ids") > 0)


def lost_queries(evaluation: DataFrame, limit: int = 12) -> DataFrame:
    """SCH-28: lost and partial queries by searches, then production failures up to the limit."""
    part = F.when(c("status").isin("lost", "partial"), 0).when(c("production") == "fails", 1)
    rows = evaluation.withColumn("part", part).filter("part is not null")
    return rows.orderBy("part", c("searches").desc(), "query").limit(limit).select(
        "query", F.when(c("part") == 0, "lost").otherwise("fails").alias("reason"), "searches", (c("targets") - c("found")).alias("missing"))


def concierge_trigger(results: DataFrame, out_of_stock: DataFrame) -> DataFrame:
    """CLS-07: no_results / out_of_stock / non_literal per query, null when nothing should open.

    ``results`` is (query, total, in_stock, literal); ``out_of_stock`` (query, hits).
    """
    j = results.join(out_of_stock, "query", "left")
    reason = F.when(c("total") == 0, F.when(F.coalesce("hits", F.lit(0)) > 0, "out_of_stock").otherwise("no_results")).when(
        c("in_stock") == 0, "out_of_stock").when(~c("literal"), "non_literal")
    return j.select("query", reason.alias("reason"))
