"""Evidence checks and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import evidence as V, hooks as H
from storelens.plans import baseline_queries as BQ, demo as D
from storelens.plans.oracle import CTES, sql
from storelens.plans.registry import query

c = F.col
P = D.products
NUM = lambda: F.col("id").try_cast("int")


def doc_products(spark, sf):
    """documents as products: the text is the description, the language the category, the source a specification."""
    return D.table(spark, sf, "documents").select(
        c("doc_id").cast("string").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("name"), c("text").alias("description"),
        F.array("lang").alias("categories"), F.array("source").alias("tags"), F.create_map(F.lit("origin"), c("source")).alias("specifications"))


def at(start, size):
    """``size`` characters of the text, ``start`` after a place that the id spreads over the whole text (the SQL does the same)."""
    place = c("doc_id") * 7919 % F.greatest(F.length("text") - 60, F.lit(1))
    return F.substr(c("text"), (place + start).cast("int"), F.lit(size))


# One decision per labelled document: a quote from the text, corrupted for some; two decisions for others.
CTES["dec"] = ("""select '' || d.doc_id as id, 'good' as tag, case when quality = 1 then 'matched' else 'not_matched' end as status, case when toxic = 1 then 'tags' else 'description' end as field,
    case when d.doc_id % 5 = 0 then 'x§x' || substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 3, 20) when toxic = 1 then source else substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 11, 30) end as quote, d.text, d.source, d.doc_id % 7 = 0 as twice from documents d join labels l using (doc_id)""", ())


def decisions(spark, sf):
    j = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id")
    quote = F.when(c("doc_id") % 5 == 0, F.concat(F.lit("x§x"), at(3, 20))).when(c("toxic") == 1, c("source")).otherwise(at(11, 30))
    one = j.select(c("doc_id").cast("string").alias("id"), F.lit("good").alias("tag"), F.when(c("quality") == 1, "matched").otherwise("not_matched").alias("status"),
                   F.when(c("toxic") == 1, "tags").otherwise("description").alias("field"), quote.alias("quote"), "doc_id")
    return one.drop("doc_id").unionByName(one.filter("doc_id % 7 = 0").drop("doc_id"))


@query("evd_01_validate_tag_decisions", sql("""select '' || d.doc_id as id, 'good' as tag, case when x.id is null or twice then 'unknown' when not ok then 'unknown' when status = 'matched' and d.doc_id % 3 = 0 and contains(quote, 'the') then 'conflict' else status end as status
    from documents d left join (select *, trim(quote) <> '' and case when field = 'tags' then contains(source, quote) else contains(text, quote) end as ok from dec) x on x.id = '' || d.doc_id""", "dec"))
def validate_tag_decisions(spark, sf):
    p = doc_products(spark, sf)
    pairs = p.select("id", F.lit("good").alias("tag"))
    conflicts = p.filter(NUM() % 3 == 0).select("id", F.lit("zzzz").alias("field"), F.lit("the").alias("value"))
    return V.validate_tag_decisions(pairs, decisions(spark, sf), p, conflicts).select("id", "tag", "status")


def facts(spark, sf):
    n = c("doc_id")
    d = D.table(spark, sf, "documents")
    quote = at(1, 40)
    rows = F.array(
        F.struct(F.lit("opening").alias("field"), at(1, 10).alias("value"), F.when(n % 4 == 0, F.concat(F.lit("§"), quote)).otherwise(quote).alias("quote")),
        F.struct(F.lit("opening").alias("field"), F.when(n % 6 == 1, at(5, 10)).otherwise(at(1, 10)).alias("value"), quote.alias("quote")),
        F.struct(F.lit("price").alias("field"), at(1, 5).alias("value"), quote.alias("quote")),
        F.struct(F.lit("Origin").alias("field"), at(12, 8).alias("value"), at(10, 30).alias("quote")))
    return d.select(n.cast("string").alias("id"), F.inline(rows))


CTES["fact0"] = ("""select doc_id, text, source, unnest([1, 2, 4]) as k from documents""", ())
CTES["fact1"] = ("""select doc_id, text, source, k, case when k = 4 then 'origin' else 'opening' end as field, case when k = 4 then substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 12, 8) when k = 2 and doc_id % 6 = 1 then substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 5, 10) else substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 1, 10) end as value,
    case when k = 4 then substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 10, 30) when k = 1 and doc_id % 4 = 0 then '§' || substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 1, 40) else substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 1, 40) end as quote from fact0""", ("fact0",))
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(value)), '[®™׳״’''`\"“”„«»″‟]', '', 'g'), '[-–—()\\[\\],:;!?]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
CTES["fact2"] = (f"select *, {NORM} as nv from fact1 where trim(value) <> '' and trim(quote) <> '' and contains(quote, value) and (contains(text, quote) or contains('Doc ' || doc_id, quote))", ("fact1",))
CTES["fact"] = ("""select '' || doc_id as id, field, value, case when min(nv) over (partition by doc_id, field) <> max(nv) over (partition by doc_id, field) or (field = 'origin' and nv <> source) then 'conflict' else 'verified' end as status from fact2""", ("fact2",))


@query("evd_02_validate_facts", sql("select id, field, value, status from fact", "fact"))
def validate_facts(spark, sf):
    return V.validate_facts(facts(spark, sf), doc_products(spark, sf)).select("id", "field", "value", "status")


@query("evd_03_apply_facts", sql("select '' || doc_id as id, source as origin, (select min(value) from fact f where f.id = '' || doc_id and field = 'opening' and status = 'verified') as opening from documents", "fact"))
def apply_facts(spark, sf):
    p = doc_products(spark, sf)
    out = V.apply_facts(p, V.validate_facts(facts(spark, sf), p))
    get = lambda k: F.try_element_at("specifications", F.lit(k)).alias(k)
    return out.select("id", get("origin"), get("opening"))


@query("evd_09_open_conflicts", sql("select id, count(*) as conflicts, count(distinct field) as fields from fact where status = 'conflict' group by 1", "fact"))
def open_conflicts(spark, sf):
    return V.open_conflicts(V.validate_facts(facts(spark, sf), doc_products(spark, sf)))


@query("evd_04_validate_external_facts", """select id, url, 'tone' as field, value, 'verified' as status from (select '' || doc_id as id, 'https://s/' || doc_id as url, substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 60, 6) as value, case when doc_id % 2 = 0 then 'about MX-' || doc_id || ' here: ' else 'about MX-' || doc_id || '9 here: ' end || text as src, substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 55, 30) as quote from documents)
    where trim(quote) <> '' and contains(lower(quote), lower(value)) and id::bigint % 2 = 0 and instr(src, quote) > 0 and abs(instr(src, quote) - instr(src, 'MX-' || id)) <= 2000""")
def validate_external_facts(spark, sf):
    n = c("doc_id")
    d = D.table(spark, sf, "documents")
    model = F.concat(F.lit("MX-"), n)
    src = d.select(F.concat(F.lit("https://s/"), n).alias("url"), F.concat(F.lit("about "), model, F.when(n % 2 == 0, "").otherwise("9"), F.lit(" here: "), "text").alias("text"))
    rows = d.select(n.cast("string").alias("id"), F.concat(F.lit("https://s/"), n).alias("url"), F.lit("tone").alias("field"), at(60, 6).alias("value"),
                    at(55, 30).alias("quote"), model.alias("identity_quote"))
    return V.validate_external_facts(rows, src, d.select(n.cast("string").alias("id"), model.alias("model")))


@query("evd_05_validate_selection", sql("""select 'q' || (p_partkey % 10) as query, id from product where p_partkey % 3 > 0 and p_partkey % 4 > 0 and p_partkey % 7 > 0""", "product"))
def validate_selection(spark, sf):
    n = NUM()
    p = P(spark, sf).withColumn("query", F.concat(F.lit("q"), n % 10))
    rows = F.array(F.struct(F.lit(0).alias("requirement"), F.lit("name").alias("field"), F.concat(F.lit("Item "), "id").alias("quote")),
                   F.struct(F.when(n % 4 == 0, 0).otherwise(1).alias("requirement"), F.lit("description").alias("field"),
                            F.when(n % 7 == 0, F.lit("never said")).otherwise(F.lit("of type")).alias("quote")))
    sel = p.select("query", "id", F.inline(rows))
    cand = p.filter(n % 3 > 0).select("query", "id", "name", "description", "categories", "tags", "specifications")
    return V.validate_selection(sel, cand, F.lit(2))


@query("evd_06_quoted_only", """with s as (select source, 'u' || min(doc_id) as url from documents group by source), st as (select doc_id as row_id, source, substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 5, 8) as value, substr(text, doc_id * 7919 % greatest(length(text) - 60, 1) + 1, 25) as quote from documents)
    select row_id, min('u' || d.doc_id) as url from st join documents d on d.source = st.source and contains(d.text, st.quote) where trim(quote) <> '' and contains(quote, value) group by 1""")
def quoted_only(spark, sf):
    d = D.table(spark, sf, "documents")
    st = d.select(c("doc_id").alias("row_id"), "source", at(5, 8).alias("value"), at(1, 25).alias("quote"))
    return V.quoted_only(st, d.select("source", F.concat(F.lit("u"), "doc_id").alias("url"), "text"))


@query("evd_07_accept_matches", """select 't' || (p_partkey % 3) as tag, count(*) as scanned, count(*) filter (p_partkey % 5 = 0 and p_partkey // 40 % 9 > 0) as matched, count(distinct p_partkey // 40) filter (p_partkey // 40 % 9 = 0) as failed_batches from part group by 1""")
def accept_matches(spark, sf):
    k = c("p_partkey")
    batches = D.table(spark, sf, "part").select(F.concat(F.lit("t"), k % 3).alias("tag"), F.floor(k / 40).alias("batch"), k.alias("id"), (F.floor(k / 40) % 9 == 0).alias("failed"))
    answers = batches.filter("id % 5 = 0").select("tag", "batch", "id")
    return V.accept_matches(batches, answers.unionByName(answers.withColumn("batch", c("batch") + 1)))


@query("evd_08_rewrite_guard", "select p_partkey, p_partkey % 3 = 0 as accepted from part")
def rewrite_guard(spark, sf):
    k = c("p_partkey")
    q = F.concat("p_name", F.lit(" "), "p_size")
    df = D.table(spark, sf, "part").select(k, q.alias("query"), F.when(k % 3 == 0, F.upper(q)).when(k % 3 == 1, F.col("p_name")).otherwise(
        F.concat(F.element_at(F.split("p_name", " "), 1).substr(1, 2), F.lit(" "), "p_size")).alias("rewrite"))
    return V.rewrite_guard(df).select("p_partkey", "accepted")


def add_tag(pdf):
    """A user function: marks large sizes in the description and tries to change a price."""
    big = pdf["size"] > 40
    pdf.loc[big, "description"] = pdf.loc[big, "description"] + " XL"
    pdf["price"] = 0.0
    return pdf


SMALL = ("id", "title", "description", "price", "size")


@query("udf_01_transform_products", sql("select id, price, case when size > 40 then description || ' XL' else description end as description from product", "product"))
def transform_products(spark, sf):
    return H.transform_products(P(spark, sf).select(*SMALL), add_tag).select("id", "price", "description")


def shout(q):
    if "hot" in q:
        raise ValueError(q)
    return q.upper()


@query("udf_02_rewrite_queries", "select p_partkey, case when contains(p_name, 'hot') then p_name else upper(p_name) end as rewritten from part")
def rewrite_queries(spark, sf):
    q = D.table(spark, sf, "part").select("p_partkey", c("p_name").alias("query"))
    return H.rewrite_queries(q, shout).select("p_partkey", "rewritten")


def reverse_even(query_id, pdf):
    ids = [x for x in pdf["product_id"] if int(x) % 2 == 0]
    return ids[::-1] + ["unknown"]


@query("udf_03_rerank", sql("select query as query_id, product_id, row_number() over (partition by query order by rank desc) as rank from result where product_id::bigint % 2 = 0", "result"))
def rerank(spark, sf):
    return H.rerank(BQ.demo_results(spark, sf).withColumnRenamed("query", "query_id"), reverse_even)


@query("udf_04_function_trial", sql("select id, 'description' as changed from product where size > 40", "product"))
def function_trial(spark, sf):
    return H.function_trial(P(spark, sf).select(*SMALL), add_tag).select("id", F.array_join("changed", "|").alias("changed"))
