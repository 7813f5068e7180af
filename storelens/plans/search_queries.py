"""Index, query plans, retrieval, ranking and example checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import numbers as N, text as T
from storelens.operators import ranking as K, ranks as R, search as S
from storelens.plans import baseline_queries as BQ, catalog_queries, demo as D  # noqa: F401  (shares SQL fragments)
from storelens.plans.oracle import CTES, sql
from storelens.plans.registry import query
from storelens.session import cut

c = F.col
P = D.products

# Profile of the demo shop.
PROFILE = {"query_aliases": {"rng": "ring"}, "scoped": [{"id": "s1", "term": "hot gear", "mode": "only", "product_ids": [str(i) for i in range(0, 400, 7)]},
                                                        {"id": "s2", "term": "cog", "mode": "add", "product_ids": ["5", "6"]}],
           "tags": {"large": ["big"]}, "product_types": {"PROMO": ["promo", "special promo"]}, "colors": ["red", "blue"],
           "finishes": {"matte": ["matt"]}, "semantic": {"anvil": ["heavy"]}}


def cards_df(spark, sf):
    return P(spark, sf).withColumn("product_type", c("categories")[0]).withColumn("finishes", F.array().cast("array<string>"))


def query_rows(spark, sf):
    """Queries made of the catalog's own names: plain, with a type word, misspelt, unknown, by SKU, with a price limit."""
    n = D.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    last = F.element_at(F.split("p_name", " "), -1)
    first = F.element_at(F.split("p_name", " "), 1)
    typo = F.concat(first, F.lit(" "), F.substring(last, 1, 1), F.substring(last, 3, 100))
    rows = F.array(*[F.struct(F.lit(i).alias("kind"), q.alias("query")) for i, q in enumerate((
        c("p_name"), F.concat(F.initcap("p_name"), F.lit("  Promo")), typo, F.concat(F.lit("zzqx "), "p_name"), F.concat(F.lit("SKU-"), "k"),
        F.concat("p_name", F.lit(" עד 950")), F.concat(last, F.lit(" big"))))])
    return n.select("p_name", F.inline(rows)).select(F.concat_ws(":", "kind", "p_name").alias("query_id"), "query")


TOK = "list_distinct(list_filter(string_split(regexp_replace({}, '[-()\\[\\],:;!? ]+', ' ', 'g'), ' '), lambda x: x <> ''))"
CTES["sp"] = (f"select *, {TOK.format('hay_raw')} as tokens, {TOK.format('lower(title)')} as words, lower(title) as ltitle from card", ("card",))
CTES["post"] = ("select id as product_id, unnest(tokens) as term from sp", ("sp",))
CTES["voc"] = ("select term, count(*) as df from post group by 1", ("post",))
CTES["qn"] = ("select p_name, min(p_partkey) as k, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[-1] as b from part group by 1", ())
CTES["q"] = ("""select kind || ':' || p_name as query_id, query from (select p_name, 0 as kind, p_name as query from qn union all select p_name, 1, p_name || ' promo' from qn union all
    select p_name, 2, a || ' ' || b[1] || b[3:] from qn union all select p_name, 3, 'zzqx ' || p_name from qn union all select p_name, 4, 'sku ' || k from qn union all
    select p_name, 5, p_name || ' עד 950' from qn union all select p_name, 6, b || ' big' from qn)""", ("qn",))
# Plans with the profile, step by step.
CTES["pl0"] = ("select query_id, query as norm, trim(replace(' ' || query || ' ', ' rng ', ' ring ')) as spelled from q", ("q",))
CTES["pl1"] = ("""select *, list_filter([case when contains(' ' || spelled || ' ', ' hot gear ') then 's1' end, case when contains(' ' || spelled || ' ', ' cog ') then 's2' end], lambda x: x is not null) as scoped_rules,
    replace(replace(' ' || spelled || ' ', ' hot gear ', ' '), ' cog ', ' ') as rem from pl0""", ("pl0",))
CTES["pl2"] = ("""select * replace (regexp_replace(rem, 'עד\\s+\\d+\\s*', ' ') as rem), try_cast(nullif(regexp_extract(rem, 'עד\\s+(\\d+)', 1), '') as double) as max_price from pl1""", ("pl1",))
CTES["pl3"] = ("""select * replace (replace(replace(rem, ' large ', ' '), ' big ', ' ') as rem), case when contains(rem, ' large ') or contains(rem, ' big ') then ['large'] else [] end as tags from pl2""", ("pl2",))
CTES["pl4"] = ("select * replace (replace(rem, ' promo ', ' ') as rem), case when contains(rem, ' promo ') then 'PROMO' end as product_type from pl3", ("pl3",))
CTES["pl5"] = ("""select * replace (replace(replace(rem, ' red ', ' '), ' blue ', ' ') as rem), list_filter([case when contains(rem, ' red ') then 'red' end, case when contains(rem, ' blue ') then 'blue' end], lambda x: x is not null) as colors from pl4""", ("pl4",))
CTES["plan"] = ("""select * exclude (rem), list_concat(list_filter(string_split(trim(rem), ' '), lambda x: x <> ''), case when contains(norm, 'anvil') then ['heavy'] else [] end) as terms from pl5""", ("pl5",))
# Plans without a profile: every word is a term.
CTES["qplan"] = ("select query_id, query as norm, list_filter(string_split(regexp_replace(query, 'עד\\s+\\d+', '', 'g'), ' '), lambda x: x <> '') as terms, try_cast(nullif(regexp_extract(query, 'עד\\s+(\\d+)', 1), '') as double) as max_price from q", ("q",))


def indexed(spark, sf):
    """The index tables, written once and then read, as a shop's index is."""
    cards = cards_df(spark, sf)
    return cut(S.search_cards(cards)), cut(S.build_postings(cards)), cut(S.build_identifiers(cards))


@query("sch_01_build_postings", sql("select term, count(*) as df from post group by 1", "post"))
def build_postings(spark, sf):
    return S.vocabulary(S.build_postings(P(spark, sf)))


@query("sch_01_document_postings", """with d as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[®™׳״’''`"“”„«»″‟]', '', 'g'), '[-–—()\\[\\],:;!?]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) as t from documents)
    select doc_id, count(distinct w) as terms from (select doc_id, unnest(string_split(t, ' ')) as w from d) where w <> '' group by 1""")
def document_postings(spark, sf):
    docs = D.table(spark, sf, "documents").select(c("doc_id").alias("id"), F.lit("").alias("title"), c("text").alias("description"))
    return S.build_postings(docs).groupBy(c("product_id").alias("doc_id")).agg(F.count("*").alias("terms"))


@query("fn_02_search_normalize", """select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[®™׳״’''`"“”„«»″‟]', '', 'g'), '[-–—()\\[\\],:;!?]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) as text_hash from documents""")
def search_normalize(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(T.search_normalize(c("text")), 256).alias("text_hash"))


@query("fn_03_audit_normalize", """select doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '["''׳״`]', '', 'g'), '[^\\p{L}\\p{N}%+]+', ' ', 'g'))) as text_hash from documents""")
def audit_normalize(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(T.audit_normalize(c("text")), 256).alias("text_hash"))


@query("sch_02_build_identifiers", "select '' || p_partkey as key, '' || p_partkey as product_id from part union all select 'sku ' || p_partkey, '' || p_partkey from part")
def build_identifiers(spark, sf):
    return S.build_identifiers(P(spark, sf))


def plans(spark, sf, profile=PROFILE):
    return cut(S.plan_queries(query_rows(spark, sf), profile))


@query("sch_03_plan_queries", sql("""select query_id, spelled, array_to_string(scoped_rules, '|') as scoped_rules, max_price, array_to_string(tags, '|') as tags, product_type, array_to_string(colors, '|') as colors,
    array_to_string(terms, '|') as terms from plan""", "plan"))
def plan_queries(spark, sf):
    j = lambda x: F.array_join(x, "|").alias(x)
    return plans(spark, sf).select("query_id", "spelled", j("scoped_rules"), "max_price", j("tags"), "product_type", j("colors"), j("terms"))


OK = "not s.hidden and s.stock_status in ('instock', 'onbackorder')"
CTES["exact"] = (f"""select p.query_id, s.id as product_id from plan p join sp s on (p.norm = 'sku ' || s.id) and {OK} union all
    select p.query_id, s.id from plan p, sp s where {OK} and p.norm not like 'sku %' and (p.product_type is null or p.product_type = s.p_type) and list_has_all([s.color], p.colors)
      and list_has_all(s.tags, p.tags) and (p.max_price is null or s.price <= p.max_price) and list_has_all(s.words, p.terms)""", ("plan", "sp"))


@query("sch_04_match_exact", sql("select query_id, product_id from exact", "exact"))
def match_exact(spark, sf):
    cards, _, ids = indexed(spark, sf)
    return S.match_exact(plans(spark, sf), cards, ids)


CTES["term_"] = ("select distinct unnest(terms) as term from qplan", ("qplan",))
CTES["own_"] = ("select t.term, v.term as target, 0.0::double as cost from term_ t join voc v on v.term = t.term", ("term_", "voc"))
CTES["near_"] = ("""select t.term, v.term as target, v.df, levenshtein(t.term, v.term) as edits from term_ t, voc v where t.term not in (select term from own_) and length(t.term) >= 4 and not regexp_matches(t.term, '\\d') and not regexp_matches(v.term, '\\d')
    and t.term <> v.term and levenshtein(t.term, v.term) <= case when length(t.term) >= 8 then 2 else 1 end""", ("term_", "voc", "own_"))
CTES["resolved"] = ("""select term, target, cost from own_ union all select term, target, edits + 1.0 from (select *, row_number() over (partition by term order by df desc, target) as rn from (
    select *, min(edits) over (partition by term) as m from near_) where edits = m) where rn <= 10""", ("own_", "near_"))


@query("sch_05_resolve_terms", sql("select term, target, cost from resolved", "resolved"))
def resolve_terms(spark, sf):
    p = plans(spark, sf, {})
    _, post, _ = indexed(spark, sf)
    return S.resolve_terms(S.term_rows(p), S.vocabulary(post)).select("term", "target", "cost")


CTES["rest_"] = ("""select x.query_id, x.product_id, sum(cost) as penalty, count(*) as n from (select t.query_id, t.term, o.product_id, min(r.cost) as cost from (select query_id, unnest(terms) as term from qplan) t
    join resolved r on r.term = t.term join post o on o.term = r.target group by 1, 2, 3) x group by 1, 2""", ("qplan", "resolved", "post"))
CTES["found"] = (f"""select query_id, product_id, penalty, row_number() over (partition by query_id order by penalty, hits desc, same desc, popularity desc, product_id) as rank from (
    select p.query_id, s.id as product_id, r.penalty, len(list_intersect(p.terms, s.words)) as hits, s.ltitle = p.norm as same, s.popularity from rest_ r join qplan p on p.query_id = r.query_id and r.n = len(p.terms) join sp s on s.id = r.product_id
      where {OK} and (p.max_price is null or s.price <= p.max_price) and p.norm not like 'sku %' union all
    select p.query_id, s.id, 0, len(list_intersect(p.terms, s.words)), s.ltitle = p.norm, s.popularity from qplan p join sp s on p.norm = 'sku ' || s.id where {OK})""", ("rest_", "qplan", "sp"))


def found(spark, sf, n=None):
    cards, post, ids = indexed(spark, sf)
    return cut(S.retrieve(plans(spark, sf, {}), post, cards, ids, n))


@query("sch_06_retrieve", sql("select query_id, product_id, penalty, rank from found", "found"))
def retrieve(spark, sf):
    return found(spark, sf)


CTES["phrased"] = ("""select query_id, query as norm, terms, rules from (select distinct a from qn) x, (select unnest([
    {'k': 0, 'q': 'cog', 't': false, 'r': ['s2']}, {'k': 1, 'q': 'hot gear', 't': false, 'r': ['s1']}, {'k': 2, 'q': 'cog hot gear', 't': false, 'r': ['s1', 's2']},
    {'k': 3, 'q': ' cog', 't': true, 'r': ['s2']}, {'k': 4, 'q': ' hot gear', 't': true, 'r': ['s1']}]) as u) y,
    lateral (select u.k || ':' || a as query_id, case when u.t then a || u.q else u.q end as query, case when u.t then [a] else [] end as terms, u.r as rules)""", ("qn",))


@query("sch_06_linked_phrases", sql(f"""select query_id, product_id, 0.0::double as penalty, row_number() over (partition by query_id order by hits desc, same desc, popularity desc, product_id) as rank from (
    select p.query_id, s.id as product_id, s.popularity, s.ltitle = p.norm as same, len(list_intersect(case when len(p.terms) > 0 then p.terms else [case when r = 's1' then 'hot gear' else 'cog' end for r in p.rules] end, s.words)) as hits
    from phrased p join sp s on {OK} and list_has_all(s.tokens, p.terms) and (not list_contains(p.rules, 's1') or (cast(s.id as bigint) % 7 = 0 and cast(s.id as bigint) < 400))
      and (not list_contains(p.rules, 's2') or s.id in ('5', '6') or list_contains(s.tokens, 'cog')))""", "phrased", "sp"))
def linked_phrases(spark, sf):
    cards, post, ids = indexed(spark, sf)
    first = D.table(spark, sf, "part").select(F.element_at(F.split("p_name", " "), 1).alias("a")).distinct()
    texts = [F.lit("cog"), F.lit("hot gear"), F.lit("cog hot gear"), F.concat("a", F.lit(" cog")), F.concat("a", F.lit(" hot gear"))]
    asked = first.select("a", F.posexplode(F.array(*texts)).alias("k", "query")).select(F.concat_ws(":", "k", "a").alias("query_id"), "query")
    p = cut(S.plan_queries(asked, {"scoped": PROFILE["scoped"]}))
    return S.retrieve(p, post, cards, ids, rules=PROFILE["scoped"])


def turn_cards(spark, sf):
    """Conversation turns as a catalog: prose has near-identical words, which names of parts have not."""
    none = F.array().cast("array<string>")
    return D.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), c("role").alias("title"), c("text").alias("description"), none.alias("categories"),
        none.alias("tags"), F.lit(0.0).alias("price"), F.lit(False).alias("hidden"), F.lit("instock").alias("stock_status"))


@query("sch_07_relax_one_term")
def relax_one_term(spark, sf):
    cards = turn_cards(spark, sf)
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.length(w) >= 5)
    # every two neighbouring long words of the whole text
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, 2), " "))
    asked = D.table(spark, sf, "benchmark").select("item_id", words.alias("w")).select("item_id", F.posexplode(pairs).alias("at", "query"))
    asked = asked.select(F.concat_ws(":", "item_id", "at").alias("query_id"), "query")
    p = cut(S.plan_queries(asked, {}))
    index, post, ids = cut(S.search_cards(cards)), cut(S.build_postings(cards)), cut(S.build_identifiers(cards))
    return S.relax_one_term(p, cut(S.retrieve(p, post, index, ids)), post, index, ids)


@query("sch_08_explain_empty", sql("""select p.query_id, case when count(*) filter (r.term is null) > 0 then 'missing-terms' when count(*) > 1 and count(v.term) = count(*) then 'no-intersection' else 'filtered' end as why,
    coalesce(string_agg(p.term, ',' order by p.term) filter (r.term is null), '') as missing_terms from (select query_id, norm, unnest(terms) as term from qplan) p left join (select distinct term from resolved) r on r.term = p.term left join voc v on v.term = p.term
    where p.query_id not in (select query_id from found) group by 1""", "qplan", "found", "resolved", "voc"))
def explain_empty(spark, sf):
    cards, post, ids = indexed(spark, sf)
    p = plans(spark, sf, {})
    res = cut(S.resolve_terms(S.term_rows(p), S.vocabulary(post)))
    return S.explain_empty(p, cut(S.retrieve(p, post, cards, ids)), post, res)


@query("sch_09_scoped_alias_filter", sql("""select e.query_id, e.product_id from exact e join plan p using (query_id) where (not list_contains(p.scoped_rules, 's1') or (cast(e.product_id as bigint) % 7 = 0 and cast(e.product_id as bigint) < 400))
    and (not list_contains(p.scoped_rules, 's2') or e.product_id in ('5', '6') or e.product_id in (select product_id from post where term = 'cog'))""", "exact", "plan", "post"))
def scoped_alias_filter(spark, sf):
    cards, _, ids = indexed(spark, sf)
    p = plans(spark, sf)
    return S.scoped_alias_filter(S.match_exact(p, cards, ids), p, cards, PROFILE["scoped"])


@query("set_07_intersect_scoped_ids", sql("""select query_id, '' || i as product_id from plan, (select unnest(range(0, 400, 7)) as i) where list_contains(scoped_rules, 's1') union all select query_id, unnest(['5', '6']) from plan where list_contains(scoped_rules, 's2')""", "plan"))
def intersect_scoped_ids(spark, sf):
    return S.intersect_scoped_ids(plans(spark, sf), PROFILE["scoped"])


CTES["phr"] = (f"""select distinct w[1] || w[2] as compact, s.id as product_id from (select *, string_split(ltitle, ' ') as w from sp) s where {OK} and length(w[1] || w[2]) between 6 and 24 union
    select w[i], s.id from (select *, string_split(ltitle, ' ') as w from sp) s, (select unnest([1, 2]) as i) where {OK} and length(w[i]) between 6 and 24""", ("sp",))
CTES["ask"] = ("select query_id, array_to_string(terms, '') as term from qplan where len(terms) between 1 and 3 and length(array_to_string(terms, '')) between 6 and 24 and not regexp_matches(array_to_string(terms, ''), '\\d')", ("qplan",))
CTES["cnd"] = ("select distinct a.term, p.compact, levenshtein(a.term, p.compact) as e from (select distinct term from ask) a, (select distinct compact from phr) p where levenshtein(a.term, p.compact) <= case when length(a.term) >= 10 then 2 else 1 end", ("ask", "phr"))


@query("sch_10_repair_spelling", sql("""select distinct a.query_id, b.best as compact, b.be as edits, p.product_id from ask a join (select term, arg_min(compact, (e, compact)) as best, min(e) as be from cnd group by 1) b on b.term = a.term
    join cnd d on d.term = a.term and levenshtein(d.compact, b.best) <= 1 join phr p on p.compact = d.compact
    where not exists (select 1 from cnd x where x.term = a.term and x.e = b.be and levenshtein(x.compact, b.best) > 1)""", "ask", "cnd", "phr"))
def repair_spelling(spark, sf):
    return S.repair_spelling(plans(spark, sf, {}), P(spark, sf))


@query("sch_11_autocomplete", sql(f"""select prefix, product_id, rank from (select prefix, id as product_id, row_number() over (partition by prefix order by id) as rank from (select distinct ltitle[1:n] as prefix from sp, (select unnest([2, 3, 9, 12]) as n)) x
    join sp s on {OK} and (starts_with(s.ltitle, x.prefix) or len(list_filter(s.words, lambda w: starts_with(w, x.prefix))) > 0)) where rank <= 8""", "sp"))
def autocomplete(spark, sf):
    names = P(spark, sf).select(F.lower("title").alias("t")).distinct()
    prefixes = names.select(F.explode(F.array(*[F.substring("t", 1, n) for n in (2, 3, 9, 12)])).alias("prefix"))
    return S.autocomplete(prefixes, P(spark, sf))


REQUESTS = [{"query": "big red", "tags": ["large"], "categories": ["PROMO"], "terms": ["red", "size 4"]}, {"query": "ring", "terms": ["ring", "type econ"]}]
HAY = "lower(title || ' ' || replace(description, ',', ' ') || ' ' || size || ' ' || brand)"


@query("sch_12_lexical_score", sql(f"""select * from (select 'big red' as query, id as product_id, cast(4 * list_contains(tags, 'large')::int + 4 * (p_type = 'PROMO')::int + 3 * contains(h, 'red')::int + 3 * contains(h, 'size 4')::int as integer) as score from (select *, regexp_replace({HAY}, ' +', ' ', 'g') as h from product s where {OK}) union all
    select 'ring', id, 3 * contains(h, 'ring')::int + 3 * contains(h, 'type econ')::int from (select *, regexp_replace({HAY}, ' +', ' ', 'g') as h from product s where {OK})) where score > 0""", "product"))
def lexical_score(spark, sf):
    rows = [(r["query"], r.get("tags"), r.get("categories"), r["terms"]) for r in REQUESTS]
    return S.lexical_score(P(spark, sf), spark.createDataFrame(rows, "query string, tags array<string>, categories array<string>, terms array<string>"))


@query("sch_13_closest_score", sql(f"""select query, product_id, score, rank from (select *, row_number() over (partition by query order by score desc, product_id) as rank from (
    select q as query, id as product_id, cast(list_sum(list_transform(string_split(q, ' '), lambda t: 4 * contains(lower(title), t)::int + contains(h, t)::int)) as integer) as score from (select *, lower(description || ' ' || array_to_string(categories, ' ') || ' ' || size || ' ' || brand) as h from product s where {OK}), (select unnest(['red ring large', 'promo cog']) as q))) where rank <= 100""", "product"))
def closest_score(spark, sf):
    return S.closest_score(P(spark, sf), spark.createDataFrame([("red ring large",), ("promo cog",)], "query string"))


@query("sch_13_closest_to_titles", sql(f"""select query, product_id, score, rank from (select *, row_number() over (partition by query order by score desc, product_id) as rank from (
    select q as query, id as product_id, cast(list_sum(list_transform(string_split(q, ' '), lambda t: 4 * contains(lower(title), t)::int + contains(h, t)::int)) as integer) as score from (select *, lower(description || ' ' || array_to_string(categories, ' ') || ' ' || size || ' ' || brand) as h from product s where {OK}), (select distinct lower(title) || ' promo' as q from product))) where rank <= 10""", "product"))
def closest_to_titles(spark, sf):
    """Every title of the catalog as a query, against a catalog stored in blocks of 500 products."""
    products = P(spark, sf)
    asked = products.select(F.concat(F.lower("title"), F.lit(" promo")).alias("query"))
    return S.closest_score(None, asked, 10, postings=S.score_postings(products, block_products=500))


def vector_results(spark, sf, k):
    e = D.table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))
    return S.vector_rank(q, e.select(c("vec_id").alias("product_id"), c("embedding").alias("vector")), k, 6)


VEC = """select a.vec_id as query_id, b.vec_id as product_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0"""


@query("sch_14_vector_rank", f"select * from (select *, row_number() over (partition by query_id order by score desc, product_id) as rank from ({VEC})) where rank <= 10")
def vector_rank(spark, sf):
    return vector_results(spark, sf, 10)


@query("fn_23_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id - 1")
def cosine(spark, sf):
    e = D.table(spark, sf, "embeddings")
    prev = e.select((c("vec_id") + 1).alias("vec_id"), c("embedding").alias("before"))
    return e.join(prev, "vec_id").select("vec_id", F.round(N.cosine(c("embedding"), c("before")), 6).alias("cosine"))


LEX = "select query_id, product_id, row_number() over (partition by query_id order by product_id desc) - 1 as pos from (select a.vec_id as query_id, b.vec_id as product_id from embeddings a join embeddings b on a.label = b.label where a.vec_id % 50 = 0)"


def lexical_list(spark, sf):
    e = D.table(spark, sf, "embeddings")
    pairs = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "label").join(e.select(c("vec_id").alias("product_id"), "label"), "label").drop("label")
    return S.zero_based_rank(pairs, ["query_id"], [c("product_id").desc()])


@query("win_07_rank_fusion_rank", LEX)
def rank_fusion_rank(spark, sf):
    return lexical_list(spark, sf)


@query("sch_15_rank_fusion", f"""select query_id, product_id, score, row_number() over (partition by query_id order by score desc, product_id) as rank from (select query_id, product_id, round(sum(1.0::double / (60 + pos)), 12) as score from (
    select query_id, product_id, pos from ({LEX}) where pos < 100 union all select query_id, product_id, rank - 1 from (select *, row_number() over (partition by query_id order by score desc, product_id) as rank from ({VEC})) where rank <= 100) group by 1, 2)""")
def rank_fusion(spark, sf):
    vec = vector_results(spark, sf, 100).withColumn("pos", c("rank") - 1)
    return S.rank_fusion([lexical_list(spark, sf), vec])


RULES = [{"id": "promo", "action": "boost", "field": "categories", "values": ["promo"], "terms": ["red"], "match": "direct", "weight": 2},
         {"id": "cheap", "action": "bury", "field": "title", "values": ["anvil"], "match": "any"}, {"id": "other", "field": "tags", "values": ["large"], "terms": ["nothing here"]}]
CTES["rk"] = ("""select f.query_id, f.product_id, f.rank, s.ltitle, s.p_type, q.query, list_filter(string_split(q.query, ' '), lambda x: length(x) > 1) as qw, s.words from found f join q on q.query_id = f.query_id join sp s on s.id = f.product_id""", ("found", "q", "sp"))


def all_results(spark, sf):
    return found(spark, sf).join(query_rows(spark, sf), "query_id").select("query_id", "query", "product_id", "rank")


STEM = "case when length({0}) <= 3 then {0} else {0}[1:greatest(3, length({0}) - 2)] end"
SAME = f"(w = q or (length(w) >= 3 and (starts_with(w, {STEM.format('q')}) or starts_with(q, {STEM.format('w')}))))"
CTES["rk2"] = (f"""select *, len(qw) > 0 and len(list_filter(qw, lambda q: len(list_filter(tw, lambda w: {SAME})) = 0)) = 0 as direct, len(list_filter(qw, lambda q: len(list_filter(tw[1:1], lambda w: {SAME})) > 0)) > 0 as heads
    from (select *, string_split(ltitle, ' ') as tw from rk)""", ("rk",))
CTES["rk3"] = ("""select *, 2 * (list_contains(qw, 'red') and p_type = 'PROMO' and direct)::int - (contains(ltitle, 'anvil'))::int as score, (list_contains(qw, 'red') and p_type = 'PROMO' and direct) or contains(ltitle, 'anvil') as touched from rk2""", ("rk2",))


@query("sch_16_apply_ranking_rules", sql("""select query_id, product_id, rank, score, row_number() over (partition by query_id order by case when a then direct::int else 0 end desc, case when a then score else 0 end desc, case when a then (score > 0 and heads)::int else 0 end desc, rank) as new_rank
    from (select *, bool_or(touched) over (partition by query_id) as a from rk3)""", "rk3"))
def apply_ranking_rules(spark, sf):
    return K.apply_ranking_rules(all_results(spark, sf), P(spark, sf), RULES)


@query("sch_17_rule_target_counts", sql("select 'promo' as rule_id, count(*) as products from product where p_type = 'PROMO' union all select 'cheap', count(*) from product where contains(lower(title), 'anvil') union all select 'other', count(*) from product where list_contains(tags, 'large')", "product"))
def rule_target_counts(spark, sf):
    return K.rule_target_counts(P(spark, sf), RULES)


CTES["top5"] = ("select query as query_id, product_id, rank from result", ("result",))


@query("sch_18_apply_layout", sql("""select query_id, product_id, row_number() over (partition by query_id order by position nulls last, low, rank) as new_rank, position is not null as pinned from (
    select coalesce(r.query_id, p.query_id) as query_id, coalesce(r.product_id, p.product_id) as product_id, r.rank, p.position, (coalesce(r.product_id, p.product_id)::bigint % 5 = 1)::int as low from top5 r
    full join (select 'q' || (p_partkey % 20) as query_id, '' || p_partkey as product_id, p_partkey as position from part where p_partkey % 40 < 20) p on p.query_id = r.query_id and p.product_id = r.product_id) where product_id::bigint % 11 <> 0""", "top5"))
def apply_layout(spark, sf):
    res = BQ.demo_results(spark, sf).select(c("query").alias("query_id"), "product_id", "rank")
    n = c("p_partkey")
    part = D.table(spark, sf, "part")
    pins = part.filter(n % 40 < 20).select(F.concat(F.lit("q"), n % 20).alias("query_id"), n.cast("string").alias("product_id"), n.alias("position"))
    every = res.select("query_id", "product_id").union(pins.select("query_id", "product_id")).distinct().withColumn("k", c("product_id").cast("bigint"))
    return K.apply_layout(res, pins, every.filter("k % 11 = 0"), every.filter("k % 5 = 1"))


@query("sch_19_merge_vectors", "select vec_id as id, case when vec_id % 4 = 0 then 'new' else 'old' end as text_hash from embeddings where vec_id % 4 = 0 or vec_id % 3 > 0")
def merge_vectors(spark, sf):
    e = D.table(spark, sf, "embeddings").select(c("vec_id").alias("id"), F.lit("old").alias("text_hash"), F.when(c("vec_id") % 3 == 0, "m0").otherwise("m1").alias("model"), c("embedding").alias("vector"))
    new = e.filter("id % 4 = 0").withColumn("text_hash", F.lit("new")).withColumn("model", F.lit("m1"))
    return S.merge_vectors(e, new, "m1", 64).select("id", "text_hash")


@query("sch_19_stale_vectors", "select doc_id as id, sha256(text) as text_hash from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def stale_vectors(spark, sf):
    d = D.table(spark, sf, "documents").select(c("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    store = d.select("id", F.when(c("id") % 3 == 0, "other").otherwise(c("text_hash")).alias("text_hash"), F.when(c("id") % 5 == 0, "m0").otherwise("m1").alias("model"))
    return S.stale_vectors(d, store, "m1")


CTES["eid"] = ("""select 'e' || (p_partkey // 10) as example_id, 'q' || (p_partkey // 10 % 20) as query, '' || p_partkey as product_id, p_partkey % 10 < 2 as want from part where p_partkey % 10 < 3""", ())


def examples(spark, sf):
    k = c("p_partkey")
    rows = D.table(spark, sf, "part").filter(k % 10 < 3)
    ids = lambda cond: F.filter(F.collect_list(F.when(cond, k.cast("string"))), lambda x: x.isNotNull())
    return rows.groupBy(F.concat(F.lit("e"), F.floor(k / 10)).alias("example_id"), F.concat(F.lit("q"), F.floor(k / 10) % 20).alias("query")).agg(
        ids(k % 10 < 2).alias("include_ids"), ids(k % 10 == 2).alias("exclude_ids"))


def evaluated(spark, sf, top):
    return K.evaluate_examples(examples(spark, sf), BQ.demo_results(spark, sf).filter(c("rank") <= top), P(spark, sf))


def _ex(top):
    return f"""select example_id, query, count(*) filter (want and not got) as missing, count(*) filter (not want and got) as unwanted, count(*) filter (want and not ok) as unavailable from (
    select e.*, r.product_id is not null as got, coalesce(not s.hidden and s.stock_status = 'instock', false) as ok from eid e left join (select * from result where rank <= {top}) r on r.query = e.query and r.product_id = e.product_id left join product s on s.id = e.product_id) group by 1, 2"""


CTES["ex1"] = (_ex(32), ("eid", "result", "product"))
CTES["ex2"] = (_ex(11), ("eid", "result", "product"))
PASS = "missing = 0 and unwanted = 0 and unavailable = 0"


@query("sch_20_evaluate_examples", sql(f"select *, {PASS} as passed from ex1", "ex1"))
def evaluate_examples(spark, sf):
    return evaluated(spark, sf, 32)


@query("sch_21_example_regressions", sql(f"select example_id, query from ex2 where not ({PASS}) and example_id in (select example_id from ex1 where {PASS})", "ex1", "ex2"))
def example_regressions(spark, sf):
    return K.example_regressions(evaluated(spark, sf, 32), evaluated(spark, sf, 11)).select("example_id", "query")


@query("sch_22_targets_found", sql("select count(*) filter (r.rank <= 24) as found, count(*) as total from (select '' || p_partkey as id, 'q' || (p_partkey // 10 % 20) as query from part where p_partkey % 7 = 0) t left join result r on r.query = t.query and r.product_id = t.id", "result"))
def targets_found(spark, sf):
    n = c("id").cast("int")
    t = P(spark, sf).filter(n % 7 == 0).select(F.concat(F.lit("q"), F.floor(n / 10) % 20).alias("query"), c("id").alias("product_id"))
    return K.targets_found(t, BQ.demo_results(spark, sf))


@query("sch_23_failing_queries", sql("select query from (select query, min(part) as p, min(o) as o from (select 'q19' as query, 0 as part, 0 as o union all select query, 1, -searches from evaluated2 where status in ('lost', 'partial') or production = 'fails') group by 1) order by p, o, query limit 6", "evaluated2"))
def failing_queries(spark, sf):
    return K.failing_queries(BQ.evaluation(spark, sf, 1), ["q19"], 6)


@query("sch_24_concept_terms", sql("""with w as (select w as term, count(*) as df from (select unnest(words) as w from sp where not hidden) where length(w) >= 3 group by 1)
    select * from (select * from w order by df desc, term limit 150) union select * from (select * from w order by df desc, term limit 100)""", "sp").replace("with w as", ", w as", 1).replace(")\n, w as", "), w as"))
def concept_terms(spark, sf):
    return S.concept_terms(P(spark, sf))


HEB = "translate(substr(md5(p_name), 1, 6), '0123456789abcdef', 'אבגדהוזחטיכלמנסע')"


CTES["roots"] = (f"select distinct {HEB} || case when length(p_name) > 9 then ' שלם' else '' end as q, {HEB} as w from part", ())
CTES["variants"] = ("""select q, 'head' as kind, cast(null as varchar) as of, 0 as o from roots union all select w[1:2] || w[4] || w[3] || w[5:] || q[7:], 'typo', q, 1 from roots where w[3] <> w[4] union all
    select translate(q, 'אבגדהוזחטיכלמנסעשם', 'tcdsvuzjyhfknbxgao'), 'layout', q, 2 from roots union all select 'ה' || q, 'prefix', q, 3 from roots where not contains(q, ' ') and not regexp_matches(q, '^[הוב]')""", ("roots",))


@query("sch_25_query_variants", sql("select x.q as q, x.kind as kind, x.of as of from (select arg_min({'q': q, 'kind': kind, 'of': of}, (o, coalesce(of, ''), q)) as x from variants group by replace(q, 'ם', 'מ'))", "variants"))
def query_variants(spark, sf):
    heb = F.translate(F.substring(F.md5("p_name"), 1, 6), "0123456789abcdef", "אבגדהוזחטיכלמנסע")
    q = D.table(spark, sf, "part").select("p_name").distinct().select(F.concat(heb, F.when(F.length("p_name") > 9, " שלם").otherwise("")).alias("q"), F.lit("head").alias("kind"))
    return S.query_variants(q)


@query("fn_16_keyboard_layout", f"select p_partkey, translate({HEB}, 'אבגדהוזחטיכלמנסע', 'tcdsvuzjyhfknbxg') as typed from part")
def keyboard_layout(spark, sf):
    heb = F.translate(F.substring(F.md5("p_name"), 1, 6), "0123456789abcdef", "אבגדהוזחטיכלמנסע")
    return D.table(spark, sf, "part").select("p_partkey", T.keyboard_layout(heb).alias("typed"))


@query("fn_18_article_prefixed", f"select p_partkey, case when not regexp_matches({HEB}, '^[הוב]') then 'ה' || {HEB} end as prefixed from part")
def article_prefixed(spark, sf):
    heb = F.translate(F.substring(F.md5("p_name"), 1, 6), "0123456789abcdef", "אבגדהוזחטיכלמנסע")
    return D.table(spark, sf, "part").select("p_partkey", T.article_prefixed(heb).alias("prefixed"))


@query("fn_17_swap_typo", """select p_partkey, case when length(w) >= 4 and w[m] <> w[m + 1] then case when length(a) >= length(b) then x || ' ' || b else a || ' ' || x end end as typo from (
    select *, w[1:m - 1] || w[m + 1] || w[m] || w[m + 2:] as x from (select *, length(w) // 2 as m from (select *, case when length(a) >= length(b) then a else b end as w from (select p_partkey, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b from part))))""")
def swap_typo(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.swap_typo(c("p_name")).alias("typo"))


@query("fn_11_stem2", sql("select term, case when length(term) <= 3 then term else term[1:greatest(3, length(term) - 2)] end as stem from voc", "voc"))
def stem2(spark, sf):
    return S.vocabulary(S.build_postings(P(spark, sf))).select("term", T.stem2(c("term")).alias("stem"))


@query("fn_12_word_matches", sql("""select p_partkey, len(list_filter(words, lambda w: w = 'rings' or (length(w) >= 3 and (starts_with(w, 'rin') or starts_with('rings', case when length(w) <= 3 then w else w[1:greatest(3, length(w) - 2)] end))))) > 0 as hit from sp""", "sp"))
def word_matches(spark, sf):
    return P(spark, sf).select(c("id").cast("bigint").alias("p_partkey"), T.word_matches(F.lit("rings"), F.split(F.lower("title"), " ")).alias("hit"))


@query("fn_13_inflections", f"select p_partkey, array_to_string(list_filter([w || 'ים', w || 'ות'], lambda x: true), '|') as forms from (select p_partkey, substr({HEB}, 1, 4) || 'ר' as w from part)")
def inflections(spark, sf):
    heb = F.concat(F.translate(F.substring(F.md5("p_name"), 1, 4), "0123456789abcdef", "אבגדהוזחטיכלמנסע"), F.lit("ר"))
    return D.table(spark, sf, "part").select("p_partkey", F.array_join(T.inflections(heb), "|").alias("forms"))


@query("fn_14_prefix_stems", f"""select p_partkey, array_to_string(list_filter([case when a then w[2:] end, case when a and b then w[3:] end, case when a and b and d then w[4:] end], lambda x: x is not null), '|') as stems from (
    select *, regexp_matches(w[1], '[והבלמשכ]') as a, regexp_matches(w[2], '[והבלמשכ]') as b, regexp_matches(w[3], '[והבלמשכ]') as d from (select p_partkey, {HEB} as w from part))""")
def prefix_stems(spark, sf):
    heb = F.translate(F.substring(F.md5("p_name"), 1, 6), "0123456789abcdef", "אבגדהוזחטיכלמנסע")
    return D.table(spark, sf, "part").select("p_partkey", F.array_join(T.prefix_stems(heb), "|").alias("stems"))


@query("fn_15_edit_distance", "select a.p_partkey, least(3, levenshtein(a.p_name, b.p_name)) as edits from part a join part b on b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("next"))
    return p.join(nxt, "p_partkey").select("p_partkey", T.edit_distance(c("p_name"), c("next"), 2).alias("edits"))


@query("fn_19_title_matches", "select p_partkey, regexp_matches(p_name, 'ring|red') as hit from part")
def title_matches(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.title_matches(F.lit("x ring red"), c("p_name")).alias("hit"))


@query("fn_20_max_price", "select p_partkey, cast(p_size + 900 as double) as price from part")
def max_price(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.max_price(F.concat("p_name", F.lit(" עד  "), c("p_size") + 900, F.lit(" שקלים"))).alias("price"))


@query("fn_21_apply_spelling", "select p_partkey, trim(replace(replace(' ' || p_name || ' ', ' red ring ', ' ruby '), ' hot ', ' warm ')) as spelled from part")
def apply_spelling(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.apply_spelling(c("p_name"), {"hot": "warm", "red ring": "ruby"}).alias("spelled"))


@query("sch_26_proposal_gain", sql(f"select 'p' || a.example_id as proposal_id, a.example_id, (a.missing = 0 and a.unwanted = 0 and a.unavailable = 0) and b.missing > a.missing as improved, (a.missing = 0 and a.unwanted = 0 and a.unavailable = 0) and b.missing > a.missing and (select count(*) from ex1 where not ({PASS}) and example_id in (select example_id from ex2 where {PASS})) = 0 as kept from ex2 b join ex1 a using (example_id)", "ex1", "ex2"))
def proposal_gain(spark, sf):
    before, after = evaluated(spark, sf, 11), evaluated(spark, sf, 32)
    props = examples(spark, sf).select(F.concat(F.lit("p"), "example_id").alias("proposal_id"), "example_id")
    return K.proposal_gain(props, before, after, K.example_regressions(before, after))


@query("sch_27_mine_examples", sql("""select query_key, array_to_string(list(product_id order by pos, product_id) filter (side = 'after'), '|') as include_ids, coalesce(array_to_string(list(product_id order by pos, product_id) filter (side = 'before'), '|'), '') as exclude_ids from (
    select *, row_number() over (partition by query_key, side order by pos, product_id) as rn from (select 'k' || (p_partkey % 30) as query_key, '' || p_partkey as product_id, p_partkey as pos, case when p_partkey % 3 = 0 then 'before' else 'after' end as side from part where p_partkey // 600 = 0 and not (p_partkey % 3 = 0 and p_partkey % 2 = 0))) where rn <= 20 group by 1 having count(*) filter (side = 'after') > 0""", "q"))
def mine_examples(spark, sf):
    k = c("p_partkey")
    checks = D.table(spark, sf, "part").select(F.concat(F.lit("k"), k % 30).alias("query_key"), F.floor(k / 600).alias("seq"), F.when(k % 3 == 0, "before").otherwise("after").alias("side"), k.alias("pos"), k.cast("string").alias("product_id"))
    current = checks.filter(k_even()).select("query_key", "product_id")
    return K.mine_examples(checks, P(spark, sf), current).withColumn("include_ids", F.array_join("include_ids", "|")).withColumn("exclude_ids", F.array_join("exclude_ids", "|"))


def k_even():
    return c("pos") % 2 == 0


@query("sch_28_lost_queries", sql("select query, case when status in ('lost', 'partial') then 'lost' else 'fails' end as reason, searches, targets - found as missing from evaluated2 where status in ('lost', 'partial') or production = 'fails' order by status not in ('lost', 'partial'), searches desc, query limit 12", "evaluated2"))
def lost_queries(spark, sf):
    return K.lost_queries(BQ.evaluation(spark, sf, 1))


@query("srt_04_result_pages", sql("select query, product_id, rank, (rank - 1) // 12 as page from result", "result"))
def result_pages(spark, sf):
    return R.result_pages(BQ.demo_results(spark, sf), 12)


@query("srt_06_probe_queries", """with w as (select p_partkey, list_filter(string_split(p_name, ' '), lambda x: length(x) >= 3 and x not in ('new', 'the', 'and', 'for', 'with', 'set')) as w from part),
    n as (select 1 as part, x as q, count(*) as n from (select unnest(list_distinct(w)) as x from w) group by x union all select 0, w[1] || ' ' || w[2], count(*) from w where len(w) = 2 group by 2)
    select q, n from (select *, row_number() over (partition by part order by n desc, q) as rn from n where n between 8 and 400) where (part = 0 and rn <= 3) or (part = 1 and rn <= 6) order by part, rn limit 6""")
def probe_queries(spark, sf):
    return S.probe_queries(P(spark, sf))


@query("srt_08_stock_last", sql("select query_id, product_id, row_number() over (partition by query_id order by stock_status <> 'instock', r.rank) as rank from (select query as query_id, product_id, rank from result) r join product on id = product_id", "result", "product"))
def stock_last(spark, sf):
    res = BQ.demo_results(spark, sf).withColumnRenamed("query", "query_id").join(P(spark, sf).select(c("id").alias("product_id"), "stock_status"), "product_id")
    return S.stock_last(res).select("query_id", "product_id", "rank")


@query("set_03_exact_then_extra", sql("select query as query_id, product_id, row_number() over (partition by query order by rank > 10, rank) as rank from result where rank <= 10 or product_id::bigint % 2 = 0", "result"))
def exact_then_extra(spark, sf):
    res = BQ.demo_results(spark, sf).withColumnRenamed("query", "query_id")
    return S.exact_then_extra(res.filter("rank <= 10"), res.filter("product_id % 2 = 0")).select("query_id", "product_id", "rank")


@query("cls_07_concierge_trigger", sql("select query, case when total = 0 then case when query in ('c1', 'c2') then 'out_of_stock' else 'no_results' end when ins = 0 then 'out_of_stock' when not literal then 'non_literal' end as reason from (select 'c' || c_nationkey as query, count(*) filter (c_acctbal > 9000) as total, count(*) filter (c_acctbal > 9500) as ins, c_nationkey % 2 = 0 as literal from customer group by c_nationkey)", "q"))
def concierge_trigger(spark, sf):
    n = c("c_nationkey")
    res = D.table(spark, sf, "customer").groupBy(n).agg(F.count_if(c("c_acctbal") > 9000).alias("total"), F.count_if(c("c_acctbal") > 9500).alias("in_stock")).select(
        F.concat(F.lit("c"), n).alias("query"), "total", "in_stock", (n % 2 == 0).alias("literal"))
    hits = D.table(spark, sf, "nation").filter("n_nationkey in (1, 2)").select(F.concat(F.lit("c"), c("n_nationkey")).alias("query"), F.lit(3).alias("hits"))
    return K.concierge_trigger(res, hits)


@query("agg_42_build_checks", sql("select unnest(['document-count', 'valid-cards', 'no-duplicate-product-ids', 'id-lookup']) as name, true as passed"))
def build_checks(spark, sf):
    from storelens.operators.catalog import build_checks as checks
    _, post, ids = indexed(spark, sf)
    return checks(P(spark, sf), post, ids)
