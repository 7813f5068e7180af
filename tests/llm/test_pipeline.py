"""The stages one after the other, and the entry."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from compare import compare, connect
from storelens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_stages_keep_the_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        after = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and len(after) > 0.7 * len(before), name
        before = after
    assert {r["doc_id"] for r in C.STAGES[-1][1](spark, docs, SF).collect()} == before


def test_stages_equal_brute_force(spark):
    """Every stage on what its predecessor kept, against plain Python, SQL and the tokenizer's own library."""
    import duckdb
    from tokenizers import Tokenizer

    from storelens.llm import decontamination_queries, simhash_dedup
    from storelens.llm.bpe_queries import vocabulary
    from test_duplicates import what_is_left, components

    steps = dict(C.STAGES)
    read = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    first = steps["toxicity"](spark, table(spark, SF, "documents"), SF).persist()
    scored = {r["doc_id"]: r["predicted"] for r in entry.queries()["op8_toxicity"](spark, SF).collect()}
    assert set(read(first)) == {i for i, p in scored.items() if p == 0}

    second = steps["simhash_near_dedup"](spark, first, SF).persist()
    before = sorted(read(first).items())
    sets = [set(simhash_dedup.shingle_set((t or "").encode()).tolist()) for _, t in before]
    root = components(len(before), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert set(read(second)) == {before[i][0] for i in set(root)}

    third = steps["suffix_array_dedup"](spark, second, SF).persist()
    kept = what_is_left(sorted((i, (t or "").encode()) for i, t in read(second).items()))
    assert read(third) == {i: k.decode("utf-8", "ignore") for i, (n, k) in kept.items() if k or not n}

    fourth = steps["benchmark_decontamination"](spark, third, SF).persist()
    con = duckdb.connect()
    con.register("rows", third.toPandas())
    con.execute("create view documents as select * from rows")
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(f"select doc_id from ({decontamination_queries.CHECK})").fetchall()}
    assert set(read(fourth)) == set(read(third)) - bad

    lib = Tokenizer.from_file(vocabulary())
    ids = {r["doc_id"]: r["ids"] for r in steps["bpe"](spark, fourth, SF).collect()}
    assert ids == {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in read(fourth).items()}


def test_stages_take_odd_rows(spark, odd_docs):
    for name, stage in C.STAGES:
        assert stage(spark, odd_docs, SF).count() >= 5, name
        assert stage(spark, odd_docs.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", ["op4_warc", "op5_decontamination", "op10_spherical"])
def test_query_matches_sql(spark, name):
    ok, note = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert ok, note
