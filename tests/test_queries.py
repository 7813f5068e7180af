"""The registry, and a cross-section of the queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["prj_08_to_query_events", "joi_03_attribute", "agg_06_query_funnel", "cls_01_classify_leaks", "agg_14_query_baseline", "srt_02_audit_candidates",
          "agg_31_rollout_report", "agg_32_co_cart_pairs", "cat_01_apply_feed", "cat_03_merge_crawl", "sch_04_match_exact", "sch_06_retrieve",
          "sch_10_repair_spelling", "evd_02_validate_facts", "scr_05_extract_by_spec", "flt_15_robots_allowed", "str_03_stream_daily_activity", "udf_03_rerank"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 280


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, note = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert ok, note
