"""Registered queries against their SQL where keys, groups or counts leave the range of the small tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A data folder: the smallest tables, some of them replaced by the rows of a DuckDB statement."""
    def make(**replaced):
        for t in TABLES:
            target = tmp_path / f"{t}.parquet"
            if t in replaced:
                connect(SF).execute(f"copy ({replaced[t]}) to '{target}' (format parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", target)
        return str(tmp_path)

    return make


def check(spark, name, sf):
    ok, note = compare(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert ok, note


# every query is searched by many of the sessions and never clicked or carted: all are synthetic
ALL_SYNTHETIC = """select event_id, ts, event_id % 301 as user_id, case when event_id % 3 < 2 then 'view' else 'purchase' end as event_type,
    value, '{"k": ' || (event_id % 7 % 2 + 1) || '}' as props from events"""


def test_review_eligibility_without_real_queries(spark, folder):
    check(spark, "agg_33_review_eligibility", folder(events=ALL_SYNTHETIC))


def test_exclude_synthetic_without_remaining_searches(spark, folder):
    check(spark, "cls_03_exclude_synthetic", folder(events=ALL_SYNTHETIC))


def test_repeated_page_after_a_block_without_parts(spark, folder):
    check(spark, "scr_16_repeated_page", folder(part="select * from part where p_partkey // 500 = 0 union all select * replace (p_partkey + 1000 as p_partkey) from part where p_partkey < 50"))


def test_verify_change_with_keys_beyond_100000(spark, folder):
    check(spark, "cat_17_verify_change", folder(part="select * from part union all select * replace (p_partkey + 100000 as p_partkey) from part"))
