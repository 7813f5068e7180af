"""op4: every page through WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import warc as W
from storelens.llm.common import table, work_folder
from storelens.llm.registry import query

# base32 in DuckDB: the 40 hex digits of the SHA-1 are eight groups of 20 bits, each four letters.
_GROUP = "(('0x' || substr(s, {i}, 5))::bigint)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_GROUP.format(i=1 + 5 * g)} >> {shift}) & 31)::int + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

CHECK = f"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
     d as (select *, min(page_id) over (partition by s) first from p)
select page_id, strlen(h)::bigint payload_bytes, {_BASE32} payload_digest,
       case when page_id > first then 'revisit' else 'response' end record_type,
       case when page_id > first then first end refers_to
from d
"""


@query("op4_warc", CHECK)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    index = W.write_archives(W.mark_revisits(table(spark, sf_dir, "pages"), folder), folder)
    return W.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
