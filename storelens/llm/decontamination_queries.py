"""op5: which documents hold which benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table, work_folder
from storelens.llm.decontamination import matches
from storelens.llm.registry import query

CHECK = r"""
with recursive
 iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
 dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents),
 i as (select item_id, len(w) - 4 n, unnest(range(1, len(w) - 3)) p, w from iw where len(w) >= 5),
 ih as (select item_id, n, p, array_to_string(w[p:p + 4], ' ') s from i),
 ic as (select item_id, n, s, count(*) c from ih group by all),
 d as (select doc_id, len(w) - 4 m, unnest(range(1, len(w) - 3)) p, w from dw where len(w) >= 5),
 dh as (select doc_id, m, p, array_to_string(w[p:p + 4], ' ') s from d),
 hit as (select doc_id, item_id, n, m, p from dh join ic using (s)),
 win as (select distinct doc_id, item_id, n, greatest(1, least(p, m - n + 1)) st, least(n, m) size from hit),
 wc as (select win.doc_id, item_id, n, size, st, s, count(*) c from win join dh on dh.doc_id = win.doc_id and dh.p between st and st + size - 1 group by all),
 sim as (select wc.doc_id, wc.item_id, st, sum(least(wc.c, ic.c)) / (any_value(size) + any_value(wc.n) - sum(least(wc.c, ic.c))) similarity
         from wc join ic on ic.item_id = wc.item_id and ic.s = wc.s group by wc.doc_id, wc.item_id, st),
 best as (select doc_id, item_id, st, similarity, row_number() over (partition by doc_id, item_id order by similarity desc, st) k from sim where similarity >= 0.8)
select doc_id, item_id, similarity, (st - 1)::int "start" from best where k = 1
"""


@query("op5_decontamination", CHECK)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start of every match."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), work_folder(spark))
