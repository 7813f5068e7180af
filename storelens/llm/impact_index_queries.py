"""op11: the five best vectors for every vector whose id is divisible by fifty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import saved, table, work_folder
from storelens.llm.impact_index import build_index, integers, search
from storelens.llm.registry import query

CHECK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
           from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


@query("op11_impact_index", CHECK)
def op11_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    rows = saved(integers(table(spark, sf_dir, "embeddings")), folder, "integers")
    return search(build_index(rows, folder), rows.where("key % 50 = 0"), 5)
