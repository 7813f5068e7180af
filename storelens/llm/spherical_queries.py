"""op10: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table, work_folder
from storelens.llm.registry import query
from storelens.llm.spherical import near_duplicates

CHECK = """
with v as (select vec_id, label, embedding::double[] e from embeddings),
     l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
     r as (with recursive t(a, b) as (select vec_id, vec_id from v union select t.a, l.b from t join l on l.a = t.b) select a, min(b) m from t group by a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) n_links, r.m component_id, v.vec_id = r.m kept from v join r on r.a = v.vec_id
"""


@query("op10_spherical", CHECK)
def op10_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), work_folder(spark))
