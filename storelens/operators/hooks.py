"""User functions on products, queries and results (UDF-01..04)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

c = F.col
# What shoppers see and buy, which a user function may not change.
PROTECTED = ("id", "url", "price", "regular_price", "stock_status", "hidden", "sku", "variants", "title", "image", "images")


def transform_products(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """UDF-01: ``fn`` once per Arrow batch of products; protected columns keep their source values.

    The batch keeps its rows and order, so no join is needed to restore them.
    """
    keep = [x for x in df.columns if x in PROTECTED]

    def run(batches):
        for pdf in batches:
            out = fn(pdf.copy())
            if len(out) != len(pdf):
                raise ValueError("the function must return one product per product")
            out = out.reset_index(drop=True)
            for x in keep:
                out[x] = pdf[x].to_numpy()
            yield out[list(pdf.columns)]

    return df.mapInPandas(run, df.schema)


def rewrite_queries(df: DataFrame, fn: Callable[[str], str], col: str = "query") -> DataFrame:
    """UDF-02: ``rewritten`` by ``fn``; an error, a non-text or a blank answer falls back to the original."""
    def one(q):
        try:
            out = fn(q)
        except Exception:
            return None
        return out.strip() or None if isinstance(out, str) and len(out) <= 300 else None

    @pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return df.withColumn("rewritten", F.coalesce(run(c(col)), c(col)))


def rerank(df: DataFrame, fn: Callable[[str, pd.DataFrame], list], n: int | None = None) -> DataFrame:
    """UDF-03: final order per query from ``fn(query, rows)``; ids left out are dropped, unknown ones ignored.

    The function sees all results of a query in order, so one query's results must fit a task;
    with ``n`` it sees the first ``n`` only and later ones follow unchanged.
    """
    def run(key, pdf):
        pdf = pdf.sort_values("rank")
        known = set(pdf["product_id"])
        order = list(dict.fromkeys(x for x in fn(key[0], pdf) if x in known))
        return pd.DataFrame({"query_id": key[0], "product_id": order, "rank": range(1, len(order) + 1)})

    ids = {x: df.schema[x].dataType.simpleString() for x in ("query_id", "product_id")}
    head = (df if n is None else df.filter(c("rank") <= n)).groupBy("query_id").applyInPandas(
        run, f"query_id {ids['query_id']}, product_id {ids['product_id']}, rank int")
    if n is None:
        return head
    return head.unionByName(df.filter(c("rank") > n).select("query_id", "product_id", c("rank").cast("int").alias("rank")))


def function_trial(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """UDF-04: the products a user function would change, with the changed columns; nothing is stored."""
    free = [x for x in df.columns if x not in PROTECTED]
    sign = lambda p: [F.sha2(F.coalesce(F.to_json(F.struct(x)), F.lit("")), 256).alias(f"{p}{x}") for x in free]
    new = transform_products(df, fn).select("id", *sign("_n_"))
    old = df.select("id", *sign("_o_"))
    changed = F.array_compact(F.array(*[F.when(c(f"_n_{x}") != c(f"_o_{x}"), F.lit(x)) for x in free]))
    return old.join(new, "id").select("id", changed.alias("changed")).filter(F.size("changed") > 0)
