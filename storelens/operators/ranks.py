"""Global row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def global_rank(df: DataFrame, order: list[Column], bucket: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rn``, the 0-based position in the total order (of each ``by`` group).

    ``bucket`` must not decrease along the order; rows are numbered inside their
    bucket and shifted by the size of all earlier buckets, so only the bucket
    sizes (one row per bucket) are ordered as a whole, and a group holding most
    rows is numbered by many tasks.
    """
    keys = [*by, "_b"]
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(shift, keys).withColumn("rn", F.col("_off") + F.row_number().over(inside) - 1).drop("_b", "_off")


RANK_BUCKET = 10_000


def rank_bucket(rank: Column) -> Column:
    """Bucket of an existing rank, for re-ranking."""
    return F.floor(rank / RANK_BUCKET)


def systematic_sample(df: DataFrame, n: int, order: list[Column], bucket: Column) -> DataFrame:
    """SRC-11: every floor(N / n)-th row of the order, at most ``n`` rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    step = F.greatest(F.lit(1), F.floor(total / n))
    return global_rank(df, order, bucket).withColumn("_step", step).filter(
        (F.col("rn") % F.col("_step") == 0) & (F.col("rn") < F.col("_step") * n)).drop("rn", "_step")


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """SRC-10: ``n`` random rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def category_cover_sample(df: DataFrame, order: str, cover: int = 50, head: int = 30) -> DataFrame:
    """SRC-12: the first products that bring an unseen category, plus the first products."""
    first = df.select(F.explode("categories").alias("c"), F.col(order).alias("_o")).groupBy("c").agg(F.min("_o").alias("_o"))
    covering = first.select("_o").distinct().orderBy("_o").limit(cover)
    leading = df.select(F.col(order).alias("_o")).orderBy("_o").limit(head)
    keep = covering.union(leading).distinct()
    return df.join(keep, df[order] == keep["_o"], "left_semi")


def page_offset(df: DataFrame, page: int, size: int, order: list[Column]) -> DataFrame:
    """SRT-03: one page of a total order, each row with the number of all rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.withColumn("total", total).orderBy(*order).offset((page - 1) * size).limit(size)


def result_pages(results: DataFrame, size: int) -> DataFrame:
    """SRT-04: ranked results with the number of the chunk they are stored in."""
    return results.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int"))


def latest_record(df: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """WIN-06: the last record per key, with its number of copies and whether their content differs."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r"),
                               F.count("*").alias("copies"), (F.min(content) != F.max(content)).alias("changed")).select(
        key, "_r.*", "copies", "changed")


def absent(prev: DataFrame, cur: DataFrame, key: str = "id") -> DataFrame:
    """SET-05: keys that are no longer present."""
    return prev.select(key).join(cur.select(key), key, "left_anti")


def membership_stable(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """SET-04: whether two reads hold the same set of keys (one row)."""
    a, b = before.select(key), after.select(key)
    return a.exceptAll(b).select(F.lit(1).alias("gone"), F.lit(0).alias("new")).unionByName(
        b.exceptAll(a).select(F.lit(0).alias("gone"), F.lit(1).alias("new"))).agg(
        F.coalesce(F.sum("gone"), F.lit(0)).alias("gone"), F.coalesce(F.sum("new"), F.lit(0)).alias("new")).withColumn(
        "stable", (F.col("gone") == 0) & (F.col("new") == 0))
