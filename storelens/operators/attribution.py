"""Which search an event belongs to (JOI-01..03, WIN-01..02, SET-01).

The as-of join is a windowed scan rather than a range join. One session may hold
a large share of all rows, so the scan is cut into time buckets: the last search
of every (key, bucket) is aggregated first, carried forward along the few buckets
of its key, and the row-level window then runs per (key, bucket) only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MINUTE_US = 60_000_000
# Attribution windows of the four stages, in microseconds.
WINDOWS = {"click": 30 * MINUTE_US, "cart": 120 * MINUTE_US, "checkout": 1440 * MINUTE_US, "purchase": 1440 * MINUTE_US}
WINDOWS_24H = {k: 1440 * MINUTE_US for k in WINDOWS}
BUCKET_US = 10 * MINUTE_US


def unique_purchases(purchases: DataFrame) -> DataFrame:
    """WIN-01: the earliest row per order id; rows without an id all stay.

    Adds ``copies``, the number of rows the kept one stands for.
    """
    blank = F.coalesce(F.col("order_id"), F.lit("")) == ""
    cols = purchases.columns
    first = (purchases.filter(~blank).groupBy(F.col("order_id").alias("_key"))
             .agg(F.min_by(F.struct(*cols), F.struct("t", "event_id")).alias("_r"), F.count("*").alias("copies"))
             .select("_r.*", "copies"))
    return first.unionByName(purchases.filter(blank).withColumn("copies", F.lit(1).cast("bigint")))


def as_of(events: DataFrame, searches: DataFrame, keys: list[str], tolerance: Column, values: list[str],
          bucket_us: int = BUCKET_US, max_tolerance_us: int | None = None) -> DataFrame:
    """Each event with ``hit`` = struct(t, values) of the latest search at or before it.

    Equal keys, ``tolerance`` (microseconds, inclusive, may differ per row) on the
    distance; ``max_tolerance_us``, if given, is a bound of it that lets older searches
    go early. Among searches at the same instant the smallest event id wins. Events
    with a null key keep a null hit and never enter a shuffle on the key.
    """
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    t_us = F.unix_micros("t")
    cols = events.columns
    side = lambda n: F.lit(n).cast("int").alias("_side")
    left = events.filter(has_key).select(
        *keys, t_us.alias("_us"), side(1), F.lit(0).cast("bigint").alias("_tie"),
        F.struct(*[F.col(c) for c in cols], tolerance.cast("bigint").alias("_tol")).alias("_e"))
    hit = F.struct("t", *values)
    right = searches.filter(has_key).select(
        *keys, t_us.alias("_us"), side(0), (-F.col("event_id")).alias("_tie"), hit.alias("_v"))
    bucket = F.floor(F.col("_us") / bucket_us).alias("_b")

    # Last search of each (key, bucket), and for every bucket with events the last one before it.
    last = right.select(*keys, bucket, "_us", "_tie", "_v").groupBy(*keys, "_b").agg(
        F.max(F.struct("_us", "_tie", "_v")).alias("_last"))
    wanted = left.select(*keys, bucket).distinct().withColumn("_want", F.lit(True))
    steps = last.withColumn("_want", F.lit(False)).unionByName(wanted, allowMissingColumns=True)
    steps = steps.groupBy(*keys, "_b").agg(F.max("_last").alias("_last"), F.max("_want").alias("_want"))
    recent = F.lit(True) if max_tolerance_us is None else F.col("_prev._us") >= F.col("_b") * bucket_us - max_tolerance_us
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (steps.withColumn("_prev", F.last("_last", ignorenulls=True).over(before))
             .filter(F.col("_want") & F.col("_prev").isNotNull() & recent)
             .select(*keys, "_b", F.col("_prev._us").alias("_us"), side(0), F.col("_prev._tie").alias("_tie"),
                     F.col("_prev._v").alias("_v")))

    frame = (left.withColumn("_b", bucket).unionByName(right.withColumn("_b", bucket), allowMissingColumns=True)
             .unionByName(carry, allowMissingColumns=True))
    upto = (Window.partitionBy(*keys, "_b").orderBy("_us", "_side", "_tie")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (frame.withColumn("_hit", F.last("_v", ignorenulls=True).over(upto)).filter(F.col("_side") == 1)
             .select("_e.*", "_us", "_hit"))
    near = F.col("_us") - F.unix_micros(F.col("_hit.t")) <= F.col("_tol")
    found = found.withColumn("hit", F.when(near, F.col("_hit"))).select(*cols, "hit")
    keyless = events.filter(~has_key)
    return found.unionByName(keyless.withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType)))


def stage_tolerance(windows: dict[str, int] = WINDOWS, kind: str = "kind") -> Column:
    """Per-row tolerance from the stage name."""
    return F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in windows.items()]).cast("bigint")


def preceding_search(events: DataFrame, searches: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """JOI-01: adds ``hit_q`` and ``hit_t`` of the latest search of the session within the stage window."""
    out = as_of(events, searches, ["s"], stage_tolerance(windows), ["q"], max_tolerance_us=max(windows.values()))
    return out.select(*events.columns, F.col("hit.q").alias("hit_q"), F.col("hit.t").alias("hit_t"))


def searched_before(events: DataFrame, searches: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """JOI-02: adds ``searched``: the session searched the event's query ``q`` within the stage window."""
    out = as_of(events, searches, ["s", "q"], stage_tolerance(windows), [], max_tolerance_us=max(windows.values()))
    return out.select(*events.columns, F.col("hit").isNotNull().alias("searched"))


def attributed_stages(stages: DataFrame, searches: DataFrame, windows: dict[str, int] = WINDOWS, bucket_us: int = BUCKET_US) -> DataFrame:
    """Every stage row with ``hit_q`` and ``hit_t`` (JOI-01) and ``aq``, ``how`` and ``searched`` (JOI-03), in one pass.

    Both searches a row needs, the session's latest and its latest with the row's own query, are
    among the searches of its (session, bucket) and two carried into it: the last of the session
    and the last of (session, query) in earlier buckets. Rows, searches and carried searches are
    dealt once, by (session, bucket), and read by two windows of that layout. Rows without a session
    pass by.
    """
    us, bucket, cols = F.unix_micros("t"), F.floor(F.unix_micros("t") / bucket_us), stages.columns
    side = lambda n: F.lit(n).cast("int").alias("_side")
    rows = stages.filter("s is not null").select("s", "q", us.alias("_us"), bucket.alias("_b"), side(1), F.lit(0).cast("bigint").alias("_tie"), F.struct(*cols).alias("_e"))
    asked = searches.filter("s is not null").select("s", "q", us.alias("_us"), bucket.alias("_b"), side(0), (-F.col("event_id")).alias("_tie"))

    either = lambda q: F.explode(F.array(F.lit(None).cast("string"), q)).alias("_q")
    last = asked.select("s", "_b", F.struct("_us", "_tie", "q").alias("_last"), F.lit(False).alias("_want"), either(F.col("q")))
    want = rows.select("s", "_b", F.lit(None).cast(last.schema["_last"].dataType).alias("_last"), F.lit(True).alias("_want"), either(F.nullif("q", F.lit("")))).distinct()
    steps = last.unionByName(want).groupBy("s", "_q", "_b").agg(F.max("_last").alias("_last"), F.max("_want").alias("_want"))
    before = Window.partitionBy("s", "_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (steps.withColumn("_prev", F.last("_last", ignorenulls=True).over(before))
               .filter(F.col("_want") & (F.col("_prev._us") >= F.col("_b") * bucket_us - max(windows.values())))
               .select("s", F.col("_prev.q").alias("q"), F.col("_prev._us").alias("_us"), "_b", side(0), F.col("_prev._tie").alias("_tie")))

    upto = lambda *keys: Window.partitionBy("s", "_b", *keys).orderBy("_us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col("_side") == 0, F.struct("_us", "q"))
    frame = rows.unionByName(asked, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    found = frame.withColumn("_any", F.last(seen, ignorenulls=True).over(upto())).withColumn("_own", F.last(seen, ignorenulls=True).over(upto("q")))
    found = found.filter("_side = 1").select("_us", "_e.*", "_any", "_own")
    near = lambda hit: F.coalesce(F.col("_us") - F.col(f"{hit}._us") <= stage_tolerance(windows), F.lit(False))
    found = found.select(*cols, F.when(near("_any"), F.col("_any.q")).alias("hit_q"), F.when(near("_any"), F.timestamp_micros("_any._us")).alias("hit_t"), near("_own").alias("_own"))
    none = stages.filter("s is null").select(*cols, F.lit(None).cast("string").alias("hit_q"), F.lit(None).cast("timestamp").alias("hit_t"), F.lit(False).alias("_own"))
    tagged, hit = F.col("q") != "", F.col("hit_q").isNotNull()
    return found.unionByName(none).select(
        *cols, "hit_q", "hit_t", F.when(tagged, F.col("q")).otherwise(F.col("hit_q")).alias("aq"),
        F.when(tagged, "explicit").when(hit, "inferred").alias("how"), F.when(tagged, F.col("_own")).otherwise(hit).alias("searched"))


def attribute(events: DataFrame, searches: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """JOI-03: adds ``aq`` (query), ``how`` (explicit / inferred / null) and ``searched``."""
    return attributed_stages(events, searches, windows).drop("hit_q", "hit_t")


def stage_events(clicks: DataFrame, carts: DataFrame, checkouts: DataFrame, purchases: DataFrame) -> DataFrame:
    """One long table of the four stages; purchases are expected to be unique already."""
    base = ["event_id", "kind", "q", "s", "t"]
    products = clicks.unionByName(carts).select(*base, "pid", "name", "url")
    starts = checkouts.withColumn("kind", F.lit("checkout")).select(*base)
    orders = purchases.withColumn("kind", F.lit("purchase"))
    orders = orders.select(*base, *[c for c in ("order_id", "total", "currency", "items", "copies") if c in purchases.columns])
    return products.unionByName(starts, allowMissingColumns=True).unionByName(orders, allowMissingColumns=True)


def all_sessions(*frames: DataFrame) -> DataFrame:
    """SET-01: distinct sessions over several event tables."""
    return reduce(lambda a, b: a.union(b), [f.select("s") for f in frames]).filter("s is not null").distinct()
