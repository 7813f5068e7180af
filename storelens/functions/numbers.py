"""Numbers, money, time and statistics columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z95 = 1.95996398454  # Fixed value: the normal quantile of the 95 % interval.


def parse_number(x: Column) -> Column:
    """PRJ-03: number from text with thousands commas; null when not a number."""
    n = F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def money(x: Column) -> Column:
    """Half-up rounding to two places."""
    return F.floor(x * 100 + 0.5) / 100


def ratio(n: Column, d: Column) -> Column:
    """n / d, null on an empty denominator."""
    return F.when(d > 0, n / d)


def minor_units(price: Column, unit: Column) -> Column:
    """FN-10: price in minor units to a decimal price; two digits unless stated."""
    return price.try_cast("double") / F.pow(F.lit(10.0), F.coalesce(unit, F.lit(2)))


def parse_event_time(x: Column) -> Column:
    """PRJ-01: ISO text, epoch seconds or epoch milliseconds (9-13 digits) to a timestamp, else null.

    The text and its number are variables of a function, so that ``x`` is worked out once however long its expression is.
    """
    def time(t: Column) -> Column:
        ms = lambda n: F.timestamp_millis(F.when(n < 1_000_000_000_000, n * 1000).otherwise(n))
        number = F.transform(F.array(t.try_cast("bigint")), ms)[0]
        return F.when(t.rlike("^\\d{9,13}$"), number).when(t.rlike("^\\d{4}-\\d{2}"), F.try_to_timestamp(t))

    return F.transform(F.array(F.trim(x)), time)[0]


def local_day(t: Column, tz: str) -> Column:
    """FN-30: calendar day (text) of an instant in a time zone."""
    return F.date_format(F.from_utc_timestamp(t, tz), "yyyy-MM-dd")


def week_start(t: Column) -> Column:
    """FN-28: Monday 00:00 UTC of the week."""
    return F.date_trunc("week", t)


def wilson(k: Column, n: Column) -> Column:
    """FN-24: Wilson 95 % interval as struct<lo, hi>, null when n = 0."""
    p, zz = k / n, Z95 * Z95
    d = F.lit(1.0) + F.lit(zz) / n
    c = (p + F.lit(zz) / (n * 2)) / d
    h = F.lit(Z95) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(zz) / (n * 4 * n)) / d
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), c - h).alias("lo"),
                                  F.least(F.lit(1.0), c + h).alias("hi")))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """FN-25: struct<lift, z, significant> of two conversion shares, null without both groups."""
    p1, p2 = x1 / n1, x2 / n2
    p = (x1 + x2) / (n1 + n2)
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.when(se > 0, (p1 - p2) / se)
    return F.when((n1 > 0) & (n2 > 0), F.struct(
        F.when(p2 > 0, (p1 - p2) / p2).alias("lift"), z.alias("z"),
        F.coalesce(F.abs(z) >= 1.96, F.lit(False)).alias("significant")))


def rollout_bucket(session: Column, buckets: int = 100) -> Column:
    """FN-27: stable bucket from the first eight hex digits of SHA-1."""
    return (F.conv(F.substring(F.sha1(session), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def fingerprint(*cols: Column) -> Column:
    """FN-26: SHA-256 over the canonical JSON of the given columns."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def cosine(a: Column, b: Column) -> Column:
    """FN-23: cosine of two equally long arrays; 0 when a norm is 0, error on a length mismatch."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
                                   F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double"))
