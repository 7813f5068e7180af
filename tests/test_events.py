"""Raw events, attribution and funnels on the small cases of FIXTURES.md."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storelens.functions.numbers import parse_event_time, parse_number, two_proportion_z, wilson
from storelens.operators import attribution as A, classify as C, events as E, funnel as U

T0 = dt.datetime(2026, 9, 10, 10, tzinfo=dt.timezone.utc)
at = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
RAW = "event_id long, event_type string, query string, search_query string, session_id string, timestamp string, product_id string, order_id string, order_total string, currency string, status string, zero_results boolean"


def raw(spark, rows):
    names = [f.split()[0] for f in RAW.split(", ")]
    return spark.createDataFrame([tuple({**{"event_id": i}, **r}.get(n) for n in names) for i, r in enumerate(rows)], RAW)


def bundle(spark, searches=(), clicks=(), carts=(), checkouts=(), missing=()):
    present = spark.createDataFrame([(s, 1, False) for s in ("queries", "product_clicks", "cart", "checkout_events") if s not in missing] or [("x", 0, False)],
                                    "source string, rows long, truncated boolean")
    c = raw(spark, checkouts)
    return U.Events(E.to_query_events(raw(spark, searches)), E.to_product_events(raw(spark, clicks), "click"),
                    E.to_product_events(raw(spark, carts), "cart"), E.to_checkout_starts(c), E.to_purchase_events(c),
                    E.source_status(present, ["queries", "product_clicks", "cart", "checkout_events"]))


def by_query(df):
    return {r["query"]: r for r in df.collect()}


def test_times(spark):
    rows = ["2026-09-10T10:00:00Z", "2026-09-10T10:00:00+00:00", "1789034400", "1789034400000", "junk", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(F.unix_seconds(parse_event_time(F.col("t")))).collect()]
    assert got == [1789034400] * 4 + [None] * 3


def test_a_time_is_worked_out_once(spark):
    """A raw field that is an expression was repeated up to ten times in the plan of its time."""
    rows = spark.createDataFrame([("2026-09-10", "T10:00:00Z"), ("17890", "00000"), ("1789000000", "123"), (" ", "x"), ("99999999", ""), ("999999999999", ""), (None, "1")], "a string, b string")
    got = rows.select(F.unix_millis(parse_event_time(F.concat("a", "b"))).alias("t"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("concat(") == 1
    assert [r["t"] for r in got.collect()] == [1789034400000, 1789000000000, 1789000000123, None, None, 999999999999000, None]


def test_numbers(spark):
    rows = [("614",), ("679.20",), ("1,250.50",), ("x",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(parse_number(F.col("x"))).collect()] == [614.0, 679.2, 1250.5, None, None]


def test_purchase_rule(spark):
    rows = [{"event_type": "checkout_initiated", "order_id": "1"}, {"event_type": "checkout_completed"},
            {"order_id": "2", "status": "refunded", "order_total": "5"}, {"order_id": "3", "status": "paid", "order_total": "5"}, {"order_total": "5"}]
    df = raw(spark, rows)
    assert [r[0] for r in df.orderBy("event_id").select(E.is_purchase(df)).collect()] == [False, True, False, True, False]


def test_empty_tag_does_not_fall_through(spark):
    df = spark.createDataFrame([("", "red"), (None, "Red  Wine "), ("direct", "red")], "search_query string, normalized_query string")
    assert [r[0] for r in df.select(E.explicit_query(df)).collect()] == ["", "red wine", ""]


def funnel_case(spark):
    s = lambda q, who, m, **k: {"query": q, "session_id": who, "timestamp": at(m), **k}
    searches = [s("Red Wine", "a", 0), s("red  wine", "a", 1), s("red wine", "b", 0), s("gin", "c", 0, zero_results=True)]
    clicks = [{"session_id": "a", "timestamp": at(3), "product_id": "1"}, {"session_id": "b", "timestamp": at(3), "search_query": "red wine", "product_id": "1"}]
    carts = [{"session_id": "a", "timestamp": at(10), "product_id": "1"}]
    orders = [{"event_type": "checkout_initiated", "session_id": "a", "timestamp": at(20)},
              {"event_type": "checkout_completed", "session_id": "a", "timestamp": at(60), "order_id": "o1", "order_total": "120", "currency": "ILS"}]
    return bundle(spark, searches, clicks, carts, orders)


def test_funnel(spark):
    ev = funnel_case(spark)
    rows = by_query(U.query_funnel(ev))
    wine = rows["red wine"]
    assert (wine["searches"], wine["search_sessions"], wine["click_sessions"], wine["purchases"], wine["inferred_purchases"]) == (3, 2, 2, 1, 1)
    assert wine["purchase_rate"] == 0.5 and wine["attributed_revenue"][0]["amount"] == 120 and rows["gin"]["zero_rate"] == 1
    one = U.store_funnel(ev).first()
    assert [one[c] for c in ("sessions", "searched", "clicked", "carted", "checkout", "purchased")] == [3, 3, 2, 1, 1, 1]


def test_click_outside_window_and_missing_session(spark):
    ev = bundle(spark, [{"query": "x", "session_id": "a", "timestamp": at(0)}, {"query": "x", "timestamp": at(0)}],
                [{"session_id": "a", "timestamp": at(90), "product_id": "1"}])
    r = by_query(U.query_funnel(ev))["x"]
    assert (r["clicks"], r["missing_session"], r["purchase_rate"]) == (0, 1, None)
    assert by_query(U.query_funnel(ev, A.WINDOWS_24H))["x"]["clicks"] == 1


def test_orders_without_session_and_duplicates(spark):
    orders = [{"event_type": "checkout_completed", "search_query": "x", "timestamp": at(i), "order_id": str(i // 2)} for i in range(20)]
    ev = bundle(spark, [{"query": "x", "session_id": "a", "timestamp": at(0)}], (), (), orders)
    r = by_query(U.query_funnel(ev))["x"]
    assert r["purchases"] == 10 and r["purchase_rate"] == 0
    assert U.order_assistance(ev).first()["duplicates"] == 10


def test_coverage_gate_nulls_rates_but_keeps_counts(spark):
    searches = [{"query": "x", "session_id": "a" if i < 4 else None, "timestamp": at(i)} for i in range(10)]
    ev = bundle(spark, searches, [{"session_id": "a", "timestamp": at(5), "product_id": "1"}])
    r = by_query(U.measured_conversion(ev)[1])["x"]
    assert r["searches"] == 10 and r["clicks"] == 1 and r["click_rate"] is None


def test_failed_source_counts_no_rows(spark):
    present = spark.createDataFrame([("a", 5, True), ("b", 7, False)], "source string, rows long, truncated boolean")
    got = {r["source"]: (r["status"], r["rows"], r["truncated"]) for r in E.source_status(present, ["a", "b", "c"], failed=("b",)).collect()}
    assert got == {"a": ("ok", 5, True), "b": ("unavailable", 0, False), "c": ("missing", 0, False)}


def test_leaks_and_synthetic(spark):
    searches, clicks, carts, n = [], [], [], 0
    for q, sessions, clicked in (("good", 40, 20), ("ignored", 40, 1), ("top it", 300, 0)):
        for i in range(sessions):
            searches.append({"query": q, "session_id": f"{q}{i}", "timestamp": at(0)})
            if i < clicked:
                clicks.append({"session_id": f"{q}{i}", "timestamp": at(1), "product_id": "1"})
    ev = bundle(spark, searches, clicks)
    bad = C.suspected_synthetic(U.query_funnel(ev), ev.searches)
    assert [r["query"] for r in bad.collect()] == ["top it"]
    clean = C.exclude_synthetic(ev, bad)
    rows = by_query(C.classify_leaks(U.query_funnel(clean), U.store_funnel(clean), U.coverage(clean)))
    assert rows["ignored"]["leak_stage"] == "no_click" and rows["good"]["leak_stage"] == "healthy"


def test_local_days(spark):
    orders = [{"event_type": "checkout_completed", "timestamp": "2026-10-18T22:40:00Z", "order_id": "1", "order_total": "1"}] * 2
    ev = bundle(spark, [{"query": "a", "timestamp": "2026-10-18T20:30:00Z"}, {"query": "a", "timestamp": "2026-10-18T22:30:00Z"}], (), (), orders)
    got = {r["day"]: (r["searches"], r["purchases"]) for r in U.daily_activity(ev).collect()}
    assert got == {"2026-10-18": (1, 0), "2026-10-19": (1, 1)}


def brute_as_of(events, searches, tolerance):
    out = {}
    for e in events:
        c = [s for s in searches if s[1] is not None and s[1] == e[1] and s[2] <= e[2] and (e[2] - s[2]).total_seconds() * 1e6 <= tolerance]
        out[e[0]] = max(c, key=lambda s: (s[2], -s[0]))[0] if c else None
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_as_of_matches_brute_force_with_a_hot_session(spark, parts):
    rng = random.Random(5)
    pick = lambda: rng.choice(["hot", "hot", "b", "c", None])
    t = lambda: T0 + dt.timedelta(minutes=rng.randrange(0, 3000))
    searches = [(i, pick(), t(), "q") for i in range(300)]
    events = [(i, pick(), t()) for i in range(300)]
    s = spark.createDataFrame(searches, "event_id long, s string, t timestamp, q string").repartition(parts)
    e = spark.createDataFrame(events, "event_id long, s string, t timestamp").repartition(parts)
    tol = 120 * A.MINUTE_US
    got = {r["event_id"]: r["i"] for r in A.as_of(e, s, ["s"], F.lit(tol), ["event_id"]).select("event_id", F.col("hit.event_id").alias("i")).collect()}
    assert got == brute_as_of(events, searches, tol)


def test_statistics(spark):
    z = spark.createDataFrame([(30, 1000, 30, 1000), (33, 1000, 30, 1000), (60, 1000, 30, 1000), (1, 0, 1, 5)], "a int, n int, b int, m int")
    rows = [r[0] for r in z.select(two_proportion_z(*[F.col(c) for c in "anbm"])).collect()]
    assert not rows[0]["significant"] and abs(rows[1]["lift"] - 0.1) < 1e-9 and not rows[1]["significant"]
    assert rows[2]["lift"] == 1 and rows[2]["z"] > 3 and rows[3] is None
    w = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int").select(wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert abs(w[0]["w"]["lo"]) < 1e-12 and abs(w[1]["w"]["hi"] - 1) < 1e-12 and w[2]["w"] is None


def test_window_validation(spark):
    df = spark.createDataFrame([(T0,)], "t timestamp")
    assert E.in_window(df, "2026-09-10", "2026-09-11").count() == 1
    for bad in (("2026-09-11", "2026-09-10"), ("2026-01-01", "2026-09-11")):
        with pytest.raises(ValueError):
            E.in_window(df, *bad, max_days=90)
    assert E.in_window(df, "2026-01-01", "2026-09-11").count() == 1


@pytest.mark.parametrize("bucket", [A.BUCKET_US, 60 * A.MINUTE_US])
def test_attributed_stages_match_brute_force_with_a_hot_session(spark, bucket):
    rng = random.Random(6)
    who, what = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None]), lambda: rng.choice(["x", "y", "z"])
    t = lambda: T0 + dt.timedelta(minutes=rng.randrange(0, 2500))
    searches = [(i, who(), t(), what()) for i in range(250)]
    stages = [(i, rng.choice(["click", "cart", "checkout", "purchase"]), rng.choice(["", what()]), who(), t()) for i in range(400)]
    s = spark.createDataFrame(searches, "event_id long, s string, t timestamp, q string")
    e = spark.createDataFrame(stages, "event_id long, kind string, q string, s string, t timestamp")
    got = {r["event_id"]: r for r in A.attributed_stages(e, s, bucket_us=bucket).collect()}
    assert len(got) == 400
    of = {i: (q, at_) for i, _, at_, q in searches}
    for i, kind, q, sess, at_ in stages:
        hit = brute_as_of([(i, sess, at_)], searches, A.WINDOWS[kind])[i]
        own = brute_as_of([(i, sess, at_)], [x for x in searches if x[3] == q], A.WINDOWS[kind])[i]
        r = got[i]
        assert (r["hit_q"], r["hit_t"] and r["hit_t"].timestamp()) == ((None, None) if hit is None else (of[hit][0], of[hit][1].timestamp()))
        assert r["aq"] == (q or r["hit_q"]) and r["how"] == ("explicit" if q else "inferred" if hit is not None else None)
        assert r["searched"] == ((own if q else hit) is not None)


def test_a_bundle_attributes_once(spark):
    ev = bundle(spark, [{"query": "gin", "session_id": "a", "timestamp": at(0)}], [{"session_id": "a", "timestamp": at(1), "product_id": "p"}])
    assert ev.attributed() is ev.attributed() and ev.attributed() is not ev.attributed(A.WINDOWS_24H)
    assert [r["aq"] for r in ev.attributed().collect()] == ["gin"]
    without = ev.with_searches(ev.searches.filter("q <> 'gin'"))
    assert [r["aq"] for r in without.attributed().collect()] == [None] and [r["aq"] for r in ev.attributed().collect()] == ["gin"]
    plan = U.query_funnel(ev)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 8 and "Window" not in plan
