"""Streams give what the batch jobs give."""

import datetime as dt

from pyspark.sql import functions as F

from storelens.operators import attribution as A
from storelens.streaming import jobs as J

T0 = dt.datetime(2026, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def run(df, tmp_path, name):
    q = (df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append")
         .trigger(availableNow=True).start(str(tmp_path / name)))
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_stream_attribution_equals_batch(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", at(0), "x"), (2, "a", at(5), "y"), (3, "a", at(5), "z"), (4, "b", at(0), "w")], "event_id long, s string, t timestamp, q string")
    e = spark.createDataFrame([(10, "a", at(6)), (11, "a", at(40)), (12, "b", at(29)), (13, "c", at(1)), (14, "z", at(5000))], "event_id long, s string, t timestamp")
    s.unionByName(spark.createDataFrame([(99, "zz", at(9000), "end")], s.schema)).coalesce(1).write.parquet(str(tmp_path / "s"))
    e.unionByName(spark.createDataFrame([(999, "zz", at(9000))], e.schema)).coalesce(1).write.parquet(str(tmp_path / "e"))
    rs = lambda n, sch: spark.readStream.schema(sch).parquet(str(tmp_path / n))
    out = run(J.stream_attribute(rs("e", e.schema), rs("s", s.schema), "click", "1 minute"), tmp_path, "out")
    got = {r["event_id"]: r["hit_q"] for r in out.collect() if r["event_id"] < 100}
    batch = A.preceding_search(e.withColumn("kind", F.lit("click")), s)
    assert got == {r["event_id"]: r["hit_q"] for r in batch.collect()} and got[10] == "y" and got[11] is None


def test_stream_unique_orders(spark, tmp_path):
    p = spark.createDataFrame([(1, "o", at(0)), (2, "o", at(5)), (3, None, at(1)), (4, None, at(2))], "event_id long, order_id string, t timestamp")
    p.coalesce(1).write.parquet(str(tmp_path / "p"))
    out = run(J.stream_unique_orders(spark.readStream.schema(p.schema).parquet(str(tmp_path / "p"))), tmp_path, "o")
    assert sorted(r["order_id"] or "" for r in out.collect()) == ["", "", "o"]


def test_hot_and_missing_sessions_over_many_batches(spark, tmp_path):
    import random

    rng = random.Random(3)
    who = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    s = [(i, who(), at(rng.randrange(600) / 2), f"q{i}") for i in range(300)] + [(9000, "end", at(9000), "end")]
    e = [(i, who(), at(rng.randrange(600) / 2)) for i in range(300)] + [(9001, "end", at(9000))]
    for name, rows, schema in (("s", s, "event_id long, s string, t timestamp, q string"), ("e", e, "event_id long, s string, t timestamp")):
        rows = sorted(rows, key=lambda r: r[2])
        for k in range(0, len(rows), 60):
            spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda n, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    out = run(J.stream_attribute(stream("e", "event_id long, s string, t timestamp"), stream("s", "event_id long, s string, t timestamp, q string"), "click", "30 days"), tmp_path, "o")
    assert out.filter("event_id < 9000").count() == sum(r[1] is None for r in e)  # the watermark has passed none with a session
    out = run(J.stream_attribute(stream("e", "event_id long, s string, t timestamp"), stream("s", "event_id long, s string, t timestamp, q string"), "click", "5 hours"), tmp_path, "o2")
    got = {r["event_id"]: (r["hit_q"], r["hit_t"]) for r in out.collect() if r["event_id"] < 9000}
    frame = spark.createDataFrame(e, "event_id long, s string, t timestamp").withColumn("kind", F.lit("click"))
    want = A.preceding_search(frame, spark.createDataFrame(s, "event_id long, s string, t timestamp, q string"))
    assert got == {r["event_id"]: (r["hit_q"], r["hit_t"]) for r in want.collect() if r["event_id"] < 9000}


def test_sessions_share_state_keys(spark, tmp_path):
    """Every (session, two hours) was a key of its own, with its calls to the store and its timer."""
    s = spark.range(600).select("id", F.concat(F.lit("s"), F.col("id")).alias("s"), F.lit(at(10)).alias("t"), F.lit("q").alias("q")).withColumnRenamed("id", "event_id")
    e = s.select("event_id", "s", F.lit(at(11)).alias("t"))
    s.unionByName(spark.createDataFrame([(9000, "end", at(9000), "end")], s.schema)).coalesce(1).write.parquet(str(tmp_path / "s"))
    e.unionByName(spark.createDataFrame([(9001, "end", at(9000))], e.schema)).coalesce(1).write.parquet(str(tmp_path / "e"))
    rs = lambda n, sch: spark.readStream.schema(sch).parquet(str(tmp_path / n))
    df = J.stream_attribute(rs("e", e.schema), rs("s", s.schema), "cart", "1 minute")
    q = (df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")))
    q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(str(tmp_path / "o"))
    assert out.filter("event_id < 9000 and hit_q = 'q'").count() == 600
    assert sum(o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"]) < 100


FEED = "id string, title string, price double, published boolean, feed bigint, end_rows bigint"


def test_feeds_in_pieces(spark, tmp_path):
    cards = spark.createDataFrame([(f"c{i}", f"t{i}", 1.0, False, False) for i in range(4)], "id string, title string, price double, hidden boolean, feed_hidden boolean")
    log = J.CatalogLog(spark, str(tmp_path / "cards"), compact=2)
    log.create(cards)
    row = lambda feed, i, price=1.0: (f"c{i}", f"t{i}", price, True, feed, None)
    end = lambda feed, n: (None, None, None, None, feed, n)
    state = lambda: {r["id"]: (r["price"], r["hidden"]) for r in log.cards().collect()}
    same = {f"c{i}": (1.0, False) for i in range(4)}
    batches = [([row(1, 0, 2.0), row(1, 1)], same), ([end(1, 3), row(2, 0)], same),  # neither feed is whole, nothing is hidden
               ([row(1, 2), row(1, 2)], {"c0": (2.0, False), "c1": (1.0, False), "c2": (1.0, False), "c3": (1.0, True)}),
               ([row(4, 3), end(4, 2)], None), ([end(2, 1)], {"c0": (1.0, False), "c1": (1.0, True), "c2": (1.0, True), "c3": (1.0, True)}),
               ([row(4, 0)], {"c0": (1.0, False), "c1": (1.0, True), "c2": (1.0, True), "c3": (1.0, False)})]
    for epoch, (rows, want) in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            log.apply(spark.createDataFrame(rows, FEED), epoch)
            assert want is None or state() == want, epoch
    assert {(r["feed"], r["id"], r["outcome"]) for r in log.changes().collect()} == {
        (1, "c0", "updated"), (1, "c3", "removed"), (2, "c0", "updated"), (2, "c1", "removed"), (2, "c2", "removed"), (4, "c3", "restored")}
    assert log._done("snapshot") == [-1, 2] and log._done("full") == [] and log._done("staged") == [5]
