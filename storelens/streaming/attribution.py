"""STR-04: which search an event belongs to, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storelens.operators.attribution import WINDOWS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "event_id bigint, et timestamp, hit_q string, hit_t timestamp"
SLOTS = 16
ROWS = pa.schema([("s", pa.string()), ("side", pa.int32()), ("us", pa.int64()), ("event_id", pa.int64()), ("q", pa.string())])


class LastSearch(StatefulProcessor):
    """One (slot, bucket): the sessions of a slot, the bucket as long as the window.

    State: the events that the watermark has not passed and, per session, the searches from the last one before
    the watermark on, as no older one can be the latest. An event is settled when the watermark has
    passed it; the key is cleared when it has passed the bucket. So a key holds what arrives within the
    lateness, however long a session goes on. Rows come and go as Arrow batches, a state row each: calls
    to the store are per key and batch, not per row or session.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "body binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int, held: int | None) -> None:
        """One timer a key."""
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, bodies = ((int(key[1]) + 1) * self.window_us) // 1000 + 1, []
        for frame in rows:
            body = pa.RecordBatch.from_pandas(frame[ROWS.names], schema=ROWS, preserve_index=False)
            bodies.append((body.serialize().to_pybytes(),))
            events = frame["us"].to_numpy()[frame["side"].to_numpy() == 1]
            if len(events):
                at = min(at, int(events.min()) // 1000 + 1)
        self.rows.appendList(bodies)
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            self._wake(at, held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = int(key[1]) * self.window_us
        now = timerValues.getCurrentWatermarkInMs() * 1000
        table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(r[0])), ROWS) for r in self.rows.get()], schema=ROWS)
        who = table.column("s").combine_chunks().dictionary_encode().indices.to_numpy()
        side, us, ids = (table.column(k).to_numpy() for k in ("side", "us", "event_id"))
        # searches before events of the same instant; of such searches the one with the smallest id is last
        order = np.lexsort((np.where(side == 0, -ids, ids), side, us, who))
        at = np.arange(len(order))
        last = np.maximum.accumulate(np.where(side[order] == 0, at, -1))
        done = (side[order] == 1) & (us[order] < now)
        event, hit = order[done], order[last[done]]
        found = (last[done] >= 0) & (who[hit] == who[event]) & (us[event] - us[hit] <= self.window_us)
        past = (side[order] == 0) & (us[order] < max(now, start))
        # a past search stays if the next one of its session is not past, or if there is none
        later = np.minimum.accumulate(np.where(side[order] == 0, at, len(at))[::-1])[::-1]
        follows = np.append(later[1:], len(at))[: len(at)]
        there = follows < len(at)
        nearest = np.minimum(follows, len(at) - 1)
        follows_past = there & (who[order][nearest] == who[order]) & past[nearest]
        open_ = order[(side[order] == 1) & (us[order] >= now)]
        if now > start + self.window_us and not len(open_):
            self.rows.clear()
            self.timer.clear()
        else:
            stay = np.sort(order[((side[order] == 1) & (us[order] >= now)) | ((side[order] == 0) & ~(past & follows_past))])
            kept = table.take(pa.array(stay)).combine_chunks().to_batches()
            self.rows.clear()
            if kept:
                self.rows.put([(b.serialize().to_pybytes(),) for b in kept])
            end = start + self.window_us
            self._wake(int(us[open_].min() if len(open_) else end) // 1000 + 1, None)
        if len(event):
            q, us_hit = table.column("q").take(pa.array(np.where(found, hit, 0))).to_pandas().to_numpy(dtype=object), us[hit].astype("datetime64[us]")
            yield pd.DataFrame({"event_id": ids[event], "et": us[event].astype("datetime64[us]"), "hit_q": pd.Series(np.where(found, q, None), dtype=object),
                                "hit_t": np.where(found, us_hit, np.datetime64("NaT", "us"))})

    def close(self) -> None:
        pass


def stream_attribute(events: DataFrame, searches: DataFrame, stage: str, lateness: str = "1 hour", slots: int = SLOTS) -> DataFrame:
    """STR-04: each event with the latest search of its session in the stage window, or null.

    Both streams are dealt by (slot, bucket), the slot a hash of the session, a search to its own bucket and to the
    next. A live stream has about four buckets open, so ``slots`` bounds how many tasks share them. Among
    searches at the same instant the smallest id wins, as in the batch job. An event comes out when the
    watermark, the older one of both streams, has passed it. Events without a session pass by
    without state. The session's state store becomes RocksDB, which this needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    w = WINDOWS[stage]
    e = events.withWatermark("t", lateness)
    us, bucket = F.unix_micros("t"), F.floor(F.unix_micros("t") / w)
    slot = F.pmod(F.xxhash64("s"), F.lit(slots)).cast("int").alias("slot")
    rows = e.filter("s is not null").select(slot, bucket.alias("b"), "s", F.lit(1).alias("side"), "event_id", us.alias("us"), F.lit(None).cast("string").alias("q"), "t")
    asked = searches.withWatermark("t", lateness).filter("s is not null").select(
        slot, F.explode(F.array(bucket, bucket + 1)).alias("b"), "s", F.lit(0).alias("side"), "event_id", us.alias("us"), "q", "t")
    keyed = rows.unionByName(asked).groupBy("slot", "b")
    found = keyed.transformWithStateInPandas(LastSearch(w), OUT, "append", "eventTime")
    none = e.filter("s is null").select("event_id", F.col("t").alias("et"), F.lit(None).cast("string").alias("hit_q"), F.lit(None).cast("timestamp").alias("hit_t"))
    return found.unionByName(none)
