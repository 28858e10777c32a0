"""Structured Streaming jobs over the append-only event log.

Watermarks and late data are this library's own policy: an event may be late by the watermark; a later one
is dropped. Windows and sessions are emitted once the watermark passes their end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timelode.functions.scalars import is_blank, java_trim
from timelode.operators.catalog import sync_channel_catalog
from timelode.operators.sinks import BucketedTable

EVENT_SCHEMA = "event_id bigint, item_id bigint, run_id bigint, event_type string, phase string, attempt int, occurred_at timestamp"


def _watermarked(events: DataFrame, watermark: str | None) -> DataFrame:
    """None: the stream has its watermark already, as that of `stream_events`, and a second one is not allowed."""
    return events if watermark is None else events.withWatermark("occurred_at", watermark)


def stream_events(spark: SparkSession, path: str, watermark: str = "1 hour", schema: str = EVENT_SCHEMA) -> DataFrame:
    """The event log as a stream, each event id once within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["event_id"])


class LateRows(StreamingQueryListener):
    """Counts, per micro-batch of the streams of a session, of rows read and of rows that were behind the watermark and dropped.

    To be added by `spark.streams.addListener`. A stateful operator counts what it drops; behind a grouping those are
    groups. Of a stream from `stream_events`, the operator that keeps each event once sees the rows themselves first.
    """

    def __init__(self) -> None:
        super().__init__()
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "watermark": p.eventTime.get("watermark"), "dropped": [o.numRowsDroppedByWatermark for o in p.stateOperators], "observed": {k: v.asDict() for k, v in p.observedMetrics.items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def dropped(self, run: str | None = None) -> int:
        """Rows dropped over all batches (of one run of a stream)."""
        return sum(sum(b["dropped"]) for b in self.batches if run in (None, b["run"]))


def observed_events(events: DataFrame, name: str = "events") -> DataFrame:
    """The stream with the number and the earliest and latest time of its rows as metrics of each batch."""
    return events.observe(name, F.count("*").alias("n"), F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest"))


def stream_phase_durations(events: DataFrame, max_gap: str = "6 hours", watermark: str | None = "1 hour") -> DataFrame:
    """Pairs of an entry and an end of a phase in the same attempt, with their milliseconds.

    Every pair within `max_gap` is emitted; the batch lanes take the first entry and the last end instead.
    """
    of = _watermarked(events, watermark)
    entered = of.filter("event_type = 'ITEM_PHASE_ENTERED'").select(F.col("item_id").alias("i"), F.col("attempt").alias("a"), F.col("phase").alias("p"), F.col("occurred_at").alias("entered_at"))
    ended = of.filter("event_type = 'ITEM_PHASE_COMPLETED'").select("item_id", "attempt", "phase", F.col("occurred_at").alias("completed_at"))
    joined = entered.join(ended, F.expr(f"i = item_id AND a = attempt AND p = phase AND completed_at >= entered_at AND completed_at <= entered_at + INTERVAL {max_gap}"))
    return joined.select("item_id", "attempt", "phase", "entered_at", "completed_at", (F.unix_millis("completed_at") - F.unix_millis("entered_at")).alias("millis"))


def stream_event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, session_gap: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """Event counts per window and type, or with `session_gap` per session of an item."""
    of = _watermarked(events, watermark)
    if session_gap:
        counted = of.groupBy("item_id", F.session_window("occurred_at", session_gap).alias("w")).agg(F.count("*").alias("n"))
        return counted.select("item_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    counted = of.groupBy("event_type", F.window("occurred_at", window, slide or window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep the state of `stream_run_status` and `stream_stuck_items` in RocksDB, as Avro rows that may gain fields between restarts.

    The settings hold for a stream from its start; other streams of the session, of which Avro is not for all, keep their own.
    """
    wanted = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "encodingFormat": "avro"}
    old = {k: spark.conf.get(f"spark.sql.streaming.stateStore.{k}") for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)


#: Statuses that count in a roll-up, in the order of the tally.
TALLIED = ("live", "FAILED", "CANCELLED", "COMPLETED")
TALLIES = "run_id {}, shard int, n_live bigint, n_failed bigint, n_cancelled bigint, n_completed bigint"


class _RunTally(StatefulProcessor):
    """State of a shard of a run: the newest event of each item, and how many items stand in each status."""

    def __init__(self, item_type: str):
        self.item_type = item_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", f"item_id {self.item_type}", "micros bigint, event_id bigint, status int")
        self.tally = handle.getValueState("tally", "n_live bigint, n_failed bigint, n_cancelled bigint, n_completed bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict = {}
        for frame in rows:
            for item, micros, event, status in zip(frame["item_id"].tolist(), frame["micros"].tolist(), frame["event_id"].tolist(), frame["status"].tolist(), strict=True):
                newest[item] = max(newest.get(item, (-1, -1, 0)), (micros, event, status))
        tally = list(self.tally.get() or (0, 0, 0, 0))
        before = list(tally)
        for item, state in newest.items():
            old = self.items.getValue((item,)) if self.items.containsKey((item,)) else None
            if old is not None and tuple(old[:2]) >= state[:2]:
                continue
            if old is not None:
                tally[old[2]] -= 1
            tally[state[2]] += 1
            self.items.updateValue((item,), state)
        self.tally.update(tuple(tally))
        if tally != before:
            yield pd.DataFrame([[*key, *tally]], columns=["run_id", "shard", "n_live", "n_failed", "n_cancelled", "n_completed"])

    def close(self) -> None:
        pass


def stream_run_status(events: DataFrame, shards: int = 8) -> DataFrame:
    """A row (run_id, shard, numbers of items by status) for each shard of a run whose numbers a micro-batch changes; no other run is read or written.

    The newest event of an item tells its status, ties by event id, whatever the order of arrival. A run's items are
    dealt to shards by their hash, so a run with most of the items is no single key. To be written in update mode,
    as by `run_status_batch`; `runs_of` adds up the shards.
    """
    kind = F.col("event_type")
    status = F.when(kind == "ITEM_FAILED", 1).when(kind == "ITEM_CANCELLED", 2).when(kind == "ITEM_COMPLETED", 3).otherwise(0)
    rows = events.select("run_id", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "item_id", F.unix_micros("occurred_at").alias("micros"), F.col("event_id").cast("bigint").alias("event_id"), status.alias("status"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("run_id", "item_id")}
    return rows.groupBy("run_id", "shard").transformWithStateInPandas(_RunTally(types["item_id"]), TALLIES.format(types["run_id"]), "Update", "None")


def run_status_batch(table: BucketedTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts the rows of a batch of `stream_run_status` in the place of those of the same shard. Rows hold sums, so a batch may run twice."""

    def put(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("run_id", "shard"), ["run_id", "shard"], "left_anti").unionByName(new)

    def apply(batch: DataFrame, number: int) -> None:
        table.merge(batch, put, number)

    return apply


def run_table(spark: SparkSession, path: str, run_type: str = "bigint", buckets: int = 64) -> BucketedTable:
    """The table that `run_status_batch` writes."""
    return BucketedTable(spark, path, TALLIES.format(run_type), ["run_id"], buckets)


def runs_of(tallies: DataFrame) -> DataFrame:
    """(run_id, status, phase) of a table of tallies, by the rules of `run_status`."""
    sums = tallies.groupBy("run_id").agg(*[F.sum(f"n_{s.lower()}").alias(s) for s in TALLIED])
    status = F.when(F.col("live") > 0, "IN_PROGRESS").when(F.col("FAILED") > 0, "FAILED").when((F.col("CANCELLED") > 0) & (F.col("COMPLETED") == 0), "CANCELLED").otherwise("COMPLETED")
    return sums.select("run_id", status.alias("status"), F.when(F.col("live") > 0, "CREATED").otherwise("DONE").alias("phase"))


class _Silence(StatefulProcessor):
    """State of an item: its last event. A timer of event time stands at the end of the silence that would make it stuck."""

    fields = "kind string, millis bigint"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, millis = (self.last.get() or ("", -1))[:2]
        for frame in rows:
            newest = frame.sort_values(["occurred_at", "event_id"]).iloc[-1]
            at = int(newest.occurred_at.value // 1_000_000)
            if at >= millis:
                kind, millis = str(newest.event_type), at
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kind in ENDED:
            self.last.clear()
        else:
            self.last.update(self.state(kind, millis))
            self.handle.registerTimer(max(millis + self.gap, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def state(self, kind: str, millis: int) -> tuple:
        return kind, millis

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        if last is not None:
            self.last.clear()
            yield pd.DataFrame({"item_id": [key[0]], "last_event": [last[0]], "last_at": [pd.Timestamp(last[1], unit="ms")]})

    def close(self) -> None:
        pass


ENDED = ("ITEM_COMPLETED", "ITEM_FAILED", "ITEM_CANCELLED")


def stream_stuck_items(events: DataFrame, stale_after: str = "1 hour", watermark: str | None = "10 minutes", silence: type[_Silence] = _Silence) -> DataFrame:
    """(item_id, last_event, last_at) of items that fall silent for `stale_after` of event time before they end.

    An item that goes on afterwards is watched anew. `silence` may be a subclass with further fields behind the state's own.
    """
    gap = int(pd.Timedelta(stale_after).total_seconds() * 1000)
    of = _watermarked(events, watermark).select("event_id", "item_id", "event_type", "occurred_at")
    return of.groupBy("item_id").transformWithStateInPandas(silence(gap), f"item_id {of.schema['item_id'].dataType.simpleString()}, last_event string, last_at timestamp", "Append", "EventTime")


def catalog_table(spark: SparkSession, path: str, schema: str, buckets: int = 64) -> BucketedTable:
    """A catalog in buckets of (channel, video), so that a large channel lies in all of them."""
    return BucketedTable(spark, path, schema, ["channel_id", "youtube_video_id"], buckets)


def channel_sync_batch(table: BucketedTable, now: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch of catalog candidates into the buckets that hold their videos; a repeated batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        wanted = batch.withColumn("youtube_video_id", java_trim("youtube_video_id")).filter(~is_blank("youtube_video_id"))
        table.merge(wanted, lambda old, new: sync_channel_catalog(old, new, now), number)

    return apply
