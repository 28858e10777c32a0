"""Keyed state and merges into buckets: restarts, repeats, broken merges, touched rows only."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timelode.operators import events
from timelode.operators.sinks import BucketedTable
from timelode.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
KINDS = ["ITEM_CREATED", "ITEM_PHASE_ENTERED", "ITEM_PHASE_COMPLETED", "ITEM_FAILED", "ITEM_COMPLETED", "ITEM_CANCELLED", "ITEM_RETRY_REQUESTED"]


def log(spark, rows, path):
    data = [(n, i, r, k, "OCR", 1, T0 + dt.timedelta(seconds=s)) for n, i, r, k, s in rows]
    spark.createDataFrame(data, jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run_once(spark, root, table, seen=None):
    """One start of the stream, to the end of the log."""
    stream = jobs.stream_run_status(spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(f"{root}/log"))
    apply = jobs.run_status_batch(table)

    def sink(batch, number):
        if seen is not None:
            seen.append(sorted({r.run_id for r in batch.collect()}))
        apply(batch, number)

    with jobs.keyed_state(spark):
        stream.writeStream.option("checkpointLocation", f"{root}/state").outputMode("update").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def test_run_status_over_restarts(spark, tmp_path):
    """Equal to the batch roll-up after each of three starts, with late, repeated and tied events; only touched runs are written."""
    rnd, root = random.Random(4), str(tmp_path)
    table = jobs.run_table(spark, f"{root}/runs", buckets=4)
    every, number = [], 0
    for part in range(3):
        rows = []
        for _ in range(300):
            number += 1
            item = rnd.randrange(120)
            rows.append((number, item, item % 25, rnd.choice(KINDS), rnd.randrange(50)))  # few seconds: many ties, later parts hold earlier times
        every += rows
        log(spark, rows + rows[:20], f"{root}/log")
        run_once(spark, root, table)
        items = events.items_from_events(spark.read.parquet(f"{root}/log").dropDuplicates(["event_id"]))
        full = items.withColumns({"created_at": F.col("phase_updated_at"), "error_code": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        runs = items.select("run_id").distinct().withColumns({c: F.lit(v).cast("string") for c, v in (("status", "PENDING"), ("phase", "CREATED"), ("error_code", None), ("error", None))})
        want = sorted((r.run_id, r.status, r.phase) for r in events.run_status(runs, full).collect())
        assert sorted((r.run_id, r.status, r.phase) for r in jobs.runs_of(table.read()).collect()) == want and len(want) == 25
    seen, before = [], table.manifest()
    log(spark, [(number + 1, 7, 7, "ITEM_FAILED", 99), (number + 2, 32, 7, "ITEM_FAILED", 99)], f"{root}/log")
    run_once(spark, root, table, seen)
    after = table.manifest()
    assert seen == [[7]] and sum(before["folders"].get(b) != f for b, f in after["folders"].items()) == 1
    assert {r.run_id: r.status for r in jobs.runs_of(table.read()).collect()}[7] in ("FAILED", "IN_PROGRESS")


def test_many_runs_one_touched(spark, tmp_path):
    root, table = str(tmp_path), None
    table = jobs.run_table(spark, f"{root}/runs", buckets=8)
    log(spark, [(i, i, i, "ITEM_CREATED", 0) for i in range(2000)], f"{root}/log")
    run_once(spark, root, table)
    seen = []
    log(spark, [(5000, 1234, 1234, "ITEM_COMPLETED", 5)], f"{root}/log")
    run_once(spark, root, table, seen)
    assert seen == [[1234]]
    tally = {r.status: r.n for r in jobs.runs_of(table.read()).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert tally == {"IN_PROGRESS": 1999, "COMPLETED": 1}


CATALOG = "channel_id string, youtube_video_id string, title string, published_at timestamp, watch_url string, metadata string, first_seen_at timestamp, last_seen_at timestamp"
LISTED = "channel_id string, pos int, youtube_video_id string, title string, published_at timestamp, watch_url string, metadata string"


def test_catalog_merges_touch_few_buckets_once(spark, tmp_path):
    table = jobs.catalog_table(spark, str(tmp_path / "c"), CATALOG, buckets=16)
    apply = jobs.channel_sync_batch(table, F.lit(T0))
    assert table.read().count() == 0
    apply(spark.createDataFrame([("c", i, f" v{i} ", "one", None, "w", "{}") for i in range(200)] + [("c", 900, " ", "blank", None, "w", "{}")], LISTED), 0)
    first = table.manifest()
    assert table.read().count() == 200 and len(first["folders"]) == 16
    batch = spark.createDataFrame([("c", 1, "v3", "two", None, "w", "{}"), ("c", 0, "new", "two", None, "w", "{}"), ("c", 2, "v3", "late", None, "w", "{}")], LISTED)
    apply(batch, 1)
    second = table.manifest()
    changed = [b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)]
    assert 1 <= len(changed) <= 2 and second["batch"] == 1
    rows = {r.youtube_video_id: r.title for r in table.read().collect()}
    assert len(rows) == 201 and rows["v3"] == "two" and rows["new"] == "two" and rows["v4"] == "one"
    apply(batch, 1)  # a repeated batch changes nothing
    apply(batch, 0)
    assert table.manifest() == second
    apply(spark.createDataFrame([], LISTED), 2)
    assert table.manifest()["folders"] == second["folders"] and table.manifest()["batch"] == 2


def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ["k"], 4)
    table.merge(spark.range(40).selectExpr("id AS k", "id AS v"), lambda old, new: new, 0)
    before = sorted(map(tuple, table.read().collect()))
    put = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    changes = spark.createDataFrame([(3, 33), (99, 99)], "k bigint, v bigint")
    commit, table._commit = table._commit, None
    with pytest.raises(TypeError):
        table.merge(changes, put, 1)  # the data is written, the manifest is not
    assert sorted(map(tuple, table.read().collect())) == before
    table._commit = commit
    table.merge(changes, put, 1)
    want = sorted([(k, v) for k, v in before if k != 3] + [(3, 33), (99, 99)])
    assert sorted(map(tuple, table.read().collect())) == want
    assert table.vacuum() > 0 and sorted(map(tuple, table.read().collect())) == want
    gone = table.merge(spark.createDataFrame(want, "k bigint, v bigint"), lambda old, new: old.limit(0), 2)
    assert len(gone) == 4 and table.read().count() == 0 and table.manifest()["folders"] == {}
    other = BucketedTable(spark, table.path, "k bigint, v bigint", ["k"], 4)
    merges = table.manifest()["merges"]
    table.merge(changes, put, 3)
    with pytest.raises(RuntimeError):
        other._commit(merges + 1, {})  # the number is taken


def test_stuck_items_over_a_restart_with_a_further_field(spark, tmp_path):
    root, hour = str(tmp_path), 3600

    class Counted(jobs._Silence):
        """The same with one more field: how many batches with events there were since the field is kept."""

        fields = f"{jobs._Silence.fields}, seen bigint"

        def state(self, kind, millis):
            old = self.last.get()
            return kind, millis, ((old[2] or 0) if old is not None else 0) + 1

    def start(silence):
        stream = jobs.stream_stuck_items(spark.readStream.schema(jobs.EVENT_SCHEMA).parquet(f"{root}/log"), "2 hours", "10 minutes", silence)
        with jobs.keyed_state(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
        return sorted((r.item_id, r.last_event) for r in spark.read.schema("item_id bigint, last_event string, last_at timestamp").parquet(f"{root}/out").collect())

    log(spark, [(1, 1, 0, "ITEM_CREATED", 0), (2, 2, 0, "ITEM_CREATED", 0), (3, 3, 0, "ITEM_CREATED", 0), (4, 3, 0, "ITEM_COMPLETED", 60)], f"{root}/log")
    assert start(jobs._Silence) == []
    log(spark, [(5, 2, 0, "ITEM_PHASE_ENTERED", hour)], f"{root}/log")
    assert start(Counted) == []
    log(spark, [(6, 9, 0, "ITEM_CREATED", 3 * hour)], f"{root}/log")
    assert start(Counted) == [(1, "ITEM_CREATED")]  # two hours after 0, not yet after one hour; ended items are not watched
    log(spark, [(7, 9, 0, "ITEM_COMPLETED", 9 * hour)], f"{root}/log")
    assert start(Counted) == [(1, "ITEM_CREATED"), (2, "ITEM_PHASE_ENTERED")]
