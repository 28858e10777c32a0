import datetime as dt

from pyspark.sql import functions as F

from timelode.operators import events, runs, sinks
from timelode.plans.jobs import channel_job

ITEM = "item_id string, run_id string, status string, phase string, failed_phase string, attempt int, phase_updated_at timestamp, lease_expires_at timestamp, created_at timestamp, error_code string, error string, video_id string"
EVENT = "event_id int, item_id string, run_id string, event_type string, phase string, attempt int, occurred_at timestamp, error_code string, status string"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def item(id="i", status="FAILED", failed=None, attempt=1, updated=0.0, run="r", lease=None, created=0.0, code=None, phase="OCR"):
    return (id, run, status, phase, failed, attempt, at(updated), lease and at(lease), at(created), code, code, None)


def event(n, kind, phase, seconds, attempt=1, id="i", code=None):
    return (n, id, "r", kind, phase, attempt, at(seconds), code, None)


def lanes(spark, items, evs, now=100.0):
    found = events.phase_lanes(spark.createDataFrame(items, ITEM), spark.createDataFrame(evs, EVENT), F.lit(at(now)))
    return {r.phase: (r.state, r.millis) for r in found.collect()}


def test_lanes(spark):
    E, C = "ITEM_PHASE_ENTERED", "ITEM_PHASE_COMPLETED"
    evs = [event(1, E, "METADATA", 21.027352), event(2, C, "METADATA", 23.575604), event(3, E, "DOWNLOAD", 23.578343), event(4, C, "DOWNLOAD", 35.0), event(5, E, "OCR", 50.0)]
    got = lanes(spark, [item(failed="OCR", updated=53.245188)], evs)
    assert got["METADATA"] == ("done", 2548) and got["DOWNLOAD"] == ("done", 11422) and got["OCR"] == ("failed", 3245)
    assert got["TRANSCRIBE"] == ("skipped", None) and got["FUSE"] == ("pending", None)
    assert lanes(spark, [item(status="CANCELLED", failed="METADATA", updated=30)], [event(1, E, "METADATA", 20)])["METADATA"] == ("cancelled", 10000)
    for it, ev in ((item(failed="CREATED"), []), (item(status="PENDING"), [event(1, "ITEM_CREATED", None, 0)]), (item(status="PENDING", attempt=2), evs)):
        assert {s for s, _ in lanes(spark, [it], ev or [event(9, "ITEM_CREATED", None, 0, id="other")]).values()} == {"pending"}


def test_event_filter(spark):
    evs = spark.createDataFrame([event(1, "ITEM_CREATED", "CREATED", 0), event(2, "ITEM_PHASE_ENTERED", "OCR", 1), event(3, "ITEM_FAILED", "OCR", 2, code="UPSTREAM_TOOL_FAILURE"), event(4, "ITEM_FAILED", "TRANSCRIBE", 3, code="TRANSCRIPTION_FAILURE")], EVENT)
    count = lambda **k: events.filter_events(evs, **k).count()
    assert [count(phase="OCR"), count(error_code="TRANSCRIPTION_FAILURE"), count(phase="OCR", error_code="UPSTREAM_TOOL_FAILURE"), count(phase="OCR", error_code="TRANSCRIPTION_FAILURE"), count(phase="ocr"), count(phase="NOT_A_PHASE")] == [2, 1, 1, 0, 2, 0]
    assert count(from_ts=at(1), to_ts=at(3)) == 2


def test_run_status(spark):
    items = spark.createDataFrame([
        item("a", "COMPLETED", run="1"), item("b", "CANCELLED", run="1"), item("c", "FAILED", run="2", created=5, code="LATE"), item("d", "FAILED", run="2", created=1, code="FIRST"),
        item("e", "CANCELLED", run="3", code="DUP"), item("f", "PENDING", run="4"), item("g", "FAILED", run="4"),
    ], ITEM)
    rs = spark.createDataFrame([(str(i), "IN_PROGRESS", "METADATA", None, None) for i in range(1, 6)], "run_id string, status string, phase string, error_code string, error string")
    got = {r.run_id: (r.status, r.phase, r.error_code) for r in events.run_status(rs, items).collect()}
    assert got == {"1": ("COMPLETED", "DONE", None), "2": ("FAILED", "DONE", "FIRST"), "3": ("CANCELLED", "DONE", "DUP"), "4": ("IN_PROGRESS", "METADATA", None), "5": ("IN_PROGRESS", "METADATA", None)}
    again = {r.run_id: r.status for r in events.reconcile_runs(rs, items, F.lit(at(0))).collect()}
    assert again["4"] == "FAILED" and again["5"] == "FAILED" and again["1"] == "COMPLETED"


def test_sweep(spark):
    items = spark.createDataFrame([item("a", "PENDING", updated=-7200), item("b", "IN_PROGRESS", updated=-7200, lease=10), item("c", "PENDING", updated=-60), item("d", "COMPLETED", updated=-9000)], ITEM)
    vids = spark.createDataFrame([], "video_id string, status string")
    rs = spark.createDataFrame([], "run_id string, status string, phase string, error_code string, error string")
    failed, evs, _, _ = events.stuck_items(items, vids, rs, F.lit(at(0)))
    assert [(r.item_id, r.status, r.failed_phase, r.phase) for r in failed.collect()] == [("a", "FAILED", "OCR", "DONE")]
    assert [r.event_type for r in evs.collect()] == ["ITEM_FAILED"]


def test_previews(spark):
    items = spark.createDataFrame([("r", "v1"), ("r", "v2"), ("r", "v2"), ("r", None)], "run_id string, video_id string")
    vids = spark.createDataFrame([("v1", "FAILED", "one", at(0)), ("v2", "COMPLETED", "two", None)], "video_id string, status string, title string, created_at timestamp")
    assert [tuple(r) for r in runs.run_previews(items, vids).collect()] == [("r", 3, "v2", "two")]


def test_intake(spark):
    req = spark.createDataFrame([(1, 0, " https://a "), (1, 1, "https://a"), (1, 2, "x"), (1, 3, None), (2, 0, "https://a")], "req_id int, pos int, url string")
    got = [r.verdict for r in events.intake_urls(req).orderBy("req_id", "pos").collect()]
    assert got == ["ACCEPTED", "duplicate url in request", "url must start with http:// or https://", "url must not be blank", "ACCEPTED"]


def test_replace_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "video_id string, n int")
    new = spark.createDataFrame([("a", 9)], "video_id string, n int")
    done = spark.createDataFrame([("a",), ("b",)], "video_id string")
    assert sorted(tuple(r) for r in sinks.replace_for_videos(old, new, done).collect()) == [("a", 9), ("c", 3)]
    tables = {"videos": old, "video_frames": spark.createDataFrame([("f", "a"), ("g", "c")], "frame_id string, video_id string"), "ocr_results": spark.createDataFrame([("f",), ("g",)], "frame_id string"), "pipeline_run_items": spark.createDataFrame([("i", "a")], "item_id string, video_id string")}
    left = sinks.cascade_delete(tables, "videos", done)
    assert [r.frame_id for r in left["ocr_results"].collect()] == ["g"] and left["pipeline_run_items"].first().video_id is None


def test_written_videos_can_end_empty(spark, tmp_path):
    """A wiped video leaves nothing, whether or not others share its bucket."""
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "video_id string, n int")
    root, none = str(tmp_path / "t"), old.limit(0)
    sinks.write_replaced(old, none, old, root, 64)
    assert spark.read.parquet(root).count() == 3
    kept = [tuple(r) for r in spark.read.parquet(root).select("video_id", "n").collect()]
    sinks.write_replaced(none, spark.createDataFrame(kept, old.schema), spark.createDataFrame([("a",)], "video_id string"), root, 64)
    assert sorted(tuple(r) for r in spark.read.parquet(root).select("video_id", "n").collect()) == [("b", 2), ("c", 3)]


def test_channel_selection(spark):
    catalog = spark.createDataFrame([("c", "v1", "t", None, "https://w/1", "{}", at(0), at(0))], "channel_id string, youtube_video_id string, title string, published_at timestamp, watch_url string, metadata string, first_seen_at timestamp, last_seen_at timestamp")
    tables = {"youtube_channel_videos": catalog, "youtube_channels": spark.createDataFrame([("c", None)], "channel_id string, display_name string"), "videos": spark.createDataFrame([], "source string, source_video_id string")}
    asked = spark.createDataFrame([(1, 0, " v1 "), (2, 0, "v1"), (2, 1, "zz")], "req_id int, pos int, youtube_video_id string")
    out = channel_job(tables, spark.createDataFrame([], "channel_url string, json string"), F.lit(at(0)), asked)
    assert [r.req_id for r in out["refused"].collect()] == [2]
    assert [(r.item_id, r.url, r.status) for r in out["items"].collect()] == [("1-0", "https://w/1", "PENDING")]
