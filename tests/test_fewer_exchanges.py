"""Jobs whose rows are moved no more often than their rules need: against plain results, and by their plans."""

from pyspark.sql import functions as F

from timelode.operators import runs
from timelode.plans.queries import QUERIES
from timelode.sources import parsers

DATA = "/root/testdata/sf0.001"


def test_savings_scan_each_signal_once(spark):
    plan = QUERIES["chrome_savings"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_details_of_runs(spark):
    run = "run_id long, status string, phase string, video_url string, created_at long"
    every = spark.createDataFrame([(1, "P", "M", "u1", 5), (2, "P", "M", "u2", 6), (None, "P", "M", "u0", 7)], run)
    item = "run_id long, item_id string, url string, status string, phase string, attempt int, video_id long, created_at long"
    items = spark.createDataFrame([(1, "b", "x", "D", "M", None, 8, 9), (1, "a", "y", "D", "M", 3, 4, 9), (3, "c", "z", "D", "M", 1, 8, 1), (None, "d", "z", "D", "M", 1, 8, 1)], item)
    videos = spark.createDataFrame([(8, "ch", "t")], "video_id long, channel_name string, title string")
    found = runs.run_details(every, items, videos)
    assert [tuple(r) for r in found.collect()] == [
        (None, None, "u0", "P", "M", 1, None, None, 7), (1, "a", "y", "D", "M", 3, None, None, 9), (1, "b", "x", "D", "M", 1, "ch", "t", 9), (2, None, "u2", "P", "M", 1, None, None, 6),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(run_id") == 0 and plan.count("Exchange rangepartitioning") == 1


def test_a_listing_is_not_carried_along_its_entries(spark):
    raw = spark.createDataFrame([("c", '{"uploader_id": " me ", "entries": [{"id": " ", "url": "u1", "upload_date": "20240231"}, {"id": 5, "timestamp": 60}, {"title": "none"}]}')], "channel_url string, json string")
    found = parsers.parse_channel_listing(raw)[1]
    got = found.select("channel_id", "pos", "youtube_video_id", "watch_url", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("me", 0, "u1", "https://www.youtube.com/watch?v=u1", "2024-02-29 00:00"), ("me", 1, "5", "https://www.youtube.com/watch?v=5", "1970-01-01 00:01")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "_v#" not in generate
