"""Urls that several requests ask for, and that tell of several videos."""

from pyspark.sql import functions as F

from timelode.plans.jobs import ingest_job


def test_one_row_a_video_and_one_end_an_item(spark):
    asked = spark.createDataFrame([(1, 10, "https://v/a"), (1, 11, "https://v/a"), (2, 20, " https://v/a"), (2, 21, "https://v/b"), (3, 30, "https://v/c")], "req_id long, pos long, url string")
    told = [("https://v/a", 1), ("https://v/a", 2), ("https://v/a", 2), ("https://v/b", 3), ("https://v/c", 9)]
    metadata = spark.createDataFrame(told, "url string, id int").select("url", F.format_string('{"extractor": "youtube", "id": "%d", "title": "t"}', "id").alias("json"), F.lit("f").alias("file_path"))
    known = spark.createDataFrame([(9, "youtube", "9")], "video_id long, source string, source_video_id string")
    done = ingest_job({"videos": known}, asked, metadata, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    assert sorted(r.video_id for r in done["videos"].collect()) == ["youtube:1", "youtube:2", "youtube:3"]
    assert sorted(r.item_id for r in done["cancelled"].collect()) == ["2-20", "3-30"]
    assert sorted(r.item_id for r in done["events"].filter("event_type = 'ITEM_CANCELLED'").collect()) == ["2-20", "3-30"]
