"""Files of transcripts: one of each kind a video, whole, and cheap to write."""

import json
import time

from pyspark.sql import functions as F

from timelode.operators import sinks


def test_files_of_many_videos(spark, tmp_path):
    texts = spark.range(4000).select(F.col("id").alias("video_id"), F.lit("en").alias("language"), F.when(F.col("id") > 0, F.concat(F.lit("a\nß "), F.col("id").cast("string"))).alias("full_text"))
    said = spark.createDataFrame([(7, 1.0, 2.0, "later"), (7, 0.0, 1.0, "first")], "video_id long, start_seconds double, end_seconds double, text string")
    root = f"file://{tmp_path}/out"
    sinks.write_transcript_artifacts(texts.limit(3), said, root)
    began = time.time()
    sinks.write_transcript_artifacts(texts.filter("video_id <> 2"), said, root)
    assert time.time() - began < 20
    assert len(list((tmp_path / "out" / "json").iterdir())) == len(list((tmp_path / "out" / "text").iterdir())) == 3999
    assert [f.name for f in (tmp_path / "out" / "text" / "video_id=7").iterdir()] == ["transcript.txt"]
    written = (tmp_path / "out" / "json" / "video_id=7" / "transcript.json").read_text()
    assert written.count("\n") > 5 and [x["text"] for x in json.loads(written)["segments"]] == ["first", "later"]
    found = {r.video_id: r for r in sinks.read_transcript_artifacts(texts.filter("video_id IN (0, 7, 3999)"), root).collect()}
    assert found[7].json == written and {k: r.text for k, r in found.items()} == {0: "\n", 7: "a\nß 7\n", 3999: "a\nß 3999\n"}
