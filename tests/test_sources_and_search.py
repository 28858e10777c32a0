import json
import random

import numpy as np
from pyspark.sql import functions as F

from timelode.operators import catalog, knowledge, search
from timelode.sources import parsers


def test_replies(spark):
    unit = {"type": "claim", "content": " body ", "salience": "0.4", "source_segment_indices": [1, "x", 2]}
    replies = [json.dumps(x) for x in ({"units": []}, {"knowledgeUnits": [unit]}, [unit], {"other": [unit]}, {"units": [unit, {"type": "no", "content": "x"}]}, {"n": 1}, {"units": [{"type": "claim"}]}, {"units": ["text"]})] + ['{"units": [{"ty', "plain"]
    df = spark.createDataFrame([("v", i, r) for i, r in enumerate(replies)], "video_id string, batch int, json string")
    drafts, failed = parsers.parse_units(df)
    assert sorted(r.batch for r in failed.collect()) == [5, 6, 7, 8, 9]
    rows = {r.batch: r for r in drafts.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1].type, rows[1].content, rows[1].salience, rows[1].source_segment_indices) == ("CLAIM", "body", 0.4, [1, 2])


def test_transcripts(spark):
    raw = {"text": "all", "language": " ", "segments": [{"start": 0, "end": "1.5", "text": " a "}, {"timestamps": [2, 3], "transcript": "b"}, {"start": 1, "text": "no end"}, {"start": 1, "end": 2, "text": " "}]}
    heads, segs = parsers.parse_transcripts(spark.createDataFrame([("v", json.dumps(raw)), ("w", "bad")], "video_id string, json string"))
    assert [tuple(r) for r in heads.collect()] == [("v", None, "all")]
    assert [tuple(r)[2:] for r in segs.orderBy("segment_id").collect()] == [(0.0, 1.5, "a"), (2.0, 3.0, "b")]


def test_diarization_and_ocr(spark):
    raw = {"segments": [{"start": 0, "end": 1, "speaker": "A"}, {"start": 0, "speaker": "A"}], "speakers": [{"label": "A", "embedding": [1, 2.5]}, {"label": "B", "embedding": [1, "x"]}]}
    turns, speakers = parsers.parse_diarization(spark.createDataFrame([("v", json.dumps(raw))], "video_id string, json string"))
    assert turns.count() == 1 and {r.label: r.voiceprint for r in speakers.collect()} == {"A": [1.0, 2.5], "B": None}
    lines = {"lines": [{"text": " hi ", "score": 0.5, "bbox": [[1, 2], [3, 4]]}, {"transcription": "x", "bbox": [[1]]}, {"text": " "}]}
    got = parsers.parse_ocr(spark.createDataFrame([("f", json.dumps(lines))], "frame_id string, json string"), "en").orderBy("line_no").collect()
    assert [(r.text, r.confidence, r.bbox, r.language) for r in got] == [("hi", 0.5, [[1.0, 2.0], [3.0, 4.0]], "en"), ("x", None, None, "en")]


def test_url_paste(spark):
    raw = "https://a.com https://b.com\nhttps://a.com, https://c.com\n\nbad https://d.com"
    valid, invalid, doubles = parsers.parse_url_paste(spark.createDataFrame([(1, raw)], "req_id int, raw string"))
    assert [r.url for r in valid.orderBy("line_no", "pos").collect()] == ["https://a.com", "https://b.com", "https://c.com"]
    assert [r.line for r in invalid.collect()] == ["bad https://d.com"] and doubles.first().duplicates == 1


def test_batches(spark):
    rng = random.Random(2)
    fused = [("v", i, "t" * rng.randrange(0, 200), None) for i in range(60)]
    got = knowledge.batch_by_budget(spark.createDataFrame(fused, "video_id string, segment_index int, transcript_text string, ocr_text string"), 300)
    used = batch = 0
    want = {}
    for _, i, t, _ in fused:
        c = 32 + len(t)
        batch, used = (batch + 1, c) if used and used + c > 300 else (batch, used + c)
        want[i] = batch
    assert {r.segment_index: r.batch for r in got.collect()} == want


def test_unit_filter(spark):
    df = spark.createDataFrame([("v", 0, 0, "ENTITY", "x", 0.9), ("v", 0, 1, "QUESTION", "x", 0.9), ("v", 0, 2, "SUMMARY", "x", 0.05), ("v", 0, 3, "TOPIC", "x", None), ("v", 0, 4, "TOPIC", " ", 0.9)], "video_id string, batch int, pos int, type string, content string, salience double")
    assert [r.pos for r in knowledge.filter_units(df, ["ENTITY", "SUMMARY", "TOPIC"]).orderBy("pos").collect()] == [0, 3]
    assert [r.pos for r in knowledge.filter_units(df, cap=2).orderBy("pos").collect()] == [0, 1]


def test_top_k_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    x[17] = x[3]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, embedding array<float>")
    asked = corpus.filter("id % 20 = 3 AND id < 900").withColumnRenamed("id", "query_id")
    got = search.search_batch(corpus, asked, 5, block_queries=4).orderBy("query_id", "rank").collect()
    for q in range(3, 200, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        assert [r.id for r in got if r.query_id == q] == sorted(range(200), key=lambda i: (d[i], i))[:5]


def test_catalog_merge(spark):
    schema = "channel_id string, youtube_video_id string, title string, published_at timestamp, watch_url string, metadata string, first_seen_at timestamp, last_seen_at timestamp"
    old = spark.sql("SELECT 'c' channel_id, id youtube_video_id, 'old' title, timestamp'2020-01-01' published_at, 'w' watch_url, '{}' metadata, timestamp'2020-01-01' first_seen_at, timestamp'2020-01-01' last_seen_at FROM VALUES ('a'), ('gone') AS t(id)")
    assert old.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " ").replace(",", ", ") == schema
    new = spark.createDataFrame([("c", 1, " a ", "A"), ("c", 2, "a", "late"), ("c", 3, " ", "blank"), ("c", 4, "b", "B")], "channel_id string, pos int, youtube_video_id string, title string").selectExpr("*", "cast(null as timestamp) published_at", "'w' watch_url", "'{}' metadata")
    got = {r.youtube_video_id: (r.title, r.first_seen_at.year, r.last_seen_at.year) for r in catalog.sync_channel_catalog(old, new, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": ("A", 2020, 2024), "gone": ("old", 2020, 2020), "b": ("B", 2024, 2024)}


def test_embedding_replies(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert all(len(r.embedding) == 8 for r in search.embed_texts(df, "t", search.hash_embedder(8), dims=8).collect())
    assert all(r.embedding is None for r in search.embed_texts(df, "t", search.hash_embedder(4), dims=8, on_error="null").collect())


def test_tables_of_a_database(spark):
    """The embedded database that ships with Spark: ranges of a key, filters and columns in the scan, JSON as variant."""
    url, driver = "jdbc:derby:memory:timelode;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).selectExpr("CAST(id AS INT) AS channel_row", "concat('c', id % 7) AS channel_id", "IF(id % 10 = 0, 'bad json', concat('{\"n\": ', id, '}')) AS metadata")
    rows.unionByName(spark.sql("SELECT CAST(NULL AS INT) AS channel_row, 'none' AS channel_id, CAST(NULL AS STRING) AS metadata")).write.jdbc(url, "youtube_channels", "overwrite", {"driver": driver})
    found = parsers.read_jdbc_tables(spark, url, {"youtube_channels": "channel_row"}, driver=driver)["youtube_channels"]
    assert found.rdd.getNumPartitions() == 8 and found.count() == 1001
    some = found.filter("channel_row >= 990 AND channel_row < 995").select("channel_row", F.try_variant_get("metadata", "$.n", "int").alias("n"))
    assert sorted(tuple(r) for r in some.collect()) == [(990, None), (991, 991), (992, 992), (993, 993), (994, 994)]
    plan = some._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "PushedFilters: [*IsNotNull(channel_row), *GreaterThanOrEqual(channel_row,990)" in plan and "channel_id" not in plan.split("ReadSchema")[1]
    empty = rows.limit(0)
    empty.write.jdbc(url, "nothing", "overwrite", {"driver": driver})
    assert parsers.read_jdbc_table(spark, url, "nothing", "channel_row", driver=driver).count() == 0
    assert parsers.read_jdbc_table(spark, url, "youtube_channels", driver=driver).rdd.getNumPartitions() == 1
