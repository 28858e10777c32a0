"""Vector search over many queries, recall of facts across units, folds of the event log: against plain versions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timelode.operators import events, knowledge, search


def plan_of(df):
    return df._jdf.queryExecution().toString()


def plain_top(x, q, k, metric):
    x, q = x.astype(float), q.astype(float)
    d = np.sqrt(((x - q) ** 2).sum(1)) if metric == "l2" else 1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return sorted(range(len(x)), key=lambda i: (round(d[i], 9), i))[:k]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("most_broadcast", [search.MOST_BROADCAST, 0])
def test_search_of_many_queries(spark, metric, most_broadcast):
    """With many vectors that are the same, over several blocks of either side and several tasks."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 6)).astype(np.float32)
    x[300:900] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (5002, [])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = [*range(0, 60), 400]
    queries = corpus.filter(F.col("id").isin(asked + [5000])).withColumnRenamed("id", "query_id")
    got = search.search_batch(corpus, queries, 7, metric, block_queries=16, most_broadcast=most_broadcast).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        near.setdefault(r.query_id, []).append(r.id)
    assert near == {q: plain_top(x, x[q], 7, metric) for q in asked}


def test_one_scan_and_few_rows_a_task(spark, tmp_path):
    """5 000 queries scan the corpus once; a vector that fills the corpus leaves k rows a query and task."""
    same = spark.range(12_000).select("id", F.array(*[F.lit(float(i)).cast("float") for i in range(4)]).alias("embedding"))
    same.repartition(4).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    queries = spark.range(5_000).select(F.col("id").alias("query_id"), F.array(*[(F.rand(i) * 3).cast("float") for i in range(4)]).alias("embedding"))
    found = search.search_batch(corpus, queries, 3)
    physical = plan_of(found).split("== Physical Plan ==")[1]
    assert physical.count(str(tmp_path / "c")[-20:]) == 1
    seen = {}
    assert found.count() == 15_000 and {r.id for r in found.limit(600).collect()} == {0, 1, 2}
    best = search._Best(__import__("pyarrow").array([0, 1]), np.zeros((2, 4)), 3, "l2")
    for at in range(0, 100_000, 10_000):
        best.see(__import__("pyarrow").array(np.arange(at, at + 10_000)), np.ones((10_000, 4)))
        seen[at] = best.held.num_rows
    assert set(seen.values()) == {6} and best.rows().column("id").to_pylist() == [0, 1, 2, 0, 1, 2]


def test_search_without_queries_or_corpus(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    none = corpus.limit(0)
    assert search.search_batch(corpus, none.withColumnRenamed("id", "query_id")).count() == 0
    assert search.search_batch(none, corpus.withColumnRenamed("id", "query_id")).count() == 0


def plain_recall(units, facts, noise):
    out = {}
    hit = lambda blob, groups: any(None not in g and all(t.lower() in blob for t in g) for g in groups)
    for arm, rep in sorted({u[:2] for u in units}):
        mine = sorted(u for u in units if u[:2] == (arm, rep))
        texts = [f"{u[4] or ''} {u[5] or ''}".lower() for u in mine]
        blob = " ".join(texts)
        out[arm, rep] = (len(mine), sum(u[3] == "PROCEDURE" for u in mine), sorted({n for n, g in facts if hit(blob, g)}), sum(hit(t, g) for t in texts for _, g in noise))
    return out


UNITS = "arm string, rep int, unit_id long, type string, title string, content string"


def test_fact_recall_against_one_text(spark):
    """Short units and long terms, so that terms cross one cut or several, over many tasks of the sort."""
    rnd = random.Random(6)
    units = [(rnd.choice("ab"), rnd.randrange(2), i, rnd.choice(["PROCEDURE", "CLAIM"]), rnd.choice(["", "X", "one Two", None]), rnd.choice(["", "y", "three", "FOUR five", None, "z" * 40])) for i in range(400)]
    words = ["x", "one", "two", "three", "four", "five", "y", "", " ", "  "]
    facts = [(f"f{i}", [[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 2))] for _ in range(2)]) for i in range(60)]
    facts += [("null term", [[None, "x"]]), ("no term", [[]]), ("no group", []), ("twice", [["x"]]), ("twice", [["y"]])]
    noise = [("n1", [["four five"], ["One"]]), ("n2", [["zz", "x"]])]
    args = (spark.createDataFrame(units, UNITS), *(spark.createDataFrame(x, "label string, any_of array<array<string>>") for x in (facts, noise)))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = knowledge.fact_recall(args[0].repartition(5), *args[1:])
        got = {(r.arm, r.rep): (r.n_units, r.n_procedures, r.facts, r.n_noise) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = plain_recall(units, facts, noise)
    assert got == want and all(r.n_facts == len(r.facts) for r in found.collect())
    alone = {n for n, g in facts if any(None not in t and all(any(w.lower() in f"{u[4] or ''} {u[5] or ''}".lower() for u in units) for w in t) for t in g)}
    assert {n for x in want.values() for n in x[2]} - alone  # some facts stand across units only
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found) and "collect_list" not in plan_of(found)


def test_a_term_across_units(spark):
    units = spark.createDataFrame([("a", 1, 2, "CLAIM", "", "licence is granted"), ("a", 1, 1, "CLAIM", "t", "this free"), ("b", 1, 1, "CLAIM", "t", "this free"), ("b", 2, 2, "CLAIM", "", "licence")], UNITS)
    facts = spark.createDataFrame([("f", [["free  Licence"]])], "label string, any_of array<array<string>>")
    got = {(r.arm, r.rep): r.facts for r in knowledge.fact_recall(units, facts, facts.limit(0)).collect()}
    assert got == {("a", 1): ["f"], ("b", 1): [], ("b", 2): []}


def test_arm_delta(spark):
    arms = spark.createDataFrame([("a", 5.0), ("b", 1.5), ("c", 4.0)], "arm string, mean_facts double")
    assert [tuple(r) for r in knowledge.arm_delta(arms, "a", "b").collect()] == [(3.5, False)] and [tuple(r) for r in knowledge.arm_delta(arms, "a", "c").collect()] == [(1.0, True)]
    assert knowledge.arm_delta(arms, "a", "x").collect() == [] and "Cartesian" not in plan_of(knowledge.arm_delta(arms, "a", "b"))


def test_items_from_events_by_field(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = [
        (1, "a", "ITEM_CREATED", 0, None, None), (2, "a", "ITEM_VIDEO_ATTACHED", 1, "v1", None), (3, "a", "ITEM_FAILED", 2, None, "E1"),
        (4, "b", "ITEM_VIDEO_ATTACHED", 1, "v2", None), (5, "b", "ITEM_FAILED", 2, None, "E2"), (6, "b", "ITEM_RETRY_REQUESTED", 3, None, "E2"),
        (7, "c", "ITEM_FAILED", 2, None, "E3"), (8, "c", "ITEM_RETRY_REQUESTED", 3, None, "E3"), (9, "c", "ITEM_VIDEO_ATTACHED", 4, "v3", None), (10, "c", "ITEM_VIDEO_ATTACHED", 4, "v4", None), (11, "c", "ITEM_CANCELLED", 5, None, "DUP"),
        (12, "d", "ITEM_FAILED", 2, None, "E4"), (13, "d", "ITEM_PHASE_ENTERED", 3, None, None),
    ]
    rows = spark.createDataFrame([(n, i, "r", k, "OCR", 1, at(s), v, e) for n, i, k, s, v, e in log], "event_id int, item_id string, run_id string, event_type string, phase string, attempt int, occurred_at timestamp, video_id string, error_code string")
    got = {r.item_id: (r.video_id, r.status, r.error_code, r.failed_phase) for r in events.items_from_events(rows).collect()}
    assert got == {"a": ("v1", "FAILED", "E1", "OCR"), "b": (None, "PENDING", None, None), "c": ("v4", "CANCELLED", "DUP", "OCR"), "d": (None, "IN_PROGRESS", None, None)}
    bare = events.items_from_events(rows.drop("video_id", "error_code")).filter("item_id = 'a'").first()
    assert bare.video_id is None and bare.error_code is None and bare.status == "FAILED"


def test_fusion_exchanges_signals_once(spark, tmp_path):
    """Two exchanges by hash: frames with their lines, and all signals of a video; each table is scanned once."""
    from timelode.operators import fusion

    tables = {
        "videos": ("video_id string, duration_seconds int", [("v", 40), ("w", None), ("n", 0)]),
        "segments": ("video_id string, segment_id int, start_seconds float, end_seconds float, text string, speaker_id string", [("v", 1, 0.0, 5.0, " hi ", "a"), ("v", 2, 26.0, 31.0, "you", "b"), ("v", 3, 1.0, 2.0, " ", None), ("w", 1, 1.0, 3.0, "x", "a"), ("v", 4, None, 3.0, "lost", "a")]),
        "speakers": ("video_id string, speaker_id string, label string", [("v", "a", "A"), ("v", None, "NOBODY"), ("x", "b", "B")]),
        "frames": ("video_id string, frame_id string, timestamp_seconds double", [("v", "f1", 3.0), ("v", "f2", 27.0), ("v", None, 38.0), ("w", None, 2.0), ("w", "f9", None)]),
        "ocr": ("frame_id string, line_no int, text string", [("f1", 1, "two"), ("f1", 0, " one "), ("f2", 0, "one"), ("f2", 1, "12"), ("gone", 0, "zzz"), (None, 0, "nobody's")]),
    }
    dfs = {}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        dfs[name] = spark.read.parquet(str(tmp_path / name))
    found = fusion.fuse_segments(dfs["videos"], dfs["segments"], dfs["speakers"], dfs["frames"], dfs["ocr"])
    got = {(r.video_id, r.segment_index): (r.start_seconds, r.end_seconds, r.transcript_text, r.ocr_text, r.speaker_labels) for r in found.collect()}
    assert got == {("v", 0): (0.0, 30.0, "hi you", "one\ntwo", ["A"]), ("v", 1): (25.0, 40.0, "you", "one", None), ("w", 0): (0.0, 3.0, "x", None, None)}
    physical = plan_of(found).split("== Physical Plan ==")[1].split("+- == Initial Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning") == 2 and physical.count("Scan parquet") == 5 and "Join" not in physical


def test_pages_by_directory_and_by_cursor(spark, tmp_path):
    """All pages hold each row once, in the order of one sort, with nulls and either direction."""
    from timelode.operators import paging

    rnd = random.Random(9)
    rows = [(rnd.choice([None, *range(6)]), rnd.choice([None, "x", "y", "z"]), i) for i in range(503)]
    df = spark.createDataFrame(rows, "a int, b string, n int").repartition(5)
    for k, order in enumerate(([("a", True), ("b", False), ("n", False)], [("b", True), ("a", False), ("n", True)], [("n", False)])):
        key = lambda r: tuple(((v is None) == down, (0 if v is None else -v if down else v) if not isinstance(v, str) else [(-1 if down else 1) * ord(c) for c in v]) for c, down in order for v in (r["abn".index(c)],))  # noqa: B023, E731
        want = sorted(rows, key=lambda r: tuple((x, y if isinstance(y, int) else y[0]) for x, y in key(r)))
        directory = paging.write_page_directory(df, order, 50, str(tmp_path / f"d{k}"))
        assert directory.count() == 11
        got = [[tuple(r)[:3] for r in paging.page_from_directory(df, order, directory, p).collect()] for p in (0, 1, 7, 10, 11)]
        assert got == [want[50 * p : 50 * p + 50] for p in (0, 1, 7, 10)] + [[]]
        last, walked = None, []
        for _ in range(3):
            page = paging.page_after(df, order, last, 60).collect()
            walked += [tuple(r) for r in page]
            last = page[-1]
        assert walked == want[:180]
    empty = paging.write_page_directory(df.limit(0), [("n", False)], 50, str(tmp_path / "empty"))
    assert empty.count() == 0 and paging.page_from_directory(df, [("n", False)], empty, 0).count() == 0


def test_a_deep_page_reads_a_part_of_the_table(spark, tmp_path):
    from timelode.operators import paging

    spark.range(400_000).select(F.col("id").alias("n"), (F.col("id") % 7).alias("x")).repartitionByRange(40, "n").sortWithinPartitions("n").write.parquet(str(tmp_path / "t"))
    table, order = spark.read.parquet(str(tmp_path / "t")), [("n", False)]
    directory = paging.write_page_directory(table, order, 20, str(tmp_path / "d"))
    page = paging.page_from_directory(table, order, directory, 10_000)
    got = page.collect()
    assert [r.n for r in got] == list(range(200_000, 200_020)) and got[0].total == 400_000
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(paging.page_from_directory(table, order, directory, 10_000))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(n,200020)" in text and "GreaterThan(n,200000)" in text
    import glob

    import pyarrow.parquet as pq

    stats = [pq.ParquetFile(f).metadata.row_group(g).column(0).statistics for f in glob.glob(str(tmp_path / "t" / "*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(stats) >= 30 and sum(s.max >= 200_000 and s.min < 200_020 for s in stats) <= 2  # the row groups that the filters leave


def test_late_rows_are_counted(spark, tmp_path):
    """Two hours behind an hour's watermark: exactly the sentinels are dropped, and told."""
    import datetime as dt
    import time

    from timelode.streaming import jobs

    t0 = dt.datetime(2024, 1, 1, 12)
    log = lambda rows: spark.createDataFrame([(n, 1, 1, "ITEM_CREATED", "OCR", 1, t0 + dt.timedelta(minutes=m)) for n, m in rows], jobs.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = jobs.LateRows()
    spark.streams.addListener(seen)
    try:
        for part in ([(i, i) for i in range(60)], [(100 + i, 60 + i) for i in range(10)], [(200, 70), (201, -120), (202, -90), (203, -61), (204, 50)]):
            log(part)
            counted = jobs.stream_event_counts(jobs.observed_events(jobs.stream_events(spark, str(tmp_path / "log"))), "1 hour", watermark=None)
            stream = counted.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            stream.awaitTermination()
            run = str(stream.runId)
        end = time.time() + 30
        while time.time() < end and sum(b["rows"] for b in seen.batches) < 75:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert seen.dropped(run) == 3 == seen.dropped() and sum(b["rows"] for b in seen.batches) == 75
    assert sum(b["observed"]["events"]["n"] for b in seen.batches if "events" in b["observed"]) == 72


def test_units_are_scanned_a_few_at_a_time():
    """A batch of Spark's 10 000 units is scanned in many small parts, so that its texts are not all held as strings at once."""
    texts = [f"unit {i} all rights reserved " * (i % 200) for i in range(10_000)]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"arm": ["a"] * n, "rep": [i % 5 for i in range(n)], "unit_id": list(range(n)), "procedure": [i % 2 == 0 for i in range(n)], "blob": texts})
    texts.clear()
    terms, at = knowledge.Terms([[["unit 7 all", "reserved"]]], [[["rights"]]]), 0
    tracemalloc.start()
    for part in knowledge._scan_units(terms)(iter([batch])):
        blobs = batch.column("blob").slice(at, part.num_rows).to_pylist()
        assert 0 < len(blobs) <= 256 and part.column("found").to_pylist() == [sorted(terms.found(b)) for b in blobs] and part.column("n_noise").to_pylist() == [int("rights" in b) for b in blobs]
        assert part.column("head").to_pylist() == [b[:9] for b in blobs] and part.column("tail").to_pylist() == [b[-9:] for b in blobs] and part.column("short").to_pylist() == [len(b) <= 9 for b in blobs]
        at += len(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and peak < batch.nbytes / 4


def test_recall_of_units_without_arm_or_rep(spark):
    units = [(None, 1, 1, "CLAIM", "t", "this free"), (None, 1, 2, "CLAIM", "", "licence is"), ("a", None, 3, "PROCEDURE", "t", "free"), ("a", None, 4, "CLAIM", "", "licence")]
    facts = spark.createDataFrame([("f", [["free  Licence"]])], "label string, any_of array<array<string>>")
    found = knowledge.fact_recall(spark.createDataFrame(units, UNITS), facts, facts.limit(0)).collect()
    assert {(r.arm, r.rep): (r.n_units, r.n_procedures, r.facts) for r in found} == {(None, 1): (2, 0, ["f"]), ("a", None): (2, 1, ["f"])}
