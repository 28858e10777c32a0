import random

from timelode.operators import fusion, videos

SEG = "video_id string, segment_id int, start_seconds float, end_seconds float, text string, speaker_id string"
VID = "video_id string, duration_seconds double"
SPK = "video_id string, speaker_id string, label string"
FRM = "video_id string, frame_id string, timestamp_seconds double"
OCR = "frame_id string, line_no int, text string"


def fuse(spark, segments=(), speakers=(), frames=(), ocr=(), vids=(("v", None),), **kw):
    segments = [(v, i, float(a), float(b), t, who) for v, i, a, b, t, who in segments]
    found = fusion.fuse_segments(
        spark.createDataFrame(list(vids), VID), spark.createDataFrame(list(segments), SEG), spark.createDataFrame(list(speakers), SPK), spark.createDataFrame(list(frames), FRM), spark.createDataFrame(list(ocr), OCR), **kw
    )
    return sorted(found.collect(), key=lambda r: (r.video_id, r.segment_index))


def test_window_text_and_labels(spark):
    rows = fuse(spark, [("v", 0, 0, 5, "Hello world", "a"), ("v", 1, 5, 12, " this is a test\t", "a"), ("v", 2, 40, 45, "later content", None)], [("v", "a", "SPEAKER_00")])
    assert [r.transcript_text for r in rows] == ["Hello world this is a test", "later content"]
    assert rows[0].speaker_labels == ["SPEAKER_00"] and rows[1].speaker_labels is None


def test_half_open_overlap(spark):
    rows = fuse(spark, [("v", 0, 28, 32, "both", None), ("v", 1, 60, 70, "late", None)])
    assert [(r.start_seconds, r.transcript_text) for r in rows] == [(0, "both"), (25, "both"), (50, "late")]


def test_dense_index_and_short_tail(spark):
    rows = fuse(spark, [("v", 0, 0, 10, "a", None), ("v", 1, 56, 60, "b", None)], vids=[("v", 70.0)])
    assert [(r.segment_index, r.start_seconds, r.end_seconds) for r in rows] == [(0, 0, 30), (1, 50, 70)]
    windows = fusion.sliding_windows(spark.createDataFrame([("v", 25.5)], "video_id string, extent double"))
    assert [r.k for r in windows.collect()] == [0]


def test_cap(spark):
    segs = [("v", i, i * 10 + 1, i * 10 + 9, f"t{i}", None) for i in range(4)]
    assert len(fuse(spark, segs, window=10, overlap=0, cap=2)) == 2


def test_three_signals_and_a_frame_at_the_extent(spark):
    rows = fuse(spark, [("v", 0, 0, 10, "said", "a")], [("v", "a", "S")], [("v", "f", 5.0), ("v", "g", 10.0)], [("f", 0, "VISIBLE TEXT"), ("g", 0, "GONE")])
    assert [(r.transcript_text, r.ocr_text, r.speaker_labels) for r in rows] == [("said", "VISIBLE TEXT", ["S"])]


def test_chrome(spark):
    frames = [("v", f"f{i}", i * 10 + 5.0) for i in range(5)]
    own = [(f"f{i}", 0, f"slide {chr(97 + i)}") for i in range(5)]
    marks = [(f"f{i}", 1, "Ask Gemini") for i in range(4)]
    texts = [r.ocr_text for r in fuse(spark, frames=frames, ocr=own + marks, vids=[("v", 50.0)], window=10, overlap=0)]
    assert texts == [f"slide {c}" for c in "abcde"]
    assert "Ask Gemini" in fuse(spark, frames=frames, ocr=own + marks, vids=[("v", 50.0)], window=10, overlap=0, ratio=1.0)[0].ocr_text
    assert "Ask Gemini" in fuse(spark, frames=frames[:3], ocr=own[:3] + marks[:3], window=10, overlap=0)[0].ocr_text
    emptied = fuse(spark, frames=frames[:4], ocr=marks, vids=[("v", 40.0)], window=10, overlap=0)
    assert [r.ocr_text for r in emptied] == [None] * 4


def test_letterless_lines(spark):
    lines = ["29,810.00", "  1,234  ", "0.239%2801043", "+0.76%", "BOS (29360.75", "NQ129,679.500.68%", "CONFIRMATION", "1s"]
    rows = fuse(spark, frames=[("v", "f", 1.0)], ocr=[("f", i, x) for i, x in enumerate(lines)], vids=[("v", 10.0)])
    assert rows[0].ocr_text.split("\n") == lines[4:]


def test_speakers_by_overlap(spark):
    seg = [("v", i, float(a), float(b), "x", None) for i, (a, b) in enumerate([(0, 2), (2, 4.5), (4, 6), (6, 9), (200, 205)])]
    turns = spark.createDataFrame([("v", 0, 0.0, 5.0, "S0"), ("v", 1, 5.0, 10.0, "S1")], "video_id string, seq int, start_seconds double, end_seconds double, label string")
    got = {r.segment_id: r.speaker_label for r in fusion.assign_speakers(spark.createDataFrame(seg, SEG), turns).collect()}
    assert got == {0: "S0", 1: "S0", 2: "S0", 3: "S1", 4: None}
    short = fusion.assign_speakers(spark.createDataFrame([("v", 0, 4.8, 5.0, "x", None)], SEG), turns.filter("seq = 0"), min_overlap=1.0)
    assert short.first().speaker_label is None


def test_fusion_equals_a_plain_loop(spark):
    rng = random.Random(5)
    segs = [(f"v{i % 7}", i, float(a := rng.randrange(0, 180)), float(a + rng.choice([0, 1, 7, 40])), f"t{i}", None) for i in range(80)]
    rows = fuse(spark, segs, vids=[(f"v{i}", None) for i in range(7)])
    want = []
    for v in sorted({s[0] for s in segs}):
        mine = [s for s in segs if s[0] == v]
        extent, k, n = max(s[3] for s in mine), 0, 0
        while 25.0 * k < extent:
            a, b = 25.0 * k, min(25.0 * k + 30, extent)
            texts = [s[4] for s in sorted(mine, key=lambda s: (s[2], s[1])) if s[3] > a and s[2] < b]
            if b - a >= 1 and texts:
                want.append((v, n, a, b, " ".join(texts)))
                n += 1
            k += 1
    assert [(r.video_id, r.segment_index, r.start_seconds, r.end_seconds, r.transcript_text) for r in rows] == want


def test_timeline_filter(spark):
    fused = spark.createDataFrame([("v", i, 30.0 * i, 30.0 * i + 30) for i in range(3)], "video_id string, segment_index int, start_seconds double, end_seconds double")
    ask = lambda a, b: [r.segment_index for r in videos.timeline_window(fused, "v", a, b).collect()]
    assert (ask(25, 65), ask(35, 55), ask(60, None), ask(None, 30)) == ([0, 1, 2], [1], [2], [0])


def test_empty_tables(spark):
    assert fuse(spark, vids=[]) == [] and fuse(spark) == []
