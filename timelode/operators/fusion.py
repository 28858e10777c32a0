"""Signals of a video fused into overlapping windows of its time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import carries_meaning, classify_frame, is_blank, java_trim

WINDOW, OVERLAP, LEAST_WINDOW = 30.0, 5.0, 1.0


def timeline_extent(videos: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, extent): the latest moment any signal or the declared duration reaches; videos without one are left out."""
    signals = signal_union(videos, segments, frames)
    return signals.groupBy("video_id").agg(F.max("at").alias("extent")).filter("extent > 0")


def signal_union(videos: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, at): the last moment of every time signal of a video, as one table."""
    ends = segments.select("video_id", F.col("end_seconds").cast("double").alias("at"))
    return ends.unionByName(frames.select("video_id", F.col("timestamp_seconds").cast("double").alias("at"))).unionByName(videos.select("video_id", F.col("duration_seconds").cast("double").alias("at")))


def _check(window: float, overlap: float) -> float:
    if window <= 0 or not 0 <= overlap < window:
        raise ValueError("window must be positive and overlap in [0, window)")
    return window - overlap


def sliding_windows(extents: DataFrame, window: float = WINDOW, overlap: float = OVERLAP, min_window: float = LEAST_WINDOW) -> DataFrame:
    """(video_id, k, window_start, window_end) of every window at least `min_window` long."""
    step = _check(window, overlap)
    count = F.ceil(F.col("extent") / step)
    every = extents.filter("extent > 0").select("video_id", "extent", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))
    start = F.col("k") * F.lit(step)
    every = every.select("video_id", "k", start.alias("window_start"), F.least(start + window, "extent").alias("window_end"))
    return every.filter((F.col("window_end") > F.col("window_start")) & (F.col("window_end") - F.col("window_start") >= min_window))


def _spread(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per window index in [first, last]; none where last < first."""
    first = F.greatest(first.cast("long"), F.lit(0).cast("long"))
    return df.withColumn("_k0", first).withColumn("_k1", last.cast("long")).filter("_k1 >= _k0").withColumn("k", F.explode(F.sequence("_k0", "_k1"))).drop("_k0", "_k1")


def _segments_in_windows(segments: DataFrame, windows: DataFrame, window: float, overlap: float) -> DataFrame:
    step = _check(window, overlap)
    rows = segments.select("video_id", "segment_id", F.col("start_seconds").cast("double").alias("s"), F.col("end_seconds").cast("double").alias("e"), "text", "speaker_label")
    rows = _spread(rows, F.floor((F.col("s") - window) / step), F.ceil(F.col("e") / step))
    return rows.join(windows, ["video_id", "k"]).filter("e > window_start AND s < window_end")


def _filled(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def window_transcript(segments: DataFrame, windows: DataFrame, window: float = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """(video_id, k, transcript_text, speaker_labels) per window that any segment overlaps; `segments` carry speaker_label."""
    rows = _segments_in_windows(segments, windows, window, overlap)
    grouped = rows.groupBy("video_id", "k").agg(F.array_sort(F.collect_list(F.struct("s", "segment_id", "text", "speaker_label"))).alias("parts"))
    texts = F.filter(F.transform("parts", lambda p: java_trim(p["text"])), lambda t: ~is_blank(t))
    return grouped.select("video_id", "k", F.nullif(F.array_join(texts, " "), F.lit("")).alias("transcript_text"), F.array_distinct(_filled(F.transform("parts", lambda p: p["speaker_label"]))).alias("speaker_labels"))


def window_ocr(frames: DataFrame, ocr: DataFrame, windows: DataFrame, window: float = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """(video_id, k, lines): distinct lines that carry a letter, in the order first seen."""
    step = _check(window, overlap)
    lines = ocr.withColumn("text", java_trim("text")).filter(carries_meaning("text")).select("frame_id", "line_no", "text")
    rows = frames.select("video_id", "frame_id", F.col("timestamp_seconds").cast("double").alias("ts")).join(lines, "frame_id")
    rows = _spread(rows, F.floor((F.col("ts") - window) / step), F.floor(F.col("ts") / step))
    rows = rows.join(windows, ["video_id", "k"]).filter("ts >= window_start AND ts < window_end")
    grouped = rows.groupBy("video_id", "k").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id", "line_no", "text"))).alias("parts"))
    return grouped.select("video_id", "k", F.array_distinct(F.transform("parts", lambda p: p["text"])).alias("lines"))


def chrome_lines(window_lines: DataFrame, n_windows: DataFrame, ratio: float = 0.6, min_windows: int = 4) -> DataFrame:
    """(video_id, line) repeated in at least `ratio` of a video's windows that hold anything; `n_windows` is (video_id, n), their number."""
    if ratio >= 1.0:
        return window_lines.select("video_id", F.lit("").alias("line")).limit(0)
    counts = window_lines.select("video_id", "k", F.explode("lines").alias("line")).groupBy("video_id", "line").agg(F.count("*").alias("seen"))
    enough = n_windows.filter(F.col("n") >= max(min_windows, 2))
    return counts.join(enough, "video_id").filter(F.col("seen") >= F.lit(ratio) * F.col("n")).select("video_id", "line")


def _frames_with_lines(frames: DataFrame, ocr: DataFrame) -> DataFrame:
    """(video_id, frame_id, ts, lines) of every frame, whether or not it has lines, by one exchange of frames and lines together."""
    lines = ocr.withColumn("text", java_trim("text")).filter(carries_meaning("text"))
    kind = {c: frames.schema[c].dataType for c in ("video_id", "frame_id")}
    none = F.lit(None)
    rows = frames.select("frame_id", "video_id", F.col("timestamp_seconds").cast("double").alias("ts"), F.col("video_id").isNotNull().alias("own"), none.cast("bigint").alias("line_no"), none.cast("string").alias("text")).unionByName(
        lines.select(F.col("frame_id").cast(kind["frame_id"]).alias("frame_id"), none.cast(kind["video_id"]).alias("video_id"), none.cast("double").alias("ts"), F.lit(False).alias("own"), F.col("line_no").cast("bigint").alias("line_no"), "text")
    )
    # a frame without an id has no lines, and is no other's
    alone = F.when(F.col("frame_id").isNull(), F.struct("video_id", "ts"))
    shown = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_no", "text")))).alias("lines")
    return rows.groupBy("frame_id", alone.alias("alone")).agg(F.max("video_id").alias("video_id"), F.max("ts").alias("ts"), F.bool_or("own").alias("own"), shown).filter("own").select("video_id", "frame_id", "ts", "lines")


def _signals(videos: DataFrame, segments: DataFrame, speakers: DataFrame, frames: DataFrame, ocr: DataFrame) -> DataFrame:
    """All that is known of a video as rows of one table: what is said, shown and declared, each with the last moment it reaches, `at`."""
    kinds = {"video_id": videos.schema["video_id"].dataType, "speaker_id": segments.schema["speaker_id"].dataType, "said": None, "shown": None}
    said = segments.select("video_id", "speaker_id", F.col("end_seconds").cast("double").alias("at"), F.struct(F.col("start_seconds").cast("double").alias("s"), F.col("end_seconds").cast("double").alias("e"), "segment_id", "text").alias("said"))
    shown = _frames_with_lines(frames, ocr).select("video_id", F.col("ts").alias("at"), F.struct("ts", "frame_id", "lines").alias("shown"))
    kinds["said"], kinds["shown"] = said.schema["said"].dataType, shown.schema["shown"].dataType
    known = speakers.select("video_id", "speaker_id", "label")
    declared = videos.select("video_id", F.col("duration_seconds").cast("double").alias("at"))
    kinds |= {"at": declared.schema["at"].dataType, "label": known.schema["label"].dataType}
    rows = [df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for df in (said, shown, known, declared)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def filled_windows(videos, segments, speakers, frames, ocr, window: float = WINDOW, overlap: float = OVERLAP, min_window: float = LEAST_WINDOW, cap: int = 2000) -> DataFrame:
    """The windows in which something is said or shown, with what it is; the first `cap` of a video. Their number is what shares of windows are taken of.

    The signals of a video meet once, by an exchange on the video; extent, labels, windows and their contents follow
    within that partitioning. The window of a signal is arithmetic, so windows are not a table to be joined.
    """
    step = _check(window, overlap)
    by = Window.partitionBy("video_id")
    rows = _signals(videos, segments, speakers, frames, ocr).withColumn("extent", F.max("at").over(by)).filter("extent > 0")
    # rows of one speaker: the label of its declaration; a segment without a speaker has none
    label = F.when(F.col("speaker_id").isNotNull(), F.max("label").over(Window.partitionBy("video_id", "speaker_id")))
    rows = rows.withColumn("speaker_label", label).filter("said IS NOT NULL OR shown IS NOT NULL")
    first = F.floor((F.coalesce("said.s", "shown.ts") - window) / step)
    last = F.when(F.col("said").isNotNull(), F.ceil(F.col("said.e") / step)).otherwise(F.floor(F.col("shown.ts") / step))
    start = F.col("k") * F.lit(step)
    rows = _spread(rows, first, F.least(last, F.ceil(F.col("extent") / step) - 1)).withColumn("window_start", start).withColumn("window_end", F.least(start + window, "extent"))
    rows = rows.filter((F.col("window_end") > F.col("window_start")) & (F.col("window_end") - F.col("window_start") >= min_window))
    rows = rows.filter("CASE WHEN said IS NOT NULL THEN said.e > window_start AND said.s < window_end ELSE shown.ts >= window_start AND shown.ts < window_end END")
    spoken = F.collect_list(F.when(F.col("said").isNotNull(), F.struct("said.s", "said.segment_id", "said.text", "speaker_label")))
    found = rows.groupBy("video_id", "k", "window_start", "window_end").agg(F.array_sort(spoken).alias("spoken"), F.array_sort(F.collect_list("shown")).alias("seen"))
    texts = F.filter(F.transform("spoken", lambda p: java_trim(p["text"])), lambda t: ~is_blank(t))
    found = found.select(
        "video_id", "k", "window_start", "window_end", F.nullif(F.array_join(texts, " "), F.lit("")).alias("transcript_text"), F.array_distinct(_filled(F.transform("spoken", lambda p: p["speaker_label"]))).alias("speaker_labels"),
        F.array_distinct(F.flatten(F.transform("seen", lambda f: F.transform(f["lines"], lambda x: x["text"])))).alias("lines"),
    )
    # emptiness is judged before repeated lines are removed
    found = found.filter(F.col("transcript_text").isNotNull() | (F.size("lines") > 0) | (F.size("speaker_labels") > 0))
    index = F.row_number().over(by.orderBy("k")) - 1
    return found.withColumn("segment_index", index).filter(F.col("segment_index") < cap)


def fuse_segments(videos, segments, speakers, frames, ocr, window: float = WINDOW, overlap: float = OVERLAP, min_window: float = LEAST_WINDOW, cap: int = 2000, ratio: float = 0.6, min_windows: int = 4) -> DataFrame:
    """Time-aligned rows of what was said, shown and by whom; lines that stay on screen all along are removed."""
    found = filled_windows(videos, segments, speakers, frames, ocr, window, overlap, min_window, cap)
    # one pass: rows are partitioned by video already, which serves the counts per line and the regrouping too
    rows = found.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).select("*", F.posexplode_outer("lines").alias("pos", "line"))
    seen = F.count("line").over(Window.partitionBy("video_id", "line"))
    chrome = (seen >= F.lit(ratio) * F.col("n")) & (F.col("n") >= max(min_windows, 2)) & F.lit(ratio < 1.0)
    once = F.coalesce("pos", F.lit(0)) == 0
    # what a window has once goes with its first line only
    rows = rows.select(
        "video_id", "segment_index", "window_start", "window_end", F.when(once, F.col("transcript_text")).alias("transcript_text"), F.when(once & (F.size("speaker_labels") > 0), F.col("speaker_labels")).alias("speaker_labels"),
        F.when(F.col("line").isNotNull() & ~chrome, F.struct("pos", "line")).alias("kept"),
    )
    fused = rows.groupBy("video_id", "segment_index", F.col("window_start").alias("start_seconds"), F.col("window_end").alias("end_seconds")).agg(
        F.max("transcript_text").alias("transcript_text"), F.array_sort(F.collect_list("kept")).alias("kept"), F.max("speaker_labels").alias("speaker_labels")
    )
    text = F.nullif(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), F.lit("")).alias("ocr_text")
    return fused.select("video_id", "segment_index", "start_seconds", "end_seconds", "transcript_text", text, "speaker_labels")


def _screen_lines(filled: DataFrame) -> DataFrame:
    """(video_id, line, seen, n) of filled windows: in how many windows of its video a line is shown, of how many; by the exchanges of the windows alone."""
    rows = filled.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).filter(F.size("lines") > 0)
    return rows.select("video_id", "n", F.explode("lines").alias("line")).groupBy("video_id", "line").agg(F.count("*").alias("seen"), F.max("n").alias("n"))


def _stays(ratio: float, min_windows: int) -> Column:
    return (F.col("n") >= max(min_windows, 2)) & (F.col("seen") >= F.lit(ratio) * F.col("n")) & F.lit(ratio < 1.0)


def filled_chrome(filled: DataFrame, ratio: float = 0.6, min_windows: int = 4) -> DataFrame:
    """(video_id, line) of `chrome_lines`, from the filled windows, which hold the lines and tell the number of windows."""
    return _screen_lines(filled).filter(_stays(ratio, min_windows)).select("video_id", "line")


def chrome_savings(filled: DataFrame, ratio: float = 0.6, min_windows: int = 4) -> DataFrame:
    """(video_id, before, after, percent): characters on screen in all filled windows, before and after lines that stay are removed."""
    chars = F.col("seen") * F.length("line")
    lines = _screen_lines(filled).select("video_id", chars.alias("chars"), F.when(_stays(ratio, min_windows), 0).otherwise(chars).alias("left"))
    sums = lines.groupBy("video_id").agg(F.sum("chars").alias("before"), F.sum("left").alias("after"))
    return sums.withColumn("percent", F.when(F.col("before") > 0, F.floor((F.col("before") - F.col("after")) * 100 / F.col("before"))).otherwise(0))


def build_frames(log_frames: DataFrame, image_files: DataFrame, cap: int = 600) -> DataFrame:
    """Pairs image files, in text order of their path, with the log records of the video in order."""
    files = image_files.withColumn("frame_index", F.row_number().over(Window.partitionBy("video_id").orderBy("file_path")) - 1).filter(F.col("frame_index") < cap)
    log = log_frames.withColumn("frame_index", F.row_number().over(Window.partitionBy("video_id").orderBy("seq")) - 1).select("video_id", "frame_index", "pts_time", "width", "height")
    found = files.join(log, ["video_id", "frame_index"], "left").withColumn("timestamp_seconds", F.coalesce("pts_time", F.lit(0.0)))
    return found.select("video_id", "frame_index", "timestamp_seconds", "file_path", "width", "height", classify_frame("timestamp_seconds").alias("sampling_reason"))


def assign_speakers(segments: DataFrame, turns: DataFrame, min_overlap: float = 0.25, cell: float = 60.0) -> DataFrame:
    """Each segment's label of the single turn that overlaps it most; an earlier turn wins a tie; too little gives null.

    Both sides are spread over time cells of `cell` seconds, so a long video is not one join key.
    """
    def spread(df: DataFrame) -> DataFrame:
        s, e = F.col("start_seconds").cast("double"), F.col("end_seconds").cast("double")
        return _spread(df.withColumn("s", s).withColumn("e", e), F.floor(s / cell), F.floor(e / cell))

    left = spread(segments.select("video_id", "segment_id", "start_seconds", "end_seconds")).select("video_id", "k", "segment_id", "s", "e")
    right = spread(turns).select("video_id", "k", "seq", "label", F.col("s").alias("ts"), F.col("e").alias("te"))
    shared = F.least("e", "te") - F.greatest("s", "ts")
    pairs = left.join(right, ["video_id", "k"]).withColumn("shared", shared).filter("shared > 0")
    best = pairs.groupBy("video_id", "segment_id").agg(F.max_by(F.struct("label", "shared"), F.struct("shared", -F.col("seq"))).alias("best"))
    best = best.filter(F.col("best.shared") >= min_overlap).select("video_id", "segment_id", F.col("best.label").alias("speaker_label"))
    return segments.drop("speaker_label").join(best, ["video_id", "segment_id"], "left")


def speaker_labels(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with the label of their speaker; an unknown speaker gives none."""
    known = speakers.select("video_id", "speaker_id", F.col("label").alias("speaker_label"))
    return segments.drop("speaker_label").join(known, ["video_id", "speaker_id"], "left")


def speakers_from_turns(speakers: DataFrame, turns: DataFrame) -> DataFrame:
    """(video_id, label, voiceprint): declared labels and those seen only in turns."""
    every = speakers.select("video_id", "label", "voiceprint").unionByName(turns.select("video_id", "label", F.lit(None).cast("array<float>").alias("voiceprint")))
    return every.filter("label IS NOT NULL").groupBy("video_id", "label").agg(F.min("voiceprint").alias("voiceprint"))
