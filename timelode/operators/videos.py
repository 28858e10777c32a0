"""Videos, their segments, speakers, frames and units: listings, counts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import is_blank, java_trim, transcript_snippet
from timelode.operators.events import page_of


def list_videos(videos: DataFrame, status=None, source=None, channel=None, page: int = 0, size: int = 50) -> DataFrame:
    """Newest first; `%` and `_` in `channel` are wildcards."""
    found = videos
    if status is not None and status.strip() and status.strip().upper() != "ALL":
        found = found.filter(F.col("status") == status.strip().upper())
    if source:
        found = found.filter(F.col("source") == source)
    if channel:
        found = found.filter(F.lower("channel_name").like(f"%{channel.lower()}%"))
    return page_of(found, page, size, 200, F.desc("created_at"), F.desc("video_id"))


def timeline_window(fused: DataFrame, video_id=None, from_seconds: float | None = None, to_seconds: float | None = None) -> DataFrame:
    """Fused rows that overlap [from, to), of one video or of all."""
    found = fused if video_id is None else fused.filter(F.col("video_id") == video_id)
    if from_seconds is not None:
        found = found.filter(F.col("end_seconds") > from_seconds)
    if to_seconds is not None:
        found = found.filter(F.col("start_seconds") < to_seconds)
    return found.orderBy("video_id", "segment_index")


def list_segments(segments: DataFrame, video_id, page: int = 0, size: int = 50) -> DataFrame:
    return page_of(segments.filter(F.col("video_id") == video_id), page, size, 200, F.asc("start_seconds"), F.asc("segment_id"))


def list_units(units: DataFrame, video_id, type: str | None = None, order: str = "created") -> DataFrame:
    found = units.filter(F.col("video_id") == video_id)
    if type is not None:
        found = found.filter(F.col("type") == type)
    return found.orderBy(F.asc("created_at") if order == "created" else F.asc_nulls_last("start_seconds"), "unit_id")


def speakers_with_counts(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    counts = segments.filter("speaker_id IS NOT NULL").groupBy("video_id", "speaker_id").agg(F.count("*").alias("n_segments"))
    return speakers.join(counts, ["video_id", "speaker_id"], "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


def rename_speakers(speakers: DataFrame, renames: DataFrame) -> DataFrame:
    """`renames`: (video_id, speaker_id, display_name); a blank name clears the old one."""
    wanted = renames.select("video_id", "speaker_id", F.when(~is_blank("display_name"), java_trim("display_name")).alias("new"), F.lit(True).alias("renamed"))
    found = speakers.join(wanted, ["video_id", "speaker_id"], "left")
    return found.withColumn("display_name", F.when(F.col("renamed"), F.col("new")).otherwise(F.col("display_name"))).drop("new", "renamed")


def filter_ocr_lines(lines: DataFrame, frames: DataFrame, min_confidence: float = 0.5, min_lines: int = 1, cap: int = 10_000) -> DataFrame:
    """Lines that are not blank and not too doubtful (an unknown confidence passes), of frames with enough of them, the first `cap` per video."""
    good = lines.filter(~is_blank("text") & (F.col("confidence").isNull() | (F.col("confidence") >= min_confidence)))
    if min_lines > 1:
        good = good.join(good.groupBy("frame_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_lines).select("frame_id"), "frame_id", "left_semi")
    placed = good.join(frames.select("frame_id", "video_id", "timestamp_seconds"), "frame_id")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp_seconds", "frame_id", "line_no"))
    return placed.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def ocr_by_frame(frames: DataFrame, ocr: DataFrame) -> DataFrame:
    """Frames that have lines, each with its lines in order."""
    nested = ocr.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    return frames.join(nested, "frame_id")


def ocr_frame_page(frames: DataFrame, ocr: DataFrame, video_id, page: int = 0, size: int = 50) -> DataFrame:
    """One page of a video's frames with lines, by time; pages count frames, not lines."""
    shown = frames.filter(F.col("video_id") == video_id).join(ocr.select("frame_id"), "frame_id", "left_semi")
    return ocr_by_frame(page_of(shown, page, size, 200, F.asc("timestamp_seconds"), F.asc("frame_id")), ocr).orderBy("timestamp_seconds", "frame_id")


def video_counts(videos: DataFrame, speakers: DataFrame, frames: DataFrame, ocr: DataFrame, fused: DataFrame, segments: DataFrame, units: DataFrame) -> DataFrame:
    shown = frames.join(ocr.select("frame_id").distinct(), "frame_id", "left_semi")
    found = videos.select("video_id")
    for name, df in (("n_speakers", speakers), ("n_ocr_frames", shown), ("n_fused", fused), ("n_segments", segments), ("n_units", units)):
        found = found.join(df.groupBy("video_id").agg(F.count("*").alias(name)), "video_id", "left")
    return found.fillna(0)


def video_detail(videos: DataFrame, transcriptions: DataFrame, counts: DataFrame) -> DataFrame:
    text = transcriptions.groupBy("video_id").agg(F.min("full_text").alias("full_text"))
    found = videos.select("video_id", "title", "channel_name").join(text.withColumn("has_transcript", F.lit(True)), "video_id", "left").join(counts, "video_id", "left")
    chars = F.coalesce(F.length("full_text"), F.lit(0))
    return found.withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False))).withColumn("n_chars", chars).withColumn("snippet", transcript_snippet("full_text")).drop("full_text")


def stale_videos(units: DataFrame, videos: DataFrame, current: int = 3, limit: int | None = 100) -> tuple[DataFrame, bool]:
    """(report, truncated): videos with units of an older prompt version, those touched last first."""
    version = F.try_to_number(F.get_json_object("metadata", "$.prompt_version"), F.lit("999999999")).cast("int")
    of = units.select("video_id", "created_at", version.alias("v")).filter("v IS NOT NULL").join(videos.select("video_id", "title", "channel_name"), "video_id")
    report = of.groupBy("video_id", "title", "channel_name").agg(F.count("*").alias("n_units"), F.min("v").alias("oldest"), F.max("v").alias("newest"), F.max("created_at").alias("last_created"))
    report = report.filter(F.col("oldest") < current).orderBy(F.desc("last_created"), "video_id")
    if limit is None:
        return report, False
    limit = max(1, min(limit, 500))
    return report.limit(limit), report.limit(limit + 1).count() > limit


def ocr_phase_verdict(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Per video what became of its frames; with all of them failed or missing the video fails and keeps its old rows."""
    of = frames.select("video_id", "frame_id").join(results.select("frame_id", "outcome", "n_lines"), "frame_id", "left")
    outcome = F.coalesce("outcome", F.lit("missing"))
    sums = of.groupBy("video_id").agg(F.count("*").alias("total"), *[F.count(F.when(outcome == s, 1)).alias(s) for s in ("failed", "missing", "skipped")], F.count(F.when(F.col("n_lines") > 0, 1)).alias("with_text"))
    return sums.withColumn("fails", F.col("failed") + F.col("missing") == F.col("total"))
