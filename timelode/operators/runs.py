"""Listings and details of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.events import LIVE, page_of

# Rank of a video's status for the preview, best first.
PREVIEW_RANKS = ("COMPLETED", "PROCESSING", "TRANSCRIBING", "DOWNLOADED", "DOWNLOADING", "EXTRACTING", "PENDING", "FAILED")


def list_runs(runs: DataFrame, status=None, created_after=None, sort_by: str = "created_at", page: int = 0, size: int = 50) -> DataFrame:
    found = runs if status is None else runs.filter(F.col("status") == status)
    if created_after is not None:
        found = found.filter(F.col("created_at") >= created_after)
    key = sort_by if sort_by in ("created_at", "updated_at") else "created_at"
    return page_of(found, page, size, 200, F.desc(key), F.desc("run_id"))


def run_previews(items: DataFrame, videos: DataFrame) -> DataFrame:
    """(run_id, n_videos, video_id, title): joined rows per run, and the video that stands for it."""
    rank = F.array_position(F.array(*map(F.lit, PREVIEW_RANKS)), F.col("video_status"))
    known = videos.select("video_id", F.col("status").alias("video_status"), "title", F.col("created_at").alias("video_created_at"))
    joined = items.select("run_id", "video_id").join(known, "video_id")
    order = F.struct(F.coalesce(F.nullif(rank, F.lit(0)), F.lit(100)).alias("r"), F.col("video_created_at").isNull().alias("n"), "video_created_at", "video_id")
    return joined.groupBy("run_id").agg(F.count("*").alias("n_videos"), F.min_by(F.struct("video_id", "title"), order).alias("p")).select("run_id", "n_videos", "p.video_id", "p.title")


def run_details(runs: DataFrame, items: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per item with its video's channel and title, by run and created_at; a run without items gets one row made of itself."""
    known = videos.select("video_id", "channel_name", "title")
    told = ("run_id", "item_id", "url", "status", "phase", "attempt", "channel_name", "title", "created_at")
    real = items.join(known, "video_id", "left").withColumn("attempt", F.coalesce("attempt", F.lit(1))).select(*told, F.lit(0).alias("_runs"))
    none = F.lit(None).cast("string")
    own = {"item_id": F.lit(None).cast(items.schema["item_id"].dataType), "url": F.col("video_url"), "attempt": F.lit(1), "channel_name": none, "title": none}
    made = runs.select(*[own.get(c, F.col(c)).alias(c) for c in told], F.lit(1).alias("_runs"))
    # items and runs meet in the exchange that also puts them in order: a row is a run's own where `_runs` is 1
    rows, by = real.unionByName(made).repartitionByRange("run_id"), Window.partitionBy("run_id")
    rows = rows.withColumn("_known", F.max("_runs").over(by)).withColumn("_items", F.min("_runs").over(by) == 0)
    kept = ((F.col("_runs") == 0) & (F.col("_known") == 1) & F.col("run_id").isNotNull()) | ((F.col("_runs") == 1) & (F.col("run_id").isNull() | ~F.col("_items")))
    return rows.filter(kept).select(*told).orderBy("run_id", "created_at", "item_id")


def live_summaries(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Runs of the distinct requested ids (pos, run_id) in the order first asked; unknown ids drop out."""
    first = ids.groupBy("run_id").agg(F.min("pos").alias("pos"))
    return first.join(runs, "run_id").orderBy("pos")


def live_runs(runs: DataFrame) -> DataFrame:
    """Pending and running runs, newest first."""
    parts = [runs.filter(F.col("status") == s) for s in LIVE]
    return parts[0].unionByName(parts[1]).orderBy(F.desc("created_at"), F.desc("run_id"))


def live_elsewhere(runs: DataFrame, page: DataFrame) -> DataFrame:
    """Live runs that the shown page does not hold."""
    return live_runs(runs).join(page.select("run_id"), "run_id", "left_anti")
