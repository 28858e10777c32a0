"""Channel catalogs: sync, ingested flags, selections, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import is_blank, java_trim
from timelode.operators.events import page_of


def _ingested_ids(videos: DataFrame) -> DataFrame:
    return videos.filter("source = 'youtube'").select(F.col("source_video_id").alias("youtube_video_id")).distinct()


def not_ingested(catalog: DataFrame, videos: DataFrame) -> DataFrame:
    return catalog.join(_ingested_ids(videos), "youtube_video_id", "left_anti")


def ingested_flag(catalog: DataFrame, videos: DataFrame) -> DataFrame:
    flagged = catalog.join(_ingested_ids(videos).withColumn("ingested", F.lit(True)), "youtube_video_id", "left")
    return flagged.withColumn("ingested", F.coalesce("ingested", F.lit(False)))


def list_channel_videos(catalog: DataFrame, videos: DataFrame, channel_id, not_ingested_only: bool = False, page: int = 0, size: int = 50) -> DataFrame:
    found = ingested_flag(catalog.filter(F.col("channel_id") == channel_id), videos)
    if not_ingested_only:
        found = found.filter(~F.col("ingested"))
    return page_of(found, page, size, 200, F.desc_nulls_last("published_at"), F.desc("first_seen_at"), F.asc("youtube_video_id"))


def sync_channel_catalog(catalog: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Merge of a listing (channel_id, pos, youtube_video_id, title, published_at, watch_url, metadata) into the catalog.

    Blank ids are skipped and the first copy wins; known videos are overwritten but for first_seen_at, vanished ones stay.
    """
    wanted = candidates.withColumn("youtube_video_id", java_trim("youtube_video_id")).filter(~is_blank("youtube_video_id"))
    fields = ("title", "published_at", "watch_url", "metadata")
    # partial aggregation: a channel that lists one video very often stays cheap
    new = wanted.groupBy("channel_id", "youtube_video_id").agg(F.min_by(F.struct(*fields), "pos").alias("new"))
    both = catalog.withColumn("known", F.lit(True)).join(new, ["channel_id", "youtube_video_id"], "full")
    seen = F.col("new").isNotNull()
    merged = {c: F.when(seen, F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields}
    merged |= {"last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")), "first_seen_at": F.when(F.col("known"), F.col("first_seen_at")).otherwise(now)}
    return both.select(*[merged.get(c, F.col(c)).alias(c) for c in catalog.columns])


def name_channels(channels: DataFrame, names: DataFrame) -> DataFrame:
    """Display names from a listing (channel_id, display_name), only where none is set."""
    found = names.groupBy("channel_id").agg(F.min("display_name").alias("found"))
    return channels.join(found, "channel_id", "left").withColumn("display_name", F.coalesce("display_name", "found")).drop("found")


def channels_with_counts(channels: DataFrame, catalog: DataFrame) -> DataFrame:
    sizes = catalog.groupBy("channel_id").agg(F.count("*").alias("n_videos"))
    return channels.join(sizes, "channel_id", "left").withColumn("n_videos", F.coalesce("n_videos", F.lit(0))).orderBy(F.desc("created_at"), "channel_id")


def expand_channel_selection(catalog: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls in the order asked, unknown ids) of a request (pos, youtube_video_id, perhaps req_id); with unknown ids it is to be refused."""
    asked = request.withColumn("youtube_video_id", java_trim("youtube_video_id")).filter(~is_blank("youtube_video_id"))
    known = catalog.groupBy("youtube_video_id").agg(F.min("watch_url").alias("watch_url"))
    urls = asked.join(known, "youtube_video_id").select(*[c for c in ("req_id",) if c in request.columns], "pos", "youtube_video_id", "watch_url").orderBy("pos")
    return urls, asked.join(known, "youtube_video_id", "left_anti").select("youtube_video_id").distinct()


def duplicate_videos(candidates: DataFrame, videos: DataFrame) -> DataFrame:
    """Candidates (item_id, pos, source, source_video_id) with status, error_code and the video or item they repeat."""
    known = videos.groupBy("source", "source_video_id").agg(F.min("video_id").alias("existing_video_id"))
    claim = F.row_number().over(Window.partitionBy("source", "source_video_id").orderBy("pos"))
    found = candidates.withColumn("claim", claim).join(known, ["source", "source_video_id"], "left")
    double = F.col("existing_video_id").isNotNull() | (F.col("claim") > 1)
    return found.select("item_id", "source", "source_video_id", F.when(double, "CANCELLED").otherwise("IN_PROGRESS").alias("status"), F.when(double, "DUPLICATE_VIDEO").alias("error_code"), "existing_video_id")
