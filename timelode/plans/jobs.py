"""Whole jobs: compositions of sources, operators and writers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.functions.scalars import java_trim
from timelode.operators import catalog, events, fusion, knowledge, search, sinks, videos
from timelode.sources import parsers


def fuse_job(tables: dict[str, DataFrame], default_lang: str = "en") -> dict[str, DataFrame]:
    """Raw transcripts and diarization with frames and lines (raw, or parsed already), fused; rows of the processed videos are replaced."""
    heads, segments = parsers.parse_transcripts(tables["raw_transcripts"])
    turns, declared = parsers.parse_diarization(tables["raw_diarization"])
    speakers = fusion.speakers_from_turns(declared, turns).withColumn("speaker_id", F.col("label"))
    segments = fusion.assign_speakers(segments, turns).withColumnRenamed("speaker_label", "speaker_id")
    lines = parsers.parse_ocr(tables["raw_ocr"], default_lang) if "raw_ocr" in tables else tables["ocr_results"]
    fused = fusion.fuse_segments(tables["videos"], segments, speakers, tables["video_frames"], lines)
    out = {"transcriptions": heads, "transcription_segments": segments, "speakers": speakers, "ocr_results": lines, "multimodal_segments": fused}
    if "multimodal_segments" in tables:
        out["multimodal_segments"] = sinks.replace_for_videos(tables["multimodal_segments"], fused, tables["videos"])
    return out


def knowledge_job(tables: dict[str, DataFrame], extract_fn: Callable[[str, str], str], embed_fn: Callable | None = None, system: str = "", dims: int = 1536, cap: int = 300) -> dict[str, DataFrame]:
    """Units of fused rows: batches, prompts, the user's model, parsed and cleaned; a failed batch leaves the video's old units.

    A video keeps its first `cap` units, all of them where cap is 0.
    """
    prompts = knowledge.render_batch_prompt(knowledge.batch_by_budget(tables["multimodal_segments"]))

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: extract_fn(system, t))

    # the model is asked once: its replies are kept before they are read twice
    replies = prompts.select("video_id", "batch", ask("prompt").alias("json")).checkpoint()
    drafts, failed = parsers.parse_units(replies)
    verdict = knowledge.extraction_verdict(replies, failed)
    good = verdict.filter("not fails").select("video_id")
    units = knowledge.clean_units(knowledge.filter_units(drafts, cap=cap)).join(good, "video_id", "left_semi")
    if embed_fn is not None:
        text = units.withColumn("_text", F.concat_ws("\n", "title", "content"))
        units = search.embed_texts(text, "_text", embed_fn, dims=dims, on_error="null").drop("_text")
    if "knowledge_units" in tables:
        units = sinks.replace_for_videos(tables["knowledge_units"], units, good)
    return {"knowledge_units": units, "verdict": verdict}


def context_job(tables: dict[str, DataFrame], embed_fn: Callable, dims: int = 1536) -> dict[str, DataFrame]:
    """Search chunks with vectors; a wrong reply of the model fails the job; refused videos keep their old chunks."""
    chunks, refused = search.build_chunks(tables["multimodal_segments"], tables["transcriptions"])
    embedded = search.embed_texts(chunks, "content", embed_fn, dims=dims)
    if "context_chunks" in tables:
        done = tables["videos"].select("video_id").join(refused.select("video_id"), "video_id", "left_anti")
        embedded = sinks.replace_for_videos(tables["context_chunks"], embedded, done)
    return {"context_chunks": embedded, "refused": refused}


def ocr_job(tables: dict[str, DataFrame], raw: DataFrame, default_lang: str = "en") -> dict[str, DataFrame]:
    """Lines of frames; a video all of whose frames failed or are missing keeps its old lines."""
    lines = videos.filter_ocr_lines(parsers.parse_ocr(raw, default_lang), tables["video_frames"])
    counts = lines.groupBy("frame_id").agg(F.count("*").alias("n_lines"))
    outcome = F.when(F.try_parse_json("json").isNull(), "failed").when(F.col("n_lines").isNull(), "skipped").otherwise("done")
    results = raw.join(counts, "frame_id", "left").select("frame_id", outcome.alias("outcome"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    verdict = videos.ocr_phase_verdict(tables["video_frames"], results)
    good = verdict.filter("not fails").select("video_id")
    lines = lines.join(good, "video_id", "left_semi")
    if "ocr_results" in tables:
        old = tables["ocr_results"].join(tables["video_frames"].select("frame_id", "video_id"), "frame_id")
        columns = [c for c in old.columns if c in lines.columns]
        lines = sinks.replace_for_videos(old.select(columns), lines.select(columns), good)
    return {"ocr_results": lines, "verdict": verdict}


def ingest_job(tables: dict[str, DataFrame], requests: DataFrame, metadata: DataFrame, now: Column) -> dict[str, DataFrame]:
    """URLs taken in, their metadata parsed, duplicates cancelled, the rest inserted as downloaded videos, with events."""
    verdicts = events.intake_urls(requests)
    items, created = events.intake_items(verdicts, now)
    parsed = items.select("item_id", "run_id", "url").join(parsers.parse_video_metadata(metadata), "url")
    # the metadata of one url may tell of several videos, and of one video more than once: one row an item and video
    video = ["item_id", "source", "source_video_id"]
    told = [c for c in parsed.columns if c not in video]
    parsed = parsed.groupBy(*video).agg(F.min(F.struct(*told)).alias("told")).select(*video, "told.*")
    judged = catalog.duplicate_videos(parsed.withColumn("pos", F.col("item_id")), tables["videos"])
    fresh = judged.filter("status <> 'CANCELLED'").select(*video)
    inserted = parsed.join(fresh.select(*(F.col(c).alias(f"_{c}") for c in video)), F.expr(" AND ".join(f"{c} <=> _{c}" for c in video)), "left_semi")
    inserted = inserted.select(F.concat_ws(":", "source", "source_video_id").alias("video_id"), "source", "source_video_id", "channel_name", "title", "description", "file_path", F.lit("DOWNLOADED").alias("status"), "duration_seconds", "published_at")
    # an item is cancelled, once, where all its videos are known
    ended = judged.groupBy("item_id").agg(F.every(F.col("status") == "CANCELLED").alias("all"), F.max("error_code").alias("error_code")).filter("all")
    cancelled = ended.select("item_id", F.lit("CANCELLED").alias("status"), "error_code").join(items.select("item_id", "run_id", "phase", "attempt"), "item_id").withColumn("failed_phase", F.lit("METADATA"))
    return {"verdicts": verdicts, "items": items, "videos": inserted, "cancelled": cancelled, "events": created.unionByName(sinks.transition_events(cancelled, "ITEM_CANCELLED", now), allowMissingColumns=True)}


def channel_job(tables: dict[str, DataFrame], listings: DataFrame, now: Column, selection: DataFrame | None = None) -> dict[str, DataFrame]:
    """Listings merged into the catalog, channels named, and what is not ingested yet.

    A `selection` (req_id, pos, youtube_video_id) is expanded to urls of the merged catalog and taken in as run items;
    a request with an unknown id is refused whole.
    """
    channels, candidates = parsers.parse_channel_listing(listings)
    merged = catalog.sync_channel_catalog(tables["youtube_channel_videos"], candidates, now)
    out = {
        "youtube_channels": catalog.name_channels(tables["youtube_channels"], channels),
        "youtube_channel_videos": merged,
        "not_ingested": catalog.not_ingested(merged, tables["videos"]),
    }
    if selection is not None:
        _, unknown = catalog.expand_channel_selection(merged, selection)
        refused = selection.withColumn("youtube_video_id", java_trim("youtube_video_id")).join(unknown, "youtube_video_id").select("req_id").distinct()
        urls, _ = catalog.expand_channel_selection(merged, selection.join(refused, "req_id", "left_anti"))
        verdicts = events.intake_urls(urls.select("req_id", "pos", F.col("watch_url").alias("url")))
        items, created = events.intake_items(verdicts, now)
        out |= {"refused": refused, "verdicts": verdicts, "items": items, "events": created}
    return out
