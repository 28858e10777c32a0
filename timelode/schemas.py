"""Table schemas and the closed value sets of the data model."""

from __future__ import annotations

# Fixed values of the data model, in their order.
RUN_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "CANCELLED")
PHASES = ("CREATED", "METADATA", "DOWNLOAD", "PERSIST", "TRANSCRIBE", "DIARIZE", "FRAME_SAMPLE", "OCR", "FUSE", "KNOWLEDGE", "CONTEXT", "DONE")
WORK_PHASES = PHASES[1:-1]
OPTIONAL_PHASES = PHASES[4:-1]
EVENT_TYPES = ("ITEM_CREATED", "ITEM_PHASE_ENTERED", "ITEM_PHASE_COMPLETED", "ITEM_VIDEO_ATTACHED", "ITEM_COMPLETED", "ITEM_FAILED", "ITEM_CANCELLED", "ITEM_RETRY_REQUESTED")
ERROR_CODES = ("DUPLICATE_VIDEO", "UPSTREAM_TOOL_FAILURE", "TRANSCRIPTION_FAILURE", "INVALID_METADATA", "UNEXPECTED")
VIDEO_STATUSES = ("PENDING", "DOWNLOADING", "DOWNLOADED", "EXTRACTING", "TRANSCRIBING", "PROCESSING", "COMPLETED", "FAILED")
UNIT_TYPES = ("ENTITY", "TOPIC", "SUMMARY", "CLAIM", "QUESTION", "PROCEDURE")

# The columns of the data model.
TABLES = {
    "pipeline_runs": "run_id string, status string, phase string, error_code string, error string, video_url string, skip_phases string, phase_updated_at timestamp, created_at timestamp, updated_at timestamp",
    "videos": "video_id string, source string, source_video_id string, channel_name string, title string, description string, file_path string, status string, duration_seconds int, published_at timestamp, downloaded_at timestamp, created_at timestamp, metadata string",
    "pipeline_run_items": "item_id string, run_id string, url string, status string, phase string, failed_phase string, error_code string, error string, video_id string, lease_owner string, attempt int, lease_expires_at timestamp, phase_updated_at timestamp, created_at timestamp",
    "pipeline_run_item_events": "event_id string, item_id string, run_id string, event_type string, attempt int, phase string, previous_phase string, status string, error_code string, error_message string, video_id string, metadata string, occurred_at timestamp",
    "speakers": "video_id string, speaker_id string, label string, display_name string, voiceprint array<float>",
    "transcriptions": "video_id string, transcription_id string, language string, full_text string, provider string, status string",
    "transcription_segments": "video_id string, segment_id string, start_seconds float, end_seconds float, text string, speaker_id string",
    "video_frames": "video_id string, frame_id string, frame_index int, timestamp_seconds double, file_path string, sampling_reason string, width int, height int",
    "ocr_results": "frame_id string, line_no int, text string, confidence float, bbox array<array<double>>, language string, created_at timestamp",
    "multimodal_segments": "video_id string, segment_index int, start_seconds double, end_seconds double, transcript_text string, ocr_text string, speaker_labels array<string>",
    "knowledge_units": "unit_id string, video_id string, type string, title string, content string, metadata string, start_seconds double, end_seconds double, embedding array<float>, created_at timestamp",
    "context_chunks": "video_id string, chunk_index int, content string, embedding array<float>",
    "youtube_channels": "channel_id string, channel_url string, display_name string, status string, metadata string, last_sync_attempt_at timestamp, last_sync_success_at timestamp, last_error string, created_at timestamp",
    "youtube_channel_videos": "channel_id string, youtube_video_id string, title string, published_at timestamp, watch_url string, metadata string, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp",
}
