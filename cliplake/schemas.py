"""Schemas of the stored tables and their ordered migrations."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "videos": "id string, platform string, platform_id string, url string, title string, uploader string, upload_date string, duration_sec double, file_path string, file_size_bytes bigint, status string, error_message string, created_at timestamp, updated_at timestamp",
    "transcripts": "video_id string, language string, text_full string, segments_json string, whisper_model string, duration_sec double, created_at timestamp",
    "keyframes": "id bigint, video_id string, frame_index int, timestamp_sec double, file_path string, strategy string",
    "vision_descriptions": "keyframe_id bigint, description string, objects_json string, text_in_frame string, vlm_backend string, vlm_model string",
    "analyses": "video_id string, summary string, topics_json string, hooks_json string, style_json string, engagement_signals_json string, full_json string, created_at timestamp",
    "audio_events": "id bigint, video_id string, event_type string, label string, start_sec double, end_sec double, confidence double",
    "speaker_segments": "video_id string, speaker string, start_sec double, end_sec double",
    "scores": "video_id string, hook_strength double, information_density double, emotional_impact double, shareability double, overall double, reasoning string, model_used string",
    "batches": "id string, source string, total_urls int, completed int, failed int, status string, created_at timestamp, updated_at timestamp",
    "batch_items": "batch_id string, url string, video_id string, status string, error_message string",
}
#: version -> tables that the version added.
MIGRATIONS: dict[int, tuple[str, ...]] = {
    1: ("videos", "transcripts", "keyframes", "vision_descriptions", "analyses", "batches", "batch_items"),
    2: ("audio_events", "speaker_segments"),
    3: ("scores",),
}
VERSION = max(MIGRATIONS)
