"""Schemas of the domain tables."""

NOTES = "project_id STRING, key STRING, value STRING, tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, position BIGINT"
NOTE_EVENTS = "project_id STRING, key STRING, op STRING, value STRING, tags ARRAY<STRING>, ts TIMESTAMP_NTZ, seq BIGINT"
RECALL_REQUESTS = "request_id BIGINT, project_id STRING, key STRING, query STRING, tags ARRAY<STRING>, max_rows INT"
CONTEXT_DOCS = "project_id STRING, kind STRING, body STRING"
CHECKPOINTS = "project_id STRING, checkpoint_id STRING, parent_id STRING, seq BIGINT, message STRING, n_changes BIGINT, created_at TIMESTAMP_NTZ"
TOOL_EVENTS = "session_id STRING, project_id STRING, tool_name STRING, file_path STRING, ts TIMESTAMP_NTZ, event_id BIGINT"
REQUESTS = "request_id BIGINT, tool STRING, arguments STRING"
