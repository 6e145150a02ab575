"""Explicit schemas of stored tables, as DDL; nothing is inferred on read."""

from __future__ import annotations

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
RAW_TRACE = "session_id string, observer_name string, content string, content_type string, timestamp double, ts double, line_no bigint"
RAW_LINE = "observer_name string, content string, content_type string, timestamp string"
BOUNDING_BOX = f"screenshot_path string, x double, y double, box {BOX}, frame_size struct<width: int, height: int>, timestamp double"
TRAJECTORY = "id string, action string, state_before string, state_after string, time_before string, time_after string, time_range double"
GROUNDED = (
    "status string, goal string, active_application string, visual_content string, ocr_results string, md_results string, cost string, "
    "warnings array<string>, error string, completed_at string, provenounce_id string, original_index bigint, " + TRAJECTORY
)
DELIVERABLE = "struct<kind: string, target: string, expected_state: string, evidence_refs: array<string>>"
CRITERION = "struct<predicate: string, verifier: string, evidence_refs: array<string>, confidence: double>"
OUTCOME = "struct<status: string, description: string, evidence_refs: array<string>>"
FINDINGS = "session_id string, root_id string, path string, rule_id string, severity string, detail string"
