"""Column layout of the tables every operator reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Closed sets of the data model.
TRANSCRIPT = "transcript"
QR_CODE = "frame-qr-code"
VISIBLE_LINK = "frame-visible-link"
PROGRESS_BAR = "frame-progress-bar"
SOURCES = [TRANSCRIPT, QR_CODE, VISIBLE_LINK, PROGRESS_BAR]
START, END, PRESENCE = "ad-read-start", "ad-read-end", "ad-read-presence"
FEEDBACK_JUDGMENTS = ["accurate", "false_positive", "wrong_timing", "missed_context"]
REVIEW_LABELS = ["positive", "false_positive", "wrong_timing", "duplicate", "ignored", "needs_more_data"]
FEATURE_SCHEMA_VERSION = 2

_POINT = "struct<x:double,y:double>"
LOCATION = f"struct<top_left:{_POINT},bottom_right:{_POINT}>"
RAW_FIELDS = {
    "text": "string",
    "href": "string",
    "url": "string",
    "phrase": "string",
    "phrase_group_id": "string",
    "phrase_group_ids": "array<string>",
    "context_text": "string",
    "links": "array<string>",
    "value": "string",
    "signal": "string",
    "detector": "string",
    "payload_type": "string",
    "matched_semantic": "string",
    "classification_reason": "string",
    "location": LOCATION,
    "y": "double",
    "start_x": "double",
    "end_x": "double",
    "rows": "double",
    "frame_width": "double",
    "frame_height": "double",
    "track_start_x": "double",
    "track_end_x": "double",
    "fill_ratio": "double",
    "temporal_observations": "int",
    "fill_delta": "double",
    "confirmed_at_s": "double",
}
RAW = "struct<" + ",".join(f"{k}:{v}" for k, v in RAW_FIELDS.items()) + ">"
EVIDENCE = (
    "video_id string, ev_idx bigint, source string, kind string, start_s double, end_s double, "
    f"confidence double, reason string, raw {RAW}"
)
EVIDENCE_COLUMNS = ["video_id", "ev_idx", "source", "kind", "start_s", "end_s", "confidence", "reason", "raw"]
CUE = "video_id string, cue_idx int, start_s double, dur_s double, text string"
PROFILE = (
    "struct<start_offset_s:double,end_offset_s:double,training_examples:bigint,validation_examples:bigint,"
    "video_groups:bigint,baseline_mae_s:double,calibrated_mae_s:double>"
)
MODEL = (
    "model_id string, model_version string, feature_schema_version int, created_at string, promoted_at string, "
    "intercept double, weights map<string,double>, thresholds map<string,double>, metrics map<string,double>, "
    "training_set_summary map<string,double>, "
    f"boundary_calibration struct<global:{PROFILE},by_source:map<string,{PROFILE}>>"
)
SNAPSHOT = (
    "array<struct<source:string,kind:string,start_s:double,end_s:double,"
    "confidence:double,reason:string,detail:string>>"
)
FEEDBACK = (
    "id string, received_at timestamp, created_at string, client_id string, video_url string, video_id string, "
    "occurrence_id string, occurrence_type string, source string, start_s double, end_s double, summary string, "
    "reason string, feedback string, notes string, model_id string, model_version string, model_source string, "
    "feature_schema_version int, heuristic_confidence double, model_confidence double, "
    f"candidate_features map<string,double>, evidence_snapshot {SNAPSHOT}, transcript_context string"
)
REVIEW = (
    "id string, feedback_id string, label string, notes string, "
    "boundary_correction struct<start_s:double,end_s:double>, reviewed_at timestamp"
)


def raw(**given: Column) -> Column:
    """Evidence detail struct; fields that are not given are NULL."""
    return F.struct(
        *[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in RAW_FIELDS.items()]
    )


def empty_raw() -> Column:
    return F.lit(None).cast(RAW)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
