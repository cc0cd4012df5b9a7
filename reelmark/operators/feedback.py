"""Feedback store: keys, first write wins, reviews, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import js_round, plain_text
from ..functions.once import fenced
from ..sources.schemas import FEATURE_SCHEMA_VERSION, START

# Fixed values (must match for right results).
KEY_VERSION = 1
TRAINING_LABEL = {"positive": 1, "false_positive": 0, "duplicate": 0, "ignored": 0}
NOT_REVIEWED = "Feedback has not been reviewed yet."
NO_FEATURES = "Feedback payload does not include candidate features."
NOT_FOR_TRAINING = {
    "wrong_timing": "wrong_timing is stored for boundary analysis, not confidence training.",
    "needs_more_data": "needs_more_data is stored for investigation, not confidence training.",
}
NO_EXAMPLES = "No reviewed training examples are available for feature schema {schema}."
ONE_CLASS = (
    "Training requires at least one positive and one negative reviewed example for feature schema {schema}."
)


def _json_text(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def _json_number(value: Column) -> Column:
    return F.coalesce(plain_text(value, 3), F.lit("null"))


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def dedup_key(feedback: DataFrame) -> DataFrame:
    """Adds ``dedup_key``: a digest of who said what about which moment; NULL without client or video."""
    client, video = _given(F.col("client_id")), F.coalesce(F.col("video_id"), F.col("video_url"))
    has_video = F.coalesce(_given(F.col("video_id")), _given(F.col("video_url"))).isNotNull()
    parts = [
        ("version", F.lit(str(KEY_VERSION))),
        ("clientId", _json_text(client)),
        ("video", _json_text(video)),
        ("occurrenceId", _json_text(F.col("occurrence_id"))),
        ("occurrenceType", _json_text(F.col("occurrence_type"))),
        ("source", _json_text(F.col("source"))),
        ("startSeconds", _json_number(F.col("start_s"))),
        ("endSeconds", _json_number(F.col("end_s"))),
        ("feedback", _json_text(F.col("feedback"))),
    ]
    pieces = []
    for i, (name, value) in enumerate(parts):
        pieces += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), value]
    identity = F.concat(*pieces, F.lit("}"))
    key = F.concat(F.lit(f"feedback-v{KEY_VERSION}-"), F.sha2(identity, 256))
    return fenced(feedback, dedup_key=F.when(client.isNotNull() & has_video, key))


def first_write_wins(keyed: DataFrame) -> DataFrame:
    """First row per key; rows without a key always stay. Repeats are dropped before the shuffle."""
    cols = keyed.columns
    first = (
        keyed.filter("dedup_key is not null")
        .groupBy("dedup_key")
        .agg(F.min_by(F.struct(*[c for c in cols if c != "dedup_key"]), F.struct("received_at", "id")).alias("_row"))
        .select("dedup_key", "_row.*")
    )
    return first.select(*cols).unionByName(keyed.filter("dedup_key is null").select(*cols))


def retry_counts(keyed: DataFrame) -> DataFrame:
    """Per key: the stored id and how many retries were merged into it."""
    return (
        keyed.filter("dedup_key is not null")
        .groupBy("dedup_key")
        .agg(
            F.min_by("id", F.struct("received_at", "id")).alias("stored_id"),
            (F.count(F.lit(1)) - 1).alias("retries"),
        )
    )


def resolve_retries(keyed: DataFrame) -> DataFrame:
    """Every incoming row with the stored row it resolves to."""
    stored = retry_counts(keyed).select("dedup_key", "stored_id")
    found = keyed.filter("dedup_key is not null").select("id", "dedup_key").join(stored, "dedup_key")
    alone = keyed.filter("dedup_key is null").select("id", "dedup_key", F.col("id").alias("stored_id"))
    return found.unionByName(alone).withColumn("deduplicated", F.col("id") != F.col("stored_id"))


def backfill_keys(stored: DataFrame) -> DataFrame:
    """Keys for unkeyed rows, oldest first, never a key already taken: ``id, dedup_key``."""
    taken = stored.filter("dedup_key is not null").select("dedup_key").distinct()
    fresh = dedup_key(stored.filter("dedup_key is null").drop("dedup_key")).filter("dedup_key is not null")
    return (
        fresh.groupBy("dedup_key")
        .agg(F.min_by("id", F.struct("received_at", "id")).alias("id"))
        .join(taken, "dedup_key", "left_anti")
        .select("id", "dedup_key")
    )


def latest_review(review: DataFrame) -> DataFrame:
    cols = [c for c in review.columns if c != "feedback_id"]
    return (
        review.groupBy("feedback_id")
        .agg(F.max_by(F.struct(*cols), F.struct("reviewed_at", "id")).alias("_row"))
        .select("feedback_id", "_row.*")
    )


def with_review(feedback: DataFrame, review: DataFrame) -> DataFrame:
    """Feedback with its latest review (NULL columns while pending)."""
    last = latest_review(review).select(
        F.col("feedback_id").alias("id"),
        F.col("label").alias("review_label"),
        F.col("notes").alias("review_notes"),
        F.col("boundary_correction").alias("correction"),
        "reviewed_at",
    )
    return feedback.join(last, "id", "left")


def source_of(source: Column, occurrence_type: Column) -> Column:
    return F.coalesce(source, occurrence_type)


def training_label(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in TRAINING_LABEL.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def training_examples(feedback: DataFrame, review: DataFrame) -> DataFrame:
    """Rows usable for training; a later review replaces an earlier one."""
    labels = latest_review(review).withColumn("label", training_label(F.col("label"))).filter("label is not null")
    usable = feedback.filter("candidate_features is not null")
    return usable.join(
        labels.select(F.col("feedback_id").alias("id"), "label", "reviewed_at"), "id"
    ).select(
        F.concat(F.lit("example_"), F.col("id")).alias("id"),
        F.col("id").alias("feedback_id"),
        "video_id",
        "occurrence_id",
        "label",
        "feature_schema_version",
        F.col("candidate_features").alias("features"),
        F.col("reviewed_at").alias("created_at"),
    )


def purge_stale_examples(example: DataFrame) -> DataFrame:
    cols = [c for c in example.columns if c != "feedback_id"]
    return (
        example.groupBy("feedback_id")
        .agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("_row"))
        .select("feedback_id", "_row.*")
        .select(*example.columns)
    )


def dataset_rows(feedback: DataFrame, review: DataFrame, schema: int = FEATURE_SCHEMA_VERSION) -> DataFrame:
    """One row per feedback with the first reason that keeps it out of training."""
    df = with_review(feedback, review)
    label, version = F.col("review_label"), F.col("feature_schema_version")
    n_features = F.coalesce(F.size("candidate_features"), F.lit(0))
    n_features = F.when(F.col("candidate_features").isNull(), F.lit(0)).otherwise(n_features)
    trained = training_label(label)
    compatible = F.coalesce(version == schema, F.lit(False))
    reason = (
        F.when(label.isNull(), F.lit(NOT_REVIEWED))
        .when(n_features == 0, F.lit(NO_FEATURES))
        .when(label == "wrong_timing", F.lit(NOT_FOR_TRAINING["wrong_timing"]))
        .when(label == "needs_more_data", F.lit(NOT_FOR_TRAINING["needs_more_data"]))
        .when(trained.isNull(), F.concat(label, F.lit(" is not used for confidence training.")))
        .when(
            ~compatible,
            F.concat(
                F.lit("Feature schema "),
                F.coalesce(version.cast("string"), F.lit("unknown")),
                F.lit(f" is not compatible with active schema {schema}."),
            ),
        )
    )
    correction = F.when(label == "wrong_timing", F.col("correction"))
    return df.select(
        F.col("id").alias("feedback_id"),
        "occurrence_id",
        "video_id",
        source_of(F.col("source"), F.col("occurrence_type")).alias("source"),
        "start_s",
        "received_at",
        "reviewed_at",
        "review_label",
        trained.alias("training_label"),
        "feature_schema_version",
        n_features.alias("feature_count"),
        compatible.alias("compatible"),
        reason.isNull().alias("trainable"),
        reason.alias("exclusion_reason"),
        correction["start_s"].alias("corrected_start_s"),
        correction["end_s"].alias("corrected_end_s"),
        js_round(correction["start_s"] - F.col("start_s"), 3).alias("start_offset_s"),
        js_round(correction["end_s"] - F.col("end_s"), 3).alias("end_offset_s"),
        correction.isNotNull().alias("boundary_trainable"),
    )


def training_readiness(example: DataFrame, schema: int = FEATURE_SCHEMA_VERSION) -> DataFrame:
    compatible = F.coalesce(F.col("feature_schema_version") == schema, F.lit(False))
    one = example.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count(F.when(compatible, 1)).alias("compatible_examples"),
        F.count(F.when(compatible & (F.col("label") == 1), 1)).alias("positive_examples"),
    )
    one = one.withColumn("negative_examples", F.col("compatible_examples") - F.col("positive_examples"))
    blocker = F.when(
        F.col("compatible_examples") == 0,
        F.lit(NO_EXAMPLES.format(schema=schema)),
    ).when(
        (F.col("positive_examples") == 0) | (F.col("negative_examples") == 0),
        F.lit(ONE_CLASS.format(schema=schema)),
    )
    return one.select(
        F.lit(schema).alias("feature_schema_version"),
        "total_examples",
        "compatible_examples",
        (F.col("total_examples") - F.col("compatible_examples")).alias("incompatible_examples"),
        "positive_examples",
        "negative_examples",
        blocker.isNull().alias("ready"),
        blocker.alias("blocker"),
    )


def _is_time(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))


def boundary_examples(feedback: DataFrame, review: DataFrame) -> DataFrame:
    """Reviewed boundary corrections with the evidence source they are attributed to."""
    df = with_review(feedback, review).filter("review_label = 'wrong_timing' and correction is not null")
    start = F.col("start_s")
    ranked = F.transform(
        "evidence_snapshot",
        lambda e, i: F.struct(
            F.when(e["kind"] == START, 0).otherwise(1).alias("rank"),
            F.abs(e["start_s"] - start).alias("far"),
            i.alias("i"),
            e["source"].alias("source"),
        ),
    )
    primary = F.array_min(ranked)["source"]
    fallback = source_of(F.col("source"), F.col("occurrence_type"))
    source = F.when(F.col("occurrence_type") == "candidate", F.coalesce(primary, fallback)).otherwise(fallback)
    return df.filter(_is_time(start) & _is_time(F.col("correction.start_s"))).select(
        F.col("id").alias("feedback_id"),
        "video_id",
        source.alias("source"),
        start.alias("predicted_start_s"),
        F.when(_is_time(F.col("end_s")), F.col("end_s")).alias("predicted_end_s"),
        F.col("correction.start_s").alias("corrected_start_s"),
        F.when(_is_time(F.col("correction.end_s")), F.col("correction.end_s")).alias("corrected_end_s"),
    )
