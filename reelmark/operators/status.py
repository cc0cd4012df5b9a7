"""Scan status and recent activity per video (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import is_finite

# Fixed values (must match for right results).
PHASES = ["idle", "starting", "transcript", "frames", "fusion", "done", "permission", "stopped", "error"]
RUNNING_PHASES = ["starting", "transcript", "frames", "fusion"]
STALE_AFTER_S = 15.0
RECENT_ROWS = 16


def _count(value: Column) -> Column:
    """Whole number of at least zero."""
    number = value.cast("double")
    return F.when(is_finite(number), F.greatest(F.lit(0), F.floor(number))).otherwise(F.lit(0)).cast("bigint")


def normalize_status(status: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("phase").isin(PHASES), F.lit(False))
    progress = F.when(is_finite(F.col("progress")), F.col("progress")).otherwise(F.lit(0.0))
    return status.select(
        "video_id",
        F.col("updated_at").cast("timestamp").alias("updated_at"),
        F.when(known, F.col("phase")).otherwise(F.lit("idle")).alias("phase"),
        F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))).otherwise(F.lit(0.0)).alias("progress"),
        F.when(known, _count(F.col("sample_count"))).otherwise(F.lit(0).cast("bigint")).alias("sample_count"),
        F.coalesce(F.col("phase").isin(RUNNING_PHASES), F.lit(False)).alias("running"),
    )


def latest_status(status: DataFrame, now: Column, stale_after_s: float = STALE_AFTER_S) -> DataFrame:
    """Last status per video; ``stale`` marks a running scan that has been silent for too long."""
    rows = normalize_status(status)
    cols = ["phase", "progress", "sample_count", "running"]
    last = rows.groupBy("video_id").agg(
        F.max("updated_at").alias("updated_at"),
        F.max_by(F.struct(*cols), F.struct("updated_at", "sample_count", "phase")).alias("_row"),
    )
    silent = now.cast("timestamp").cast("double") - F.col("updated_at").cast("double")
    return last.select(
        "video_id", "updated_at", "_row.phase", "_row.progress", "_row.sample_count",
        (F.col("_row.running") & (silent > stale_after_s)).alias("stale"),
    )


def recent_activity(evidence: DataFrame, k: int = RECENT_ROWS) -> DataFrame:
    """Newest ``k`` rows per video by ``seen_at``; older rows are dropped before the shuffle."""
    w = Window.partitionBy("video_id").orderBy(F.col("seen_at").desc(), "ev_idx")
    return evidence.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
