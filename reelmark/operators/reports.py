"""Reports of missed segments: intake and the evidence around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import intervals
from ..functions.numbers import is_finite, js_round
from ..functions.tables import settle
from ..sources.schemas import EVIDENCE_COLUMNS
from . import features as ft, scoring

# Fixed values (must match for right results).
MAX_REPORT_S = 600.0
REPORT_CONTEXT_S = 10.0

CELL_S = 120.0


def with_timecode(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the seconds of ``h:mm:ss``, ``m:ss`` or ``s``; NULL if malformed."""
    shape = r"^(?:(?:(\d+):)?(\d+):)?(\d+(?:\.\d+)?)$"
    t = F.trim(text)
    part = [F.regexp_extract(t, shape, i).try_cast("double") for i in (1, 2, 3)]
    cut = df.withColumn("_t", F.struct(*[p.alias(n) for p, n in zip(part, "hms")], t.rlike(shape).alias("ok")))
    h, m, s = (F.col(f"_t.{n}") for n in "hms")
    zero = F.lit(0.0)
    fits = F.col("_t.ok") & is_finite(s) & (m.isNull() | (s < 60)) & (h.isNull() | (m < 60))
    total = F.coalesce(h, zero) * 3600 + F.coalesce(m, zero) * 60 + s
    # One-element generator: the parsed value is computed once and not copied into each later use.
    value = F.when(fits, total)
    rounded = F.transform(F.array(value), lambda v: F.when(is_finite(v), js_round(v, 3)))
    return cut.withColumn(name, F.explode(rounded)).drop("_t")


def timecode_text(seconds: Column) -> Column:
    whole = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    short = F.concat(minutes.cast("string"), F.lit(":"), two(rest))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(short)


def parse_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``report_id, video_id, start_text, end_text, duration_s`` to accepted and rejected rows."""
    df = with_timecode(with_timecode(raw, "start_text", "start_s"), "end_text", "end_s")
    error = (
        F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), F.lit("bad_timecode"))
        .when(F.col("end_s") <= F.col("start_s"), F.lit("end_not_after_start"))
        .when(F.col("end_s") - F.col("start_s") > MAX_REPORT_S, F.lit("too_long"))
        .when(F.col("end_s") > F.col("duration_s") + 1, F.lit("beyond_duration"))
    )
    checked = df.withColumn("error", error)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def missed_segment_context(
    report: DataFrame,
    evidence: DataFrame,
    cue: DataFrame,
    model: scoring.Model | None,
    nfkc: bool = True,
) -> DataFrame:
    """Reports with transcript text, evidence count, confidences and features of their range.

    Reports without evidence keep NULL features. The evidence rows themselves come from
    ``missed_segment_evidence``.
    """
    key = ["video_id", "report_id"]
    start = F.greatest(F.lit(0.0), F.col("start_s") - REPORT_CONTEXT_S)
    context = settle(ft.text_in_span(report, key, cue, start, F.col("end_s") + REPORT_CONTEXT_S, "transcript_context"))
    member = settle(missed_segment_evidence(report, evidence).withColumnRenamed("report_id", "cand_idx"))
    best = member.groupBy("video_id", "cand_idx").agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_evidence")
    )
    as_candidate = (
        report.withColumnRenamed("report_id", "cand_idx")
        .select("video_id", "cand_idx", "start_s", "end_s", "duration_s")
        .join(best, ["video_id", "cand_idx"])
    )
    video = report.groupBy("video_id").agg(F.max("duration_s").alias("duration_s"))
    vector = ft.candidate_features(
        as_candidate, member, context.withColumnRenamed("report_id", "cand_idx"), video, nfkc
    )
    applied = scoring.score(vector, model) if model else vector.withColumn("model_confidence", F.lit(None).cast("double"))
    found = applied.join(best, ["video_id", "cand_idx"]).select(
        "video_id",
        F.col("cand_idx").alias("report_id"),
        F.col("confidence").alias("heuristic_confidence"),
        "n_evidence",
        "model_confidence",
        ft.feature_map().alias("candidate_features"),
    )
    return (
        report.join(context, key, "left")
        .join(found, key, "left")
        .withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0).cast("bigint")))
        .withColumn("model_id", F.lit(model.model_id if model else None).cast("string"))
        .withColumn("model_version", F.lit(model.model_version if model else None).cast("string"))
        .withColumn("model_source", F.lit(model.source if model else "fallback"))
    )


def missed_segment_evidence(report: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per report and evidence row that overlaps the reported range."""
    r = report.select("video_id", "report_id", F.col("start_s").alias("_rs_"), F.col("end_s").alias("_re_"))
    spanned = evidence.withColumn("_till", F.coalesce("end_s", "start_s"))
    joined = intervals.overlap_join(
        r, spanned, ["video_id"], (F.col("_rs_"), F.col("_re_")), (F.col("start_s"), F.col("_till")), CELL_S
    )
    return joined.select("report_id", *EVIDENCE_COLUMNS)
