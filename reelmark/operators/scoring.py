"""Model scores, calibrated boundaries, bands and report rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import clock_text, half_up, js_round
from ..sources.schemas import END, FEATURE_SCHEMA_VERSION, PROGRESS_BAR, QR_CODE, SOURCES, START, TRANSCRIPT, VISIBLE_LINK
from .fusion import CAND, DISPLAY_THRESHOLD

# Fixed values (must match for right results).
SOURCE_LABELS = {TRANSCRIPT: "transcript", QR_CODE: "QR", VISIBLE_LINK: "visible link", PROGRESS_BAR: "progress bar"}
SOURCE_ORDER = [TRANSCRIPT, QR_CODE, VISIBLE_LINK, PROGRESS_BAR]
SHOWN_CANDIDATES = 5
MIN_SKIP_CONFIDENCE = 0.72
MIN_SKIP_S, MAX_SKIP_S = 3.0, 240.0
END_TOLERANCE_S = 10.0
COUNT_NAMES = {TRANSCRIPT: "transcript", PROGRESS_BAR: "progress_bar", QR_CODE: "qr_code", VISIBLE_LINK: "visible_link"}


@dataclass
class Model:
    """A validated artifact on the driver: a few dozen numbers, whatever the data size."""

    model_id: str
    model_version: str
    intercept: float
    weights: Mapping[str, float]
    thresholds: Mapping[str, float] = field(default_factory=dict)
    boundary_global: Mapping[str, float] | None = None
    boundary_by_source: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    source: str = "downloaded"

    @classmethod
    def from_table(cls, active: DataFrame) -> "Model | None":
        """From the at most one row of ``active_model``; None means heuristic scores."""
        rows = active.limit(2).collect()
        if len(rows) > 1:
            raise ValueError("more than one model is active")
        if not rows:
            return None
        row = rows[0]
        bounds = row.boundary_calibration.asDict(recursive=True) if row.boundary_calibration else {}
        return cls(
            row.model_id, row.model_version, row.intercept, row.weights, row.thresholds,
            bounds.get("global"), bounds.get("by_source") or {},
        )


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def logit_of_columns(model: Model, columns: list[str]) -> Column:
    """Intercept plus weighted columns, in weight order; absent features count as 0."""
    out = F.lit(float(model.intercept))
    for name, weight in model.weights.items():
        if name in columns:
            out = out + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(weight))
    return out


def logit_of_map(features: Column, intercept: float, weights: Mapping[str, float]) -> Column:
    out = F.lit(float(intercept))
    for name, weight in weights.items():
        out = out + F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0)) * F.lit(float(weight))
    return out


def score(features: DataFrame, model: Model) -> DataFrame:
    """Adds ``model_confidence``; the weights become part of the generated code."""
    return features.withColumn("model_confidence", js_round(sigmoid(logit_of_columns(model, features.columns)), 6))


def apply_model(candidate: DataFrame, features: DataFrame, model: Model | None) -> DataFrame:
    """Candidates with model (or heuristic) confidence, model identity and the feature columns."""
    scored = score(features, model) if model else features.withColumn("model_confidence", F.lit(None).cast("double"))
    out = candidate.withColumn("heuristic_confidence", js_round(F.col("confidence"), 6)).join(scored.hint("merge"), CAND)
    return (
        out.withColumn("confidence", F.coalesce("model_confidence", "heuristic_confidence"))
        .withColumn("model_id", F.lit(model.model_id if model else None).cast("string"))
        .withColumn("model_version", F.lit(model.model_version if model else None).cast("string"))
        .withColumn("model_source", F.lit(model.source if model else "fallback"))
        .withColumn("feature_schema_version", F.lit(FEATURE_SCHEMA_VERSION))
    )


def primary_source(candidate: DataFrame, member: DataFrame) -> DataFrame:
    """Source a candidate's boundary is attributed to: a start cue first, then the nearest row."""
    at = candidate.select(*CAND, F.col("start_s").alias("_at"))
    rank = F.struct(
        F.when(F.col("kind") == START, 0).otherwise(1).alias("r"),
        F.abs(F.col("start_s") - F.col("_at")).alias("far"),
        F.col("start_s").alias("s"),
        F.col("ev_idx").alias("i"),
    )
    return member.join(at, CAND).groupBy(*CAND).agg(F.min_by("source", rank).alias("primary_source"))


def apply_boundary_offsets(candidate: DataFrame, member: DataFrame, model: Model | None) -> DataFrame:
    """Shifts start and end by the calibrated offsets of the primary source (or the global ones)."""
    if model is None or (model.boundary_global is None and not model.boundary_by_source):
        return candidate
    out = candidate.join(primary_source(candidate, member), CAND, "left")

    def offset(key: str) -> Column:
        def of(profile: Mapping[str, float]) -> Column:
            value = profile.get(key)
            if value is None and key == "end_offset_s":
                value = profile["start_offset_s"]
            return F.lit(float(value))

        chosen = of(model.boundary_global) if model.boundary_global else F.lit(None).cast("double")
        for source, profile in model.boundary_by_source.items():
            chosen = F.when(F.col("primary_source") == source, of(profile)).otherwise(chosen)
        return chosen

    start = F.greatest(F.lit(0.0), js_round(F.col("start_s") + offset("start_offset_s"), 6))
    end = js_round(F.col("end_s") + offset("end_offset_s"), 6)
    out = out.withColumn("_s", start).withColumn("_e", end)
    moved = F.col("_s").isNotNull() & (F.col("_e").isNull() | (F.col("_e") > F.col("_s") + 1))
    return (
        out.withColumn("start_s", F.when(moved, F.col("_s")).otherwise(F.col("start_s")))
        .withColumn("end_s", F.when(moved, F.col("_e")).otherwise(F.col("end_s")))
        .drop("_s", "_e", "primary_source")
    )


def select_bands(candidate: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``band``: display, review or reject."""
    limits = dict(model.thresholds) if model else {}
    positive, review = limits.get("positive"), limits.get("review")
    ok = positive is not None and review is not None and 0 <= review <= positive <= 1
    if not ok:
        positive = review = DISPLAY_THRESHOLD
    c = F.col("confidence")
    band = F.when(c >= positive, F.lit("display")).when(c >= review, F.lit("review")).otherwise(F.lit("reject"))
    return candidate.withColumn("band", band)


def _label(source: Column) -> Column:
    out = F.lit(SOURCE_LABELS[PROGRESS_BAR])
    for key in SOURCE_ORDER[:-1]:
        out = F.when(source == key, F.lit(SOURCE_LABELS[key])).otherwise(out)
    return out


def candidate_view(candidate: DataFrame, member: DataFrame) -> DataFrame:
    """Report row per candidate: public id, one-line summary and source labels in fixed order."""
    rank = F.lit(None).cast("int")
    for i, key in enumerate(SOURCE_ORDER):
        rank = F.when(F.col("source") == key, F.lit(i)).otherwise(rank)
    sources = member.groupBy(*CAND).agg(
        F.array_sort(F.collect_set(F.struct(rank.alias("r"), _label(F.col("source")).alias("l")))).alias("_s")
    )
    names = F.array_join(F.transform("_s", lambda s: s["l"]), " + ")
    end_id = F.coalesce(half_up(F.col("end_s")).cast("string"), F.lit("open"))
    summary = F.concat(
        clock_text(F.col("start_s")), F.lit("-"), F.coalesce(clock_text(F.col("end_s")), F.lit("?")), F.lit(" · "),
        half_up(F.col("confidence") * 100).cast("string"), F.lit("% · "), names,
    )
    return candidate.join(sources, CAND).select(
        *CAND,
        F.concat(half_up(F.col("start_s")).cast("string"), F.lit("-"), end_id).alias("view_id"),
        "start_s",
        "end_s",
        "confidence",
        summary.alias("summary"),
        F.transform("_s", lambda s: s["l"]).alias("sources"),
    )


def evidence_detail(raw: Column) -> Column:
    """Readable detail of one evidence row: links, code value with its box, bar, or text."""
    whole = lambda c: half_up(c).cast("string")
    tl, br = raw["location"]["top_left"], raw["location"]["bottom_right"]
    box = F.concat(
        F.lit("QR box "), whole(tl["x"]), F.lit(","), whole(tl["y"]), F.lit(" "),
        F.greatest(F.lit(0), half_up(br["x"] - tl["x"])).cast("string"), F.lit("x"),
        F.greatest(F.lit(0), half_up(br["y"] - tl["y"])).cast("string"),
    )
    links = F.array_join(F.filter(raw["links"], lambda x: x.isNotNull() & (x != "")), ", ")
    value = F.nullif(F.trim(raw["value"]), F.lit(""))
    bar = F.concat(
        F.lit("Progress bar x="), whole(raw["start_x"]), F.lit("-"), whole(raw["end_x"]), F.lit(" y="), whole(raw["y"]),
        F.lit(" rows="), whole(raw["rows"]),
    )
    return F.coalesce(
        F.nullif(links, F.lit("")),
        F.coalesce(F.concat(value, F.lit(" ("), box, F.lit(")")), value),
        bar,
        F.nullif(F.trim(raw["text"]), F.lit("")),
        F.nullif(F.trim(raw["context_text"]), F.lit("")),
    )


def evidence_view(member: DataFrame) -> DataFrame:
    """Evidence rows of the report, one row per candidate and evidence row."""
    return member.select(
        *CAND, "ev_idx", "source", "kind", "start_s", "end_s", "confidence", "reason",
        evidence_detail(F.col("raw")).alias("detail"),
    )


def top_candidates(candidate: DataFrame, k: int = SHOWN_CANDIDATES) -> DataFrame:
    """First ``k`` displayed candidates per video with the total; cut before the shuffle."""
    shown = candidate.filter("band = 'display'") if "band" in candidate.columns else candidate
    totals = shown.groupBy("video_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    w = Window.partitionBy("video_id").orderBy("start_s", "cand_idx")
    first = shown.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    return first.join(totals, "video_id")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    counted = [F.count(F.when(F.col("source") == s, 1)).alias(COUNT_NAMES[s]) for s in SOURCES]
    known = F.count(F.when(F.col("source").isin(*SOURCES), 1)).alias("total")
    return evidence.groupBy("video_id").agg(*counted, known)


def skippable(candidate: DataFrame, member: DataFrame, min_confidence: float = MIN_SKIP_CONFIDENCE) -> DataFrame:
    """Closed, confident candidates whose end was really seen (not inferred)."""
    length = F.col("end_s") - F.col("start_s")
    fit = candidate.filter(
        (F.col("start_s") >= 0)
        & F.col("end_s").isNotNull()
        & (length >= MIN_SKIP_S)
        & (length <= MAX_SKIP_S)
        & (F.col("confidence") >= min_confidence)
    )
    ends = member.filter(F.col("kind") == END).select(*CAND, F.col("start_s").alias("_seen"))
    near = (
        ends.join(fit.select(*CAND, F.col("end_s").alias("_end")), CAND)
        .filter(F.abs(F.col("_seen") - F.col("_end")) <= END_TOLERANCE_S)
        .select(*CAND)
        .distinct()
    )
    return fit.join(near, CAND, "left_semi")


