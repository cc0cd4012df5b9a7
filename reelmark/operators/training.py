"""Leakage-safe training, threshold and boundary calibration, evaluation of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordered
from ..functions.hashing import FNV_BASIS, FNV_PRIME, group_key, is_holdout
from ..functions.numbers import is_finite, js_round, ratio
from ..functions.once import fenced
from ..functions.tables import settle
from ..sources.schemas import FEATURE_SCHEMA_VERSION, MODEL, struct_of
from . import feedback as fb, scoring

# Fixed values (must match for right results).
ITERATIONS = 300
LEARNING_RATE = 0.08
L2 = 0.001
DEFAULT_POSITIVE, DEFAULT_REVIEW = 0.65, 0.45
PRECISION_TARGET, RECALL_TARGET = 0.9, 0.95
EXCLUDED_FEATURES = ["startSeconds", "durationSeconds", "evidenceTimeSpanSeconds"]
MIN_TRAIN_ROWS, MIN_TRAIN_GROUPS = 5, 3
MIN_HOLDOUT_ROWS, MIN_HOLDOUT_GROUPS = 2, 2
MAX_OFFSET_S = 30.0
MIN_GAIN_S = 0.25

GRID = 1_000_000
ALL_SOURCES = "*"


def trainable_features(example: DataFrame) -> DataFrame:
    """Distinct finite feature names, without the time features."""
    pairs = example.select(F.explode("features").alias("name", "value"))
    return (
        pairs.filter(is_finite(F.col("value")) & ~F.col("name").isin(EXCLUDED_FEATURES))
        .select("name")
        .distinct()
        .orderBy("name")
    )


def group_split(example: DataFrame) -> DataFrame:
    """Adds ``group_key`` and ``holdout``; all rows of a video land on one side."""
    out = example.withColumn("group_key", group_key(F.col("video_id"), F.col("feedback_id")))
    return out.withColumn("holdout", is_holdout(F.col("group_key")))


def _round6(value: float) -> float:
    return math.copysign(math.floor(abs(value) * 1e6 + 0.5) / 1e6, value) + 0.0


def _gradient_step(intercept: float, weights: list[float]):
    """Sums of errors and of errors times features of a partition; the weights travel as data."""
    w = np.array(weights, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), len(w))
            with np.errstate(over="ignore"):
                e = 1 / (1 + np.exp(-(intercept + x @ w))) - y
            total[0] += e.sum()
            total[1:] += e @ x
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"s{i}" for i in range(len(total))])

    return run


def train_logistic(
    fit: DataFrame, names: list[str], iterations: int = ITERATIONS, rate: float = LEARNING_RATE, l2: float = L2
) -> tuple[float, dict[str, float]]:
    """Full-batch gradient descent.

    Features are one array column, kept in memory (and recomputed from the written table if an
    executor is lost). A step is a matrix product per Arrow batch and one sum per partition; its plan is the same
    for all steps, and the driver only holds the weights.
    """
    values = [F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)) for n in names]
    x = F.array(*values) if names else F.array().cast("array<double>")
    packed = settle(fit.select(F.col("label").cast("double").alias("y"), x.alias("x"))).persist()
    n = max(1, packed.count())
    intercept, weights = 0.0, [0.0] * len(names)
    sums = [f"s{i}" for i in range(len(names) + 1)]
    try:
        for _ in range(iterations):
            parts = packed.mapInArrow(_gradient_step(intercept, weights), ", ".join(f"{s} double" for s in sums))
            row = parts.agg(*[F.sum(s).alias(s) for s in sums]).first()
            intercept = _round6(intercept - rate * ((row[0] or 0.0) / n))
            weights = [_round6(w - rate * ((row[i + 1] or 0.0) / n + l2 * w)) for i, w in enumerate(weights)]
    finally:
        packed.unpersist()
    return intercept, dict(zip(names, weights))


def score_examples(example: DataFrame, intercept: float, weights: dict[str, float]) -> DataFrame:
    logit = scoring.logit_of_map(F.col("features"), intercept, weights)
    return fenced(example, score=scoring.sigmoid(logit))


def _quality(tp: Column, fp: Column, positives: Column, n: Column) -> dict[str, Column]:
    fn = positives - tp
    precision = ratio(tp, tp + fp, 0.0)
    recall = ratio(tp, positives, 0.0)
    both = precision + recall
    return {
        "validation_examples": n,
        "predicted_positive": tp + fp,
        "accuracy": js_round(ratio(n - fp - fn, n, 0.0), 6),
        "precision": js_round(precision, 6),
        "recall": js_round(recall, 6),
        "f1": js_round(F.when(both == 0, 0.0).otherwise(2 * precision * recall / F.nullif(both, F.lit(0.0))), 6),
    }


def confusion_at(scored: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    one = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(hit & (F.col("label") == 1), 1)).alias("tp"),
        F.count(F.when(hit & (F.col("label") == 0), 1)).alias("fp"),
    )
    q = _quality(F.col("tp"), F.col("fp"), F.col("pos"), F.col("n"))
    return one.select(*[c.alias(k) for k, c in q.items()])


def usable_scores(scored: DataFrame) -> DataFrame:
    ok = scored.filter(F.col("label").isin(0, 1) & is_finite(F.col("score")))
    return ok.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Quality at every distinct score rounded to six decimals.

    Raw scores are compared with rounded thresholds, so a score can lie below its own threshold.
    Scores are counted per grid point first: the cumulative window sees at most a million rows.
    """
    s = usable_scores(scored)
    near = F.floor(F.col("score") * GRID + 0.5).cast("bigint")
    below = F.when(F.col("score") >= near / float(GRID), near).otherwise(near - 1)
    counted = settle(
        s.groupBy(near.alias("near"), below.alias("cell")).agg(
            F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
        )
    )
    per_cell = counted.groupBy(F.col("cell").alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    marks = counted.select(F.col("near").alias("i")).distinct().withColumn("is_mark", F.lit(True))
    both = per_cell.join(marks, "i", "full").withColumn("_all", F.lit(1)).fillna(0, ["pos", "neg"])
    block = F.floor((GRID - F.col("i")) / 1000)
    run = ordered.scan_before(
        both.withColumn("down", -F.col("i")), ["_all"], ["down"], block,
        [ordered.Scan("tp0", "sum", F.col("pos")), ordered.Scan("fp0", "sum", F.col("neg"))],
    )
    totals = counted.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"),
    )
    tp = F.coalesce("tp0", F.lit(0)) + F.col("pos")
    fp = F.coalesce("fp0", F.lit(0)) + F.col("neg")
    # The totals are a global aggregate, that is exactly one row.
    joined = run.filter("is_mark").join(F.broadcast(totals.withColumn("_all", F.lit(1))), "_all")
    q = _quality(tp, fp, F.col("all_pos"), F.col("n"))
    return joined.select((F.col("i") / float(GRID)).alias("threshold"), *[c.alias(k) for k, c in q.items()])


def _f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    value = (1 + b) * precision * recall / F.nullif(b * precision + recall, F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def calibrate_thresholds(
    scored: DataFrame, precision_target: float = PRECISION_TARGET, recall_target: float = RECALL_TARGET
) -> DataFrame:
    """One row: display and review threshold, and whether both classes were there to calibrate."""
    sweep = settle(threshold_sweep(scored).filter("predicted_positive > 0"))
    p, r, t = F.col("precision"), F.col("recall"), F.col("threshold")
    good = p >= precision_target
    display_rank = F.when(
        good, F.struct(F.lit(1).alias("q"), r.alias("a"), p.alias("b"), t.alias("c"), F.lit(0.0).alias("d"))
    ).otherwise(F.struct(F.lit(0).alias("q"), _f_beta(p, r, 0.5).alias("a"), p.alias("b"), r.alias("c"), t.alias("d")))
    display = sweep.agg(F.max_by(t, display_rank).alias("display")).withColumn("_k", F.lit(1))
    full = r >= recall_target
    review_rank = F.when(
        full, F.struct(F.lit(1).alias("q"), p.alias("a"), r.alias("b"), t.alias("c"), F.lit(0.0).alias("d"))
    ).otherwise(F.struct(F.lit(0).alias("q"), _f_beta(p, r, 2.0).alias("a"), r.alias("b"), p.alias("c"), t.alias("d")))
    review = (
        sweep.withColumn("_k", F.lit(1))
        .join(F.broadcast(display), "_k")
        .filter(t <= F.col("display"))
        .agg(F.max_by(t, review_rank).alias("review"))
        .withColumn("_k", F.lit(1))
    )
    counts = usable_scores(scored).agg(
        F.count(F.lit(1)).alias("examples"),
        F.count(F.when(F.col("label") == 1, 1)).alias("positives"),
        F.count(F.when(F.col("label") == 0, 1)).alias("negatives"),
    ).withColumn("_k", F.lit(1))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return counts.join(display, "_k").join(review, "_k").select(
        F.when(both, js_round(F.col("display"), 6)).otherwise(F.lit(DEFAULT_POSITIVE)).alias("positive"),
        F.when(both, js_round(F.least("display", F.coalesce("review", F.lit(DEFAULT_REVIEW))), 6))
        .otherwise(F.lit(DEFAULT_REVIEW))
        .alias("review"),
        both.alias("calibrated"),
        "examples",
        "positives",
        "negatives",
    )


def auc(scored: DataFrame) -> DataFrame:
    """Pairwise AUC as a rank sum; ties count one half, a missing class gives 0.5."""
    per = scored.groupBy("score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )
    run = ordered.scan_before(
        per.withColumn("_all", F.lit(1)), ["_all"], ["score"], F.floor(F.col("score") * 10_000),
        [ordered.Scan("neg_before", "sum", F.col("neg"))],
    )
    wins = F.sum(F.col("pos") * (F.coalesce("neg_before", F.lit(0)) + F.col("neg") * 0.5))
    one = run.agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))
    return one.select(F.coalesce(F.col("wins") / pairs, F.lit(0.5)).alias("auc"))


def grouped_median(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Exact median per key: counts per value, prefix counts by block, then the middle ranks."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    run = ordered.scan_before(
        counts, [key], [value], F.floor(F.col(value)), [ordered.Scan("_before", "sum", F.col("_n"))]
    )
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_total"))
    before = F.coalesce("_before", F.lit(0))

    def at(rank: Column) -> Column:
        inside = (before <= rank) & (rank < before + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return (
        run.join(totals, key).groupBy(key, "_total").agg(at(low).alias("_lo"), at(high).alias("_hi"))
        .select(key, ((F.col("_lo") + F.col("_hi")) / 2).alias(name), F.col("_total").alias(f"n_{name}"))
    )


def calibrate_boundaries(example: DataFrame) -> DataFrame:
    """Offsets per source and over all sources (``source = '*'``), only where the holdout proves a gain."""
    usable = example.filter(
        (F.col("predicted_start_s") >= 0) & (F.col("corrected_start_s") >= 0) & (F.trim("source") != "")
    )
    keyed = group_split(usable).withColumn("source", F.explode(F.array("source", F.lit(ALL_SOURCES))))
    keyed = settle(
        keyed.select(
            "source", "group_key", "holdout",
            (F.col("corrected_start_s") - F.col("predicted_start_s")).alias("start_delta"),
            (F.col("corrected_end_s") - F.col("predicted_end_s")).alias("end_delta"),
        )
    )
    held = F.col("holdout")
    stats = keyed.groupBy("source").agg(
        F.count(F.when(~held, 1)).alias("training_examples"),
        F.count_distinct(F.when(~held, F.col("group_key"))).alias("training_groups"),
        F.count(F.when(held, 1)).alias("validation_examples"),
        F.count_distinct(F.when(held, F.col("group_key"))).alias("validation_groups"),
        F.count_distinct("group_key").alias("video_groups"),
    )
    train = keyed.filter(~held)

    def clamp(c: Column) -> Column:
        return F.least(F.lit(MAX_OFFSET_S), F.greatest(F.lit(-MAX_OFFSET_S), c))

    starts = grouped_median(train, "source", "start_delta", "start_offset")
    ends = grouped_median(train, "source", "end_delta", "end_offset")
    offsets = (
        starts.join(ends, "source", "left")
        .withColumn("start_offset", clamp(F.col("start_offset")))
        .withColumn("end_offset", F.when(F.col("n_end_offset") >= MIN_TRAIN_ROWS, clamp(F.col("end_offset"))))
        .select("source", "start_offset", "end_offset")
    )
    # The error of a shift only depends on the correction, so equal corrections are counted first.
    seen = keyed.filter(held).groupBy("source", "start_delta", "end_delta").agg(F.count(F.lit(1)).alias("n"))
    has_end = F.col("end_delta").isNotNull()
    end_shift = F.coalesce("end_offset", "start_offset")

    def total(start: Column, end: Column) -> Column:
        error = F.abs(start) + F.coalesce(F.abs(end), F.lit(0.0))
        return F.sum(error.cast("decimal(18,6)") * F.col("n")).cast("double")

    points = F.sum(F.col("n") * F.when(has_end, 2).otherwise(1)).cast("double")
    mae = (
        seen.join(offsets, "source")
        .groupBy("source")
        .agg(
            (total(F.col("start_delta"), F.col("end_delta")) / points).alias("baseline"),
            (
                total(F.col("start_offset") - F.col("start_delta"), end_shift - F.col("end_delta")) / points
            ).alias("calibrated"),
        )
    )
    proven = (
        (F.col("training_examples") >= MIN_TRAIN_ROWS)
        & (F.col("training_groups") >= MIN_TRAIN_GROUPS)
        & (F.col("validation_examples") >= MIN_HOLDOUT_ROWS)
        & (F.col("validation_groups") >= MIN_HOLDOUT_GROUPS)
        & (F.col("calibrated") <= F.col("baseline") - MIN_GAIN_S)
    )
    return (
        stats.join(offsets, "source").join(mae, "source").filter(proven)
        .select(
            "source",
            js_round(F.col("start_offset"), 6).alias("start_offset_s"),
            js_round(F.col("end_offset"), 6).alias("end_offset_s"),
            "training_examples",
            "validation_examples",
            "video_groups",
            js_round(F.col("baseline"), 6).alias("baseline_mae_s"),
            js_round(F.col("calibrated"), 6).alias("calibrated_mae_s"),
        )
    )


def _fnv_text(text: str) -> int:
    h = FNV_BASIS
    for ch in text:
        h = ((h ^ ord(ch)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def version_text(now: datetime) -> str:
    return now.astimezone(timezone.utc).strftime("%Y.%m.%d.%H%M%S")


def model_artifact(
    example: DataFrame,
    now: datetime,
    iterations: int = ITERATIONS,
    rate: float = LEARNING_RATE,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """Trains on the examples and returns the one-row model table.

    The model id digests the time and the set of (id, label) pairs; the digest adds up hashes of
    rows, so it needs no order and no single pass over all rows.
    """
    spark = example.sparkSession
    split = settle(group_split(example).select("id", "label", "features", "group_key", "holdout"))
    names = [r["name"] for r in trainable_features(split).collect()]
    held = F.col("holdout")
    row_hash = F.xxhash64(F.concat_ws(":", "id", F.col("label").cast("string"))).cast("decimal(38,0)")
    s = split.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(held, 1)).alias("val"),
        F.count(F.when(held & (F.col("label") == 1), 1)).alias("val_pos"),
        F.count_distinct(F.when(held, F.col("group_key"))).alias("val_groups"),
        F.sum(row_hash).alias("digest"),
    ).first()
    n_train = s.n - s.val
    fit = split.filter(~held) if n_train else split
    intercept, weights = train_logistic(fit, names, iterations, rate)
    evaluated = settle(score_examples(split.filter(held) if s.val else split, intercept, weights).select("label", "score"))
    calibration_rows = evaluated if (n_train and s.val) else evaluated.limit(0)
    c = calibrate_thresholds(calibration_rows).first()
    at_display = confusion_at(evaluated, c.positive).first().asDict()
    at_review = confusion_at(evaluated, c.review).first().asDict()
    metrics = {
        "validationExamples": at_display["validation_examples"],
        "predictedPositive": at_display["predicted_positive"],
        "accuracy": at_display["accuracy"],
        "precision": at_display["precision"],
        "recall": at_display["recall"],
        "f1": at_display["f1"],
        "auc": _round6(auc(evaluated).first()["auc"]),
        "positiveThreshold": c.positive,
        "positivePrecision": at_display["precision"],
        "positiveRecall": at_display["recall"],
        "positiveF1": at_display["f1"],
        "reviewThreshold": c.review,
        "reviewPrecision": at_review["precision"],
        "reviewRecall": at_review["recall"],
        "reviewF1": at_review["f1"],
        "thresholdsCalibrated": int(c.calibrated),
        "thresholdCalibrationExamples": c.examples,
        "thresholdCalibrationPositives": c.positives,
        "thresholdCalibrationNegatives": c.negatives,
        "thresholdCalibrationGroups": s.val_groups,
    }
    summary = {
        "examples": s.n,
        "trainExamples": n_train,
        "validationExamples": s.val,
        "validationPositives": s.val_pos,
        "validationNegatives": s.val - s.val_pos,
        "validationGroups": s.val_groups,
        "positives": s.pos,
        "negatives": s.n - s.pos,
        "featureCount": len(names),
        "thresholdsCalibrated": int(c.calibrated),
    }
    stamp = now.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
    floats = lambda d: {k: float(v) for k, v in d.items()}
    row = (
        f"model_{_fnv_text(f'{stamp}:{s.n}:{s.digest or 0}')}", version_text(now), FEATURE_SCHEMA_VERSION, stamp, None,
        intercept, weights, {"positive": c.positive, "review": c.review}, floats(metrics), floats(summary),
        _boundary_struct(boundaries),
    )
    return spark.createDataFrame([row], struct_of(MODEL))


def _boundary_struct(boundaries: DataFrame | None):
    if boundaries is None:
        return None
    # One row per evidence source.
    fields = ["start_offset_s", "end_offset_s", "training_examples", "validation_examples", "video_groups", "baseline_mae_s", "calibrated_mae_s"]
    profiles = {r["source"]: tuple(r[f] for f in fields) for r in boundaries.collect()}
    if not profiles:
        return None
    overall = profiles.pop(ALL_SOURCES, None)
    return (overall, profiles)


def training_run(model: DataFrame, run_id: str, created_at: str) -> DataFrame:
    return model.select(
        F.lit(run_id).alias("id"),
        F.lit(created_at).alias("created_at"),
        "model_id",
        F.coalesce(F.col("training_set_summary.examples"), F.lit(0.0)).cast("bigint").alias("dataset_size"),
        F.coalesce(F.col("training_set_summary.validationExamples"), F.lit(0.0)).cast("bigint").alias("validation_size"),
        "metrics",
        F.lit("completed").alias("status"),
    )


def train_pipeline(
    feedback: DataFrame, review: DataFrame, now: datetime, run_id: str, iterations: int = ITERATIONS
) -> tuple[DataFrame, DataFrame]:
    """Feedback and reviews to a model row and a run row; raises if training is not possible yet."""
    example = settle(fb.training_examples(feedback, review))
    ready = fb.training_readiness(example).first()
    if not ready.ready:
        raise ValueError(ready.blocker)
    compatible = example.filter(F.col("feature_schema_version") == FEATURE_SCHEMA_VERSION)
    boundaries = calibrate_boundaries(fb.boundary_examples(feedback, review))
    model = model_artifact(compatible, now, iterations, boundaries=boundaries)
    return model, training_run(model, run_id, model.first().created_at)
