"""Detection quality against labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import intervals
from ..functions.tables import settle
from ..functions.numbers import fixed_text, is_finite, js_round, ratio
from . import fusion, links, transcript

# Fixed values (must match for right results).
MIN_IOU = 0.3
OPEN_TOLERANCE_S = 12.0
GATES = {
    "precision": 0.95,
    "recall": 0.9,
    "negative_case_accuracy": 0.95,
    "closed_boundary_rate": 0.8,
    "false_positives_per_hour": 0.0,
    "boundary_mae_s": 5.0,
}
GATE_LABELS = [
    ("precision", "precision", "min", ""),
    ("recall", "recall", "min", ""),
    ("negative_case_accuracy", "negative-case accuracy", "min", ""),
    ("closed_boundary_rate", "closed-boundary rate", "min", ""),
    ("false_positives_per_hour", "false positives per hour", "max", ""),
    ("boundary_mae_s", "boundary MAE", "max", "s"),
]

CELL_S = 120.0


def validate_cases(bench_case: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases fit for evaluation, and the others with the reason."""
    span = expected.join(bench_case.select("case_id", "duration_s"), "case_id")
    wrong = (
        span.filter(
            ~is_finite(F.col("start_s"))
            | ~is_finite(F.col("end_s"))
            | (F.col("start_s") < 0)
            | (F.col("end_s") <= F.col("start_s"))
            | (F.col("end_s") > F.col("duration_s"))
        )
        .select("case_id")
        .distinct()
        .withColumn("_wrong", F.lit(True))
    )
    reason = (
        F.when(F.trim("case_id") == "", F.lit("Case id must not be empty."))
        .when(~is_finite(F.col("duration_s")) | (F.col("duration_s") <= 0), F.lit("Case needs a positive duration."))
        .when(F.col("_wrong"), F.lit("Case contains an invalid expected segment."))
    )
    checked = bench_case.join(wrong, "case_id", "left").withColumn("error", reason).drop("_wrong")
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def pair_segments(
    expected: DataFrame, detected: DataFrame, min_iou: float = MIN_IOU, tolerance: float = OPEN_TOLERANCE_S
) -> DataFrame:
    """Eligible pairs of one case. Closed detections are found by an overlap join, open ones by
    their start near an expected start; pairs that cannot match are never formed.

    ``expected``: ``case_id, exp_idx, start_s, end_s``; ``detected``: ``case_id, cand_idx, start_s, end_s``.
    """
    e = expected.select("case_id", "exp_idx", F.col("start_s").alias("exp_s"), F.col("end_s").alias("exp_e"))
    d = detected.select("case_id", "cand_idx", F.col("start_s").alias("det_s"), F.col("end_s").alias("det_e"))
    closed = intervals.overlap_join(
        e, d.filter("det_e is not null"), ["case_id"],
        (F.col("exp_s"), F.col("exp_e")), (F.col("det_s"), F.col("det_e")), CELL_S,
    )
    open_ended = intervals.overlap_join(
        e, d.filter("det_e is null"), ["case_id"],
        (F.col("exp_s") - tolerance, F.col("exp_s") + tolerance), (F.col("det_s"), F.col("det_s")), CELL_S,
    )
    both = closed.unionByName(open_ended)
    shared = F.greatest(F.lit(0.0), F.least("exp_e", "det_e") - F.greatest("exp_s", "det_s"))
    hull = F.greatest("exp_e", "det_e") - F.least("exp_s", "det_s")
    is_open = F.col("det_e").isNull()
    iou = F.when(is_open, F.lit(0.0)).otherwise(F.when(hull <= 0, 0.0).otherwise(shared / F.nullif(hull, F.lit(0.0))))
    out = (
        both.withColumn("start_error", F.abs(F.col("det_s") - F.col("exp_s")))
        .withColumn("end_error", F.when(~is_open, F.abs(F.col("det_e") - F.col("exp_e"))))
        .withColumn("iou", iou)
    )
    eligible = F.when(is_open, F.col("start_error") <= tolerance).otherwise(F.col("iou") >= min_iou)
    score = F.when(is_open, F.lit(0.1) * (1 - F.col("start_error") / max(1.0, tolerance))).otherwise(F.col("iou"))
    return out.filter(eligible).withColumn("score", score)


def match_segments(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matching, best pairs first, in rounds.

    A pair that is the best of both its segments is matched whatever happens elsewhere, so a round takes all such
    pairs at once, and pairs that share a segment with them drop out. Best pairs are aggregates, reduced before the
    shuffle, so a case or a segment with very many pairs stays spread over tasks. The best pair of all always
    qualifies; rounds end when no pair is left, after as many as the longest chain of ever better rivals.
    """
    exp, cand = ["case_id", "exp_idx"], ["case_id", "cand_idx"]
    rank = F.struct(
        (-F.col("score")).alias("o1"),
        F.col("start_error").alias("start_error"),
        F.coalesce("end_error", F.lit(float("inf"))).alias("o3"),
        F.col("exp_idx").alias("exp_idx"),
        F.col("det_s").alias("o5"),
        F.col("cand_idx").alias("cand_idx"),
        F.col("iou").alias("iou"),
        F.col("end_error").alias("end_error"),
    )
    left = settle(
        pairs.select(
            "case_id", F.col("exp_idx").cast("bigint").alias("exp_idx"), F.col("cand_idx").cast("bigint").alias("cand_idx"),
            "det_s", "score", "start_error", "end_error", "iou",
        )
    )
    won = []
    while not won or not left.isEmpty():
        of_exp = left.groupBy(*exp).agg(F.min(rank).alias("r")).select(*exp, F.col("r.cand_idx").alias("cand_idx"), "r")
        of_cand = left.groupBy(*cand).agg(F.min(rank).alias("c")).select(*cand, F.col("c.exp_idx").alias("exp_idx"))
        both = of_exp.join(of_cand, [*exp, "cand_idx"])
        won.append(settle(both.select("case_id", "exp_idx", "cand_idx", "r.iou", "r.start_error", "r.end_error")))
        left = settle(left.join(won[-1].select(*exp), exp, "left_anti").join(won[-1].select(*cand), cand, "left_anti"))
    matched = won[0]
    for part in won[1:]:
        matched = matched.unionByName(part)
    rounded = [js_round(F.col(c), 4).alias(c) for c in ("iou", "start_error", "end_error")]
    return matched.select("case_id", "exp_idx", "cand_idx", *rounded)


def case_outcomes(bench_case: DataFrame, expected: DataFrame, detected: DataFrame, matches: DataFrame) -> DataFrame:
    def per_case(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    out = bench_case.select("case_id", "duration_s")
    for df, name in ((expected, "n_expected"), (detected, "n_detected"), (matches, "n_matched")):
        out = out.join(per_case(df, name), "case_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out.withColumn("misses", F.col("n_expected") - F.col("n_matched")).withColumn(
        "false_positives", F.col("n_detected") - F.col("n_matched")
    )


def benchmark_metrics(outcomes: DataFrame, matches: DataFrame) -> DataFrame:
    """One row with all quality metrics."""
    o = outcomes.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum((F.col("n_expected") == 0).cast("bigint")).alias("negative_cases"),
        F.sum(((F.col("n_expected") == 0) & (F.col("n_detected") == 0)).cast("bigint")).alias("clean_negatives"),
        F.sum("n_expected").alias("expected_segments"),
        F.sum("n_detected").alias("detected_segments"),
        F.sum("n_matched").alias("matched_segments"),
        F.sum(F.col("duration_s").cast("decimal(18,3)")).cast("double").alias("total_s"),
    )
    closed = F.col("end_error").isNotNull()
    m = matches.agg(
        F.count(F.when(closed, 1)).alias("closed"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("start_error").cast("decimal(18,4)")).cast("double").alias("start_sum"),
        F.sum(F.when(closed, F.col("start_error")).cast("decimal(18,4)")).cast("double").alias("closed_start_sum"),
        F.sum(F.col("end_error").cast("decimal(18,4)")).cast("double").alias("end_sum"),
    )
    one = o.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k")
    matched, fp = F.col("matched_segments"), F.col("detected_segments") - F.col("matched_segments")
    precision = ratio(matched, F.col("detected_segments"), 1.0)
    recall = ratio(matched, F.col("expected_segments"), 1.0)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(
        2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    )
    total = F.nullif(F.col("total_s"), F.lit(0.0))

    def mean(numerator: Column, n: Column) -> Column:
        return js_round(numerator / F.nullif(n.cast("double"), F.lit(0.0)), 4)

    return one.select(
        "cases",
        (F.col("cases") - F.col("negative_cases")).alias("positive_cases"),
        "negative_cases",
        "expected_segments",
        "detected_segments",
        "matched_segments",
        (F.col("expected_segments") - matched).alias("misses"),
        fp.alias("false_positives"),
        js_round(precision, 4).alias("precision"),
        js_round(recall, 4).alias("recall"),
        js_round(f1, 4).alias("f1"),
        js_round(ratio(F.col("clean_negatives"), F.col("negative_cases"), 1.0), 4).alias("negative_case_accuracy"),
        js_round(F.coalesce(fp * 3600.0 / total, F.lit(0.0)), 4).alias("false_positives_per_hour"),
        js_round(ratio(F.col("closed"), matched, 1.0), 4).alias("closed_boundary_rate"),
        mean(F.col("start_sum"), F.col("n")).alias("start_mae_s"),
        mean(F.col("end_sum"), F.col("closed")).alias("end_mae_s"),
        mean(F.col("closed_start_sum") + F.col("end_sum"), 2 * F.col("closed")).alias("boundary_mae_s"),
    )


def _number_text(value: Column) -> Column:
    return F.when(value == F.floor(value), fixed_text(value, 0)).otherwise(fixed_text(value, 2))


def benchmark_gates(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per failed gate: ``gate_ord, metric, failure``."""
    limits = {**GATES, **(limits or {})}
    rules = []
    for i, (name, label, side, unit) in enumerate(GATE_LABELS):
        actual, limit = F.col(name), F.lit(float(limits[name]))
        word = "is below" if side == "min" else "exceeds"
        text = F.concat(
            F.lit(label + " "), _number_text(actual), F.lit(f"{unit} {word} "), _number_text(limit), F.lit(unit)
        )
        failed = actual < limit if side == "min" else actual > limit
        missing = F.when(
            actual.isNull(), F.lit("boundary MAE is unavailable because no closed segment matched")
        )
        rules.append(
            F.struct(
                F.lit(i).alias("gate_ord"),
                F.lit(name).alias("metric"),
                F.coalesce(missing, F.when(failed, text)).alias("failure"),
            )
        )
    return metrics.select(F.inline(F.array(*rules))).filter("failure is not null")


def benchmark_report(metrics: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Report lines with their order: ``section, line_key, line``."""

    def pct(name: str) -> Column:
        return F.concat(fixed_text(F.col(name) * 100, 1), F.lit("%"))

    mae = F.coalesce(F.concat(_number_text(F.col("boundary_mae_s")), F.lit("s")), F.lit("n/a"))
    dot = F.lit(" · ")
    lines = [
        F.lit("Segment detection benchmark"),
        F.concat(
            F.col("cases"), F.lit(" cases"), dot, F.col("expected_segments"), F.lit(" expected"), dot,
            F.col("detected_segments"), F.lit(" detected"),
        ),
        F.concat(F.lit("precision "), pct("precision"), dot, F.lit("recall "), pct("recall"), dot, F.lit("F1 "), pct("f1")),
        F.concat(
            F.lit("negative accuracy "), pct("negative_case_accuracy"), dot, F.lit("false positives/hour "),
            _number_text(F.col("false_positives_per_hour")),
        ),
        F.concat(F.lit("closed boundaries "), pct("closed_boundary_rate"), dot, F.lit("boundary MAE "), mae),
    ]
    head = metrics.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(0).alias("section"), F.lit(str(i)).alias("line_key"), t.alias("line")) for i, t in enumerate(lines)]
            )
        )
    )
    passed = (F.col("misses") == 0) & (F.col("false_positives") == 0)
    body = outcomes.select(
        F.lit(1).alias("section"),
        F.col("case_id").alias("line_key"),
        F.concat(
            F.when(passed, F.lit("PASS ")).otherwise(F.lit("FAIL ")), F.col("case_id"), F.lit(": expected "),
            F.col("n_expected"), F.lit(", detected "), F.col("n_detected"), F.lit(", matched "), F.col("n_matched"),
        ).alias("line"),
    )
    return head.unionByName(body)


def case_candidates(cue: DataFrame, given: DataFrame | None, phrases) -> DataFrame:
    """Heuristic candidates of every case at once; ``video_id`` holds the case id."""
    parts = [transcript.transcript_evidence(cue, phrases), links.transcript_link_evidence(cue)]
    if given is not None:
        parts.append(given)
    return fusion.heuristic_candidates(settle(links.combine_evidence(*parts)))


def run_benchmark(
    bench_case: DataFrame, expected: DataFrame, cue: DataFrame, given: DataFrame | None, phrases
) -> dict[str, DataFrame]:
    good, bad = validate_cases(bench_case, expected)
    detected = case_candidates(cue, given, phrases).withColumnRenamed("video_id", "case_id")
    detected = settle(detected.join(good.select("case_id"), "case_id", "left_semi"))
    expected = expected.join(good.select("case_id"), "case_id", "left_semi")
    matches = settle(match_segments(pair_segments(expected, detected)))
    outcomes = case_outcomes(good, expected, detected, matches)
    return {
        "rejected": bad,
        "detected": detected,
        "matches": matches,
        "outcomes": outcomes,
        "metrics": benchmark_metrics(outcomes, matches),
    }


def source_detection_quality(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Per source: set comparison of (case, source). Both inputs: ``case_id, source``."""
    e = expected.select("case_id", "source").distinct().withColumn("_e", F.lit(1))
    d = detected.select("case_id", "source").distinct().withColumn("_d", F.lit(1))
    both = e.join(d, ["case_id", "source"], "full")
    has_e, has_d = F.col("_e").isNotNull(), F.col("_d").isNotNull()
    out = both.groupBy("source").agg(
        F.count("_e").alias("n_expected"),
        F.count(F.when(has_e & has_d, 1)).alias("n_detected"),
        F.count(F.when(has_e & ~has_d, 1)).alias("n_missed"),
        F.count(F.when(~has_e & has_d, 1)).alias("n_false_positive"),
    )
    return out.withColumn("recall", js_round(ratio(F.col("n_detected"), F.col("n_expected"), 1.0), 3)).withColumn(
        "precision",
        js_round(ratio(F.col("n_detected"), F.col("n_detected") + F.col("n_false_positive"), 1.0), 3),
    )
