"""Model registry: upserts, promotions, safety rules and comparison reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import anchors, ordered
from ..functions.numbers import half_up, is_finite, metric_text
from ..functions.once import only
from ..functions.tables import settle

# Fixed values (must match for right results).
MINIMUMS = [
    ("thresholdCalibrationExamples", 20.0, "Holdout calibration examples"),
    ("thresholdCalibrationPositives", 5.0, "Holdout positive examples"),
    ("thresholdCalibrationNegatives", 5.0, "Holdout negative examples"),
    ("thresholdCalibrationGroups", 5.0, "Holdout video groups"),
    ("positivePrecision", 0.9, "Display precision"),
    ("positiveRecall", 0.5, "Display recall"),
    ("reviewRecall", 0.9, "Review recall"),
    ("auc", 0.7, "AUC"),
]
TOLERANCES = [
    ("positivePrecision", 0.02, "Display precision"),
    ("positiveRecall", 0.05, "Display recall"),
    ("reviewRecall", 0.05, "Review recall"),
    ("auc", 0.03, "AUC"),
]
MAX_BOUNDARY_REGRESSION_S = 0.5
BAD_THRESHOLDS = "Candidate thresholds are missing, invalid, or inverted."
NOT_CALIBRATED = (
    "Decision thresholds were not calibrated on a holdout containing both positive and negative examples."
)
BOUNDARY_REMOVED = "Candidate removes the promoted model boundary calibration."
BOUNDARY_MISSING = " is missing while the promoted model has a validated profile."
DELTA_METRICS = ["accuracy", "precision", "recall", "f1", "auc", "positivePrecision", "positiveRecall", "reviewRecall"]
TOP_WEIGHTS = 10

# Length of a block of a promotion log.
BLOCK_S = 86400.0


def upsert_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """Later rows replace earlier ones by ``model_id``."""
    both = models.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    cols = [c for c in models.columns if c != "model_id"]
    return (
        both.groupBy("model_id")
        .agg(F.max_by(F.struct(*cols), F.struct("_at", "created_at")).alias("_row"))
        .select("model_id", "_row.*")
        .select(*models.columns)
    )


def replay_promotions(events: DataFrame) -> DataFrame:
    """State after each request of a promotion log: ``registry, id, at, action, model_id, accepted, active_model_id``.

    ``events``: ``registry, id, model_id, promoted_at, action``. A rollback of the active model makes
    the model promoted just before its latest promotion active again (or none); any other rollback is refused.

    After a promotion the active model follows from it alone, and until the next one each accepted rollback leads
    to the next: the first later rollback of the model that it made active. So accepted rollbacks are what can be
    reached from promotions along these edges, marked in doubled steps. What comes before in a log is scanned in
    blocks of a day, so one long log is spread over tasks.
    """
    own = ["registry", "at", "id"]
    log = events.select("registry", F.col("promoted_at").alias("at"), "id", "action", "model_id")
    log = settle(log.withColumn("day", F.floor(F.col("at").cast("double") / BLOCK_S)))
    promotes = F.col("action") == "promote"
    latest = F.when(promotes, F.struct("at", "id", "model_id"))
    known = ordered.scan_before(log, ["registry"], ["at", "id"], F.col("day"), [ordered.Scan("last", "last", latest)])
    known = known.withColumn("before", F.when(promotes, F.struct(F.col("last.model_id").alias("model"))))
    known = settle(known.withColumn("reign", F.when(promotes, F.struct("at", "id")).otherwise(F.struct("last.at", "last.id"))))
    scanned = ordered.scan_before(
        known, ["registry", "model_id"], ["at", "id"], F.col("day"), [ordered.Scan("undone", "last", F.col("before"))]
    )
    made = F.when(promotes, F.col("model_id")).otherwise(F.col("undone.model")).alias("made")
    moves = settle(scanned.select(*own, "day", "action", "model_id", "reign", made))

    rolled = moves.filter(~promotes)
    # A rollback is asked for after itself, where it makes its own model active again.
    line = rolled.select(*own, "day", F.col("model_id").alias("of"), F.lit(0).alias("side"), "reign").unionByName(
        moves.filter("made is not null").select(*own, "day", F.col("made").alias("of"), F.lit(1).alias("side"), "reign")
    )
    counted = settle(
        ordered.scan_before(
            line, ["registry", "of"], ["at", "id", "side"], F.col("day"), [ordered.Scan("n", "sum", 1 - F.col("side"))]
        ).withColumn("n", F.coalesce("n", F.lit(0)))
    )
    spot = F.struct("at", "id")
    nth = counted.filter("side = 0").select("registry", "of", "n", "reign", spot.alias("next"))
    edges = counted.filter("side = 1").select("registry", "of", "n", "reign", spot.alias("spot")).join(nth, ["registry", "of", "n", "reign"])
    starts = moves.filter(promotes).select("registry", spot.alias("spot"))
    taken = anchors.reached(starts, settle(edges.select("registry", "spot", "next")), ["registry"])
    taken = taken.select("registry", "spot.*", F.lit(True).alias("taken"))
    judged = moves.join(taken, own, "left").withColumn("accepted", F.coalesce("taken", F.lit(False)))
    state = ordered.islands(
        judged.drop("taken", "reign"), ["registry"], ["at", "id"], F.col("day"), F.col("accepted"), F.col("made"), "active_model_id"
    )
    return state.select("registry", "id", "at", "action", "model_id", "accepted", "active_model_id")


def promoted_model(events: DataFrame, models: DataFrame, registry: str | None = "default") -> DataFrame:
    """The active model's row, or no row; with ``None`` the active models of all registries, with their ``registry``."""
    log = events if registry is None else events.filter(F.col("registry") == registry)
    state = replay_promotions(log)
    last = state.groupBy("registry").agg(F.max_by("active_model_id", F.struct("at", "id")).alias("model_id"))
    if registry is not None:
        return models.join(last.select("model_id"), "model_id", "left_semi")
    return last.join(models, "model_id").select("registry", *models.columns)


def _beside(models: DataFrame, promoted: DataFrame | None) -> DataFrame:
    """Adds the promoted model as struct ``p``; a second promoted row is an error."""
    if promoted is None:
        return models.withColumn("p", F.lit(None).cast(models.schema))
    one = promoted.agg(only(F.struct(*models.columns)).alias("p")).withColumn("_k", F.lit(1))
    return models.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k", "left").drop("_k")


def _probability(value: Column) -> Column:
    return F.coalesce(is_finite(value) & (value >= 0) & (value <= 1), F.lit(False))


def promotion_safety(models: DataFrame, promoted: DataFrame | None) -> DataFrame:
    """One row per model: ``model_id, safe, blockers``."""
    df = _beside(models, promoted)
    m, t = F.col("metrics"), F.col("thresholds")
    positive, review = F.try_element_at(t, F.lit("positive")), F.try_element_at(t, F.lit("review"))
    rules = [
        F.when(
            ~(_probability(positive) & _probability(review) & F.coalesce(review <= positive, F.lit(False))),
            F.lit(BAD_THRESHOLDS),
        ),
        F.when(
            ~F.coalesce(F.try_element_at(m, F.lit("thresholdsCalibrated")) == 1, F.lit(False)),
            F.lit(NOT_CALIBRATED),
        ),
    ]
    for name, minimum, label in MINIMUMS:
        value = F.try_element_at(m, F.lit(name))
        rules.append(
            F.when(
                ~F.coalesce(is_finite(value) & (value >= minimum), F.lit(False)),
                F.concat(
                    F.lit(f"{label} must be at least {minimum:.3f}; received "),
                    metric_text(F.when(is_finite(value), value)), F.lit("."),
                ),
            )
        )
    for name, tolerance, label in TOLERANCES:
        value, base = F.try_element_at(m, F.lit(name)), F.try_element_at(F.col("p.metrics"), F.lit(name))
        rules.append(
            F.when(
                is_finite(value) & is_finite(base) & (value + tolerance < base),
                F.concat(
                    F.lit(f"{label} regresses more than {tolerance:.3f} from the promoted model ("),
                    metric_text(value), F.lit(" vs "), metric_text(base), F.lit(")."),
                ),
            )
        )
    mine, theirs = F.col("boundary_calibration"), F.col("p.boundary_calibration")
    removed = theirs.isNotNull() & mine.isNull()
    rules.append(F.when(removed, F.lit(BOUNDARY_REMOVED)))
    both = theirs.isNotNull() & mine.isNotNull()
    rules.append(
        F.when(
            both,
            _boundary_rule(
                F.lit("Global boundary MAE"), mine["global"]["calibrated_mae_s"], theirs["global"]["calibrated_mae_s"]
            ),
        )
    )
    per_source = F.transform(
        F.array_sort(F.map_keys(theirs["by_source"])),
        lambda s: _boundary_rule(
            F.concat(s, F.lit(" boundary MAE")),
            F.try_element_at(mine["by_source"], s)["calibrated_mae_s"],
            F.try_element_at(theirs["by_source"], s)["calibrated_mae_s"],
        ),
    )
    blockers = F.array_compact(
        F.concat(F.array(*rules), F.coalesce(F.when(both, per_source), F.array().cast("array<string>")))
    )
    return df.select("model_id", (F.size(blockers) == 0).alias("safe"), blockers.alias("blockers"))


def _boundary_rule(label: Column, value: Column, base: Column) -> Column:
    missing = F.concat(label, F.lit(BOUNDARY_MISSING))
    worse = F.concat(
        label, F.lit(f" regresses more than {MAX_BOUNDARY_REGRESSION_S:.3f} seconds ("),
        metric_text(value), F.lit(" vs "), metric_text(base), F.lit(")."),
    )
    return F.when(
        is_finite(base),
        F.when(~F.coalesce(is_finite(value), F.lit(False)), missing).when(
            value > base + MAX_BOUNDARY_REGRESSION_S, worse
        ),
    )


def evaluation_report(models: DataFrame, promoted: DataFrame | None) -> DataFrame:
    """Per model: metrics, thresholds, calibration block and metric deltas to the promoted model."""
    df = _beside(models, promoted)
    m = F.col("metrics")

    def metric(name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    def side(kind: str) -> Column:
        return F.struct(
            F.try_element_at(F.col("thresholds"), F.lit(kind)).alias("threshold"),
            metric(f"{kind}Precision").alias("precision"),
            metric(f"{kind}Recall").alias("recall"),
            metric(f"{kind}F1").alias("f1"),
        )

    deltas = []
    for name in DELTA_METRICS:
        base = F.try_element_at(F.col("p.metrics"), F.lit(name))
        delta = half_up((metric(name) - base) * 1_000_000) / 1_000_000
        deltas.append(F.when(is_finite(metric(name)) & is_finite(base), F.struct(F.lit(name).alias("k"), delta.alias("v"))))
    counts = {k: f"thresholdCalibration{k.capitalize()}" for k in ("examples", "positives", "negatives", "groups")}
    calibration = F.struct(
        F.when(metric("thresholdsCalibrated") == 1, F.lit("validation")).otherwise(F.lit("fallback")).alias("mode"),
        *[F.coalesce(metric(v), F.lit(0.0)).alias(k) for k, v in counts.items()],
        side("positive").alias("positive"),
        side("review").alias("review"),
    )
    return df.select(
        "model_id",
        "metrics",
        "thresholds",
        calibration.alias("threshold_calibration"),
        "boundary_calibration",
        "training_set_summary",
        F.col("p.model_id").alias("promoted_model_id"),
        F.when(F.col("p").isNotNull(), F.map_from_entries(F.array_compact(F.array(*deltas)))).alias("metric_deltas"),
    )


def model_list(
    models: DataFrame, promoted_id: str | None, query: str = "", status: str = "all", sort: str = "created-desc"
) -> DataFrame:
    """Promoted model first, then by the chosen key, newest first on ties."""
    from .dashboard import matches_query

    is_promoted = F.coalesce(F.col("model_id") == F.lit(promoted_id), F.lit(False))
    df = models.filter(matches_query(F.struct(*models.columns), query)).withColumn("is_promoted", is_promoted)
    if status != "all":
        df = df.filter(F.col("is_promoted") if status == "promoted" else ~F.col("is_promoted"))
    newest = [F.col("created_at").desc(), F.col("model_id")]
    zero = F.lit(0.0)
    keys = {
        "f1-desc": [F.coalesce(F.col("metrics.f1"), zero).desc(), *newest],
        "accuracy-desc": [F.coalesce(F.col("metrics.accuracy"), zero).desc(), *newest],
        "examples-desc": [F.coalesce(F.col("training_set_summary.examples"), zero).desc(), *newest],
        "version-asc": [F.col("model_version"), F.col("model_id")],
    }
    return df.orderBy(F.col("is_promoted").desc(), *keys.get(sort, newest))


def top_weights(models: DataFrame, k: int = TOP_WEIGHTS) -> DataFrame:
    """Largest absolute weights of each model; a model has a few dozen weights, sorted in place."""
    entries = F.transform(
        F.map_entries("weights"),
        lambda e: F.struct((-F.abs(e["value"])).alias("far"), e["key"].alias("feature"), e["value"].alias("weight")),
    )
    best = F.slice(F.array_sort(entries), 1, k)
    return models.select("model_id", F.posexplode(best).alias("position", "w")).select(
        "model_id", "position", "w.feature", "w.weight"
    )
