"""Checked intake of configuration, feedback, reviews and models. Bad rows come back with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import is_finite
from ..functions.once import fenced
from . import schemas as S
from .captions import _at, _is_number, _kind, _list, _number, _string
from .defaults import DEFAULT_PHRASE_GROUPS

# Fixed values (must match for right results).
OCCURRENCE_TYPES = ["candidate", "evidence", "missed-segment"]
MODEL_SOURCES = ["bundled", "downloaded", "fallback"]
CLIENT_ID = r"^[A-Za-z0-9._:-]{1,128}$"
INSTANT = (
    r"^(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?Z$"
)
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
PAYLOAD_VERSION = 2
MISSED_SOURCE = "user-missed-segment"
MISSED_JUDGMENT = "missed_context"
MAX_MISSED_S = 600.0
MAX_OFFSET_S = 30.0

# Parts of a model document; what may be of a wrong kind is a variant, to be judged.
PROFILE_FIELDS = [
    "startOffsetSeconds", "endOffsetSeconds", "trainingExamples", "validationExamples", "videoGroups",
    "baselineMaeSeconds", "calibratedMaeSeconds",
]
PROFILE = f"struct<{','.join(f'{n}:variant' for n in PROFILE_FIELDS)}>"
CALIBRATION = f"struct<version:variant,global:variant,bySource:map<string,{PROFILE}>>"
ARTIFACT = (
    "struct<modelId:variant,modelVersion:variant,featureSchemaVersion:variant,createdAt:variant,promotedAt:variant,"
    "intercept:variant,weights:map<string,variant>,thresholds:map<string,variant>,metrics:map<string,variant>,"
    "trainingSetSummary:map<string,variant>,boundaryCalibration:variant>"
)

_RAW_PHRASE = (
    "config_id string, group_ord int, phrase_ord int, group_id string, kind string, confidence double, "
    "reason_label string, phrase string, enabled boolean"
)


def _judged(df: DataFrame, checks: list[tuple[str, Column]], row: Column) -> DataFrame:
    """Adds ``errors``, the names of checks that are not clearly true, and ``row`` where there are none."""
    errors = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
    )
    return fenced(fenced(df, errors=errors), row=F.when(F.size("errors") == 0, row)).drop("_v")


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    accepted = judged.filter(F.size("errors") == 0).select("row.*")
    return accepted, judged.filter(F.size("errors") > 0).drop("row")


def default_phrases(configs: DataFrame) -> DataFrame:
    """The default groups for every given ``config_id``."""
    rows = [
        F.struct(
            F.lit(g).alias("group_ord"), F.lit(p).alias("phrase_ord"), F.lit(group["id"]).alias("group_id"),
            F.lit(group["kind"]).alias("kind"), F.lit(group["confidence"]).alias("confidence"),
            F.lit(group["reason_label"]).alias("reason_label"), F.lit(phrase).alias("phrase"),
            F.lit(None).cast("boolean").alias("enabled"),
        )
        for g, group in enumerate(DEFAULT_PHRASE_GROUPS)
        for p, phrase in enumerate(group["phrases"])
    ]
    return configs.select("config_id", F.inline(F.array(*rows)))


def load_phrase_groups(configs: DataFrame) -> DataFrame:
    """``config_id, document`` (JSON text) to phrase rows. A document with any bad group falls back to
    the defaults as a whole; an empty list is legal and yields no rows.
    """
    doc = F.try_parse_json("document")
    parsed = configs.withColumn("_groups", _list(doc))
    g = parsed.select("config_id", F.posexplode("_groups").alias("group_ord", "_g"))
    at = lambda p: _at(F.col("_g"), p)
    phrases = F.array_distinct(
        F.filter(F.transform(_list(at("$.phrases")), lambda p: F.trim(F.coalesce(_string(p), F.lit("")))), lambda p: p != "")
    )
    g = g.select(
        "config_id",
        "group_ord",
        F.trim(_string(at("$.id"))).alias("group_id"),
        _string(at("$.kind")).alias("kind"),
        _number(at("$.confidence")).alias("confidence"),
        F.trim(_string(at("$.reasonLabel"))).alias("reason_label"),
        phrases.alias("phrases"),
        F.when(_kind(at("$.enabled")) == "BOOLEAN", F.try_variant_get(at("$.enabled"), "$", "boolean")).alias("enabled"),
    )
    ok = (
        (F.col("group_id") != "")
        & F.col("kind").isin(S.START, S.END, S.PRESENCE)
        & F.col("confidence").between(0, 1)
        & (F.col("reason_label") != "")
        & (F.size("phrases") > 0)
    )
    bad_groups = g.filter(~F.coalesce(ok, F.lit(False))).select("config_id")
    bad = parsed.filter("_groups is null").select("config_id").unionByName(bad_groups).distinct()
    good = g.join(bad, "config_id", "left_anti").select(
        "config_id", "group_ord", F.posexplode("phrases").alias("phrase_ord", "phrase"), "group_id", "kind",
        "confidence", "reason_label", "enabled",
    )
    names = [c.split()[0] for c in _RAW_PHRASE.split(", ")]
    return good.select(*names).unionByName(default_phrases(bad).select(*names))


def _maybe(value: Column, check: Column) -> Column:
    """Absent is fine, otherwise the check must hold."""
    return value.isNull() | check


def ingest_feedback(raw: DataFrame, app: str) -> tuple[DataFrame, DataFrame]:
    """Accepted feedback rows, and rejected input rows with ``errors``.

    Each of the two reads its input; a job that wants both writes or walks ``check_feedback`` once.
    """
    return _split(check_feedback(raw, app))


def check_feedback(raw: DataFrame, app: str) -> DataFrame:
    """``id, received_at, body`` (JSON text) with ``errors``, and the feedback ``row`` if there are none.

    ``app`` is the literal product tag the payloads must carry. Works on streams as well: there is
    no shuffle and no state.
    """
    v = F.col("_v")
    df = raw.withColumn("_v", F.try_parse_json("body"))
    at = lambda n: _at(v, f"$.{n}")
    kind = lambda n: _kind(at(n))
    absent = lambda n: at(n).isNull()
    null = lambda n: F.coalesce(kind(n) == "VOID", F.lit(False))
    text, num = (lambda n: _string(at(n))), (lambda n: _number(at(n)))
    start, end = num("startSeconds"), num("endSeconds")
    is_missed = text("occurrenceType") == "missed-segment"

    def optional_text(n: str) -> Column:
        return absent(n) | text(n).isNotNull()

    def nullable_text(n: str) -> Column:
        return absent(n) | null(n) | text(n).isNotNull()

    def probability(n: str) -> Column:
        return absent(n) | num(n).between(0, 1)

    shots = _list(at("evidenceSnapshot"))
    shot_ok = F.forall(
        shots,
        lambda s: F.coalesce(
            (_string(_at(s, "$.source")) != "")
            & (_string(_at(s, "$.kind")) != "")
            & (_number(_at(s, "$.startSeconds")) >= 0)
            & (_at(s, "$.endSeconds").isNull() | F.coalesce(_number(_at(s, "$.endSeconds")) >= 0, F.lit(False)))
            & _number(_at(s, "$.confidence")).between(0, 1)
            & (_string(_at(s, "$.reason")) != "")
            & (_at(s, "$.detail").isNull() | _string(_at(s, "$.detail")).isNotNull()),
            F.lit(False),
        ),
    )
    features = F.try_variant_get(at("candidateFeatures"), "$", "map<string,variant>")
    features_ok = F.forall(F.map_values(features), _is_number)
    version = num("featureSchemaVersion")
    checks = [
        ("body", kind("app").isNotNull()),
        ("app", text("app") == app),
        ("version", num("version") == PAYLOAD_VERSION),
        ("createdAt", text("createdAt").rlike(INSTANT)),
        ("clientId", absent("clientId") | text("clientId").rlike(CLIENT_ID)),
        ("videoUrl", null("videoUrl") | text("videoUrl").rlike(URL)),
        ("videoId", null("videoId") | text("videoId").isNotNull()),
        ("occurrenceId", text("occurrenceId") != ""),
        ("occurrenceType", text("occurrenceType").isin(OCCURRENCE_TYPES)),
        ("source", optional_text("source")),
        ("startSeconds", start >= 0),
        ("endSeconds", absent("endSeconds") | ((end >= 0) & (end > start))),
        ("summary", text("summary") != ""),
        ("reason", optional_text("reason")),
        ("feedback", text("feedback").isin(S.FEEDBACK_JUDGMENTS)),
        ("notes", optional_text("notes")),
        ("modelId", nullable_text("modelId")),
        ("modelVersion", nullable_text("modelVersion")),
        ("modelSource", absent("modelSource") | text("modelSource").isin(MODEL_SOURCES)),
        ("featureSchemaVersion", absent("featureSchemaVersion") | ((version > 0) & (version == F.floor(version)))),
        ("heuristicConfidence", probability("heuristicConfidence")),
        ("modelConfidence", probability("modelConfidence")),
        ("candidateFeatures", absent("candidateFeatures") | (features.isNotNull() & features_ok)),
        ("evidenceSnapshot", absent("evidenceSnapshot") | shot_ok),
        ("transcriptContext", optional_text("transcriptContext")),
        ("missedRange", ~F.coalesce(is_missed, F.lit(False)) | (end - start <= MAX_MISSED_S)),
        (
            "missedLabel",
            ~F.coalesce(is_missed, F.lit(False))
            | ((text("feedback") == MISSED_JUDGMENT) & F.coalesce(text("source") == MISSED_SOURCE, F.lit(False))),
        ),
    ]
    shot = F.transform(
        shots,
        lambda s: F.struct(
            _string(_at(s, "$.source")).alias("source"),
            _string(_at(s, "$.kind")).alias("kind"),
            _number(_at(s, "$.startSeconds")).alias("start_s"),
            _number(_at(s, "$.endSeconds")).alias("end_s"),
            _number(_at(s, "$.confidence")).alias("confidence"),
            _string(_at(s, "$.reason")).alias("reason"),
            _string(_at(s, "$.detail")).alias("detail"),
        ),
    )
    columns = {
        "id": F.col("id"),
        "received_at": F.col("received_at"),
        "created_at": text("createdAt"),
        "client_id": text("clientId"),
        "video_url": text("videoUrl"),
        "video_id": text("videoId"),
        "occurrence_id": text("occurrenceId"),
        "occurrence_type": text("occurrenceType"),
        "source": text("source"),
        "start_s": start,
        "end_s": end,
        "summary": text("summary"),
        "reason": text("reason"),
        "feedback": text("feedback"),
        "notes": text("notes"),
        "model_id": text("modelId"),
        "model_version": text("modelVersion"),
        "model_source": text("modelSource"),
        "feature_schema_version": version,
        "heuristic_confidence": num("heuristicConfidence"),
        "model_confidence": num("modelConfidence"),
        "candidate_features": F.transform_values(features, lambda _, x: _number(x)),
        "evidence_snapshot": shot,
        "transcript_context": text("transcriptContext"),
    }
    fields = S.struct_of(S.FEEDBACK)
    return _judged(df, checks, F.struct(*[columns[f.name].cast(f.dataType).alias(f.name) for f in fields]))


def validate_reviews(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted reviews, and rejected input rows with ``errors``; see ``check_reviews``."""
    return _split(check_reviews(raw))


def check_reviews(raw: DataFrame) -> DataFrame:
    """``id, feedback_id, reviewed_at, body`` (JSON text) with ``errors``, and the review ``row`` if there are none."""
    df = raw.withColumn("_v", F.try_parse_json("body"))
    at = lambda n: _at(F.col("_v"), f"$.{n}")
    label, fix = _string(at("label")), at("boundaryCorrection")
    start, end = _number(at("boundaryCorrection.startSeconds")), _number(at("boundaryCorrection.endSeconds"))
    is_object = F.coalesce(_kind(fix).startswith("OBJECT"), F.lit(False))
    no_end = at("boundaryCorrection.endSeconds").isNull()
    checks = [
        ("label", label.isin(S.REVIEW_LABELS)),
        ("notes", at("notes").isNull() | _string(at("notes")).isNotNull()),
        ("correction", fix.isNull() | (is_object & (start >= 0) & (no_end | ((end >= 0) & (end > start))))),
        ("correctionNeeded", (label != "wrong_timing") | fix.isNotNull()),
        ("correctionForbidden", (label == "wrong_timing") | fix.isNull()),
    ]
    correction = F.when(fix.isNotNull(), F.struct(start.alias("start_s"), end.alias("end_s")))
    row = F.struct(
        "id", "feedback_id", label.alias("label"), _string(at("notes")).alias("notes"),
        correction.alias("boundary_correction"), "reviewed_at",
    )
    return _judged(df, checks, row)


def _numbers(given: Column) -> Column:
    """The numbers of a map of variants, NULL where a value is none."""
    return F.transform_values(given, lambda _, x: _number(x))


def _finite_only(numbers: Column) -> Column:
    """Map of finite numbers, NULL if it holds anything else."""
    return F.when(F.forall(F.map_values(numbers), lambda x: x.isNotNull()), numbers)


def _profile_numbers(given: Column) -> Column:
    """The numbers of a profile, and whether it names an end at all."""
    return F.struct(
        *[_number(given[n]).alias(n) for n in PROFILE_FIELDS], given["endOffsetSeconds"].isNotNull().alias("end_given")
    )


def _profile(p: Column) -> Column:
    ok = (
        (F.abs(p["startOffsetSeconds"]) <= MAX_OFFSET_S)
        & (~p["end_given"] | F.coalesce(F.abs(p["endOffsetSeconds"]) <= MAX_OFFSET_S, F.lit(False)))
        & (p["trainingExamples"] >= 1)
        & (p["validationExamples"] >= 1)
        & (p["videoGroups"] >= 1)
        & (p["baselineMaeSeconds"] >= 0)
        & (p["calibratedMaeSeconds"] >= 0)
        & (p["calibratedMaeSeconds"] < p["baselineMaeSeconds"])
    )
    return F.when(
        F.coalesce(ok, F.lit(False)),
        F.struct(
            p["startOffsetSeconds"].alias("start_offset_s"),
            p["endOffsetSeconds"].alias("end_offset_s"),
            p["trainingExamples"].cast("bigint").alias("training_examples"),
            p["validationExamples"].cast("bigint").alias("validation_examples"),
            p["videoGroups"].cast("bigint").alias("video_groups"),
            p["baselineMaeSeconds"].alias("baseline_mae_s"),
            p["calibratedMaeSeconds"].alias("calibrated_mae_s"),
        ),
    )


def load_models(artifacts: DataFrame) -> DataFrame:
    """``document`` (JSON text) to valid model rows; invalid artifacts are dropped.

    Each part of a document is taken out once and each number judged once, step by step in projections: Spark interprets
    a generator that holds lambdas, and computes in it whatever it names twice.
    """
    parts = artifacts.select(F.try_variant_get(F.try_parse_json("document"), "$", ARTIFACT).alias("_d")).select("_d.*")
    raw = parts.withColumn("_c", F.try_variant_get("boundaryCalibration", "$", CALIBRATION))
    raw = raw.withColumn("_g", F.try_variant_get("_c.global", "$", PROFILE))
    numbers = raw.select(
        _string(F.col("modelId")).alias("model_id"),
        _string(F.col("modelVersion")).alias("model_version"),
        _number(F.col("featureSchemaVersion")).cast("int").alias("feature_schema_version"),
        _string(F.col("createdAt")).alias("created_at"),
        _string(F.col("promotedAt")).alias("promoted_at"),
        _number(F.col("intercept")).alias("intercept"),
        _numbers(F.col("weights")).alias("weights"),
        _numbers(F.col("thresholds")).alias("thresholds"),
        _numbers(F.col("metrics")).alias("metrics"),
        _numbers(F.col("trainingSetSummary")).alias("training_set_summary"),
        F.col("boundaryCalibration").isNotNull().alias("_has"),
        F.col("_c.global").isNotNull().alias("_has_global"),
        (_number(F.col("_c.version")) == 1).alias("_v1"),
        _profile_numbers(F.col("_g")).alias("_global"),
        F.transform_values("_c.bySource", lambda _, x: _profile_numbers(x)).alias("_by_source"),
    )
    judged = {c: _finite_only(F.col(c)) for c in ("weights", "thresholds", "metrics", "training_set_summary")}
    judged |= {"_global": _profile(F.col("_global")), "_by_source": F.transform_values("_by_source", lambda _, x: _profile(x))}
    row = F.struct(*[judged.get(c, F.col(c)).alias(c) for c in numbers.columns])
    df = numbers.select(row.alias("_row")).select(F.explode(F.array("_row")).alias("_row")).select("_row.*")
    positive = F.try_element_at("thresholds", F.lit("positive"))
    review = F.try_element_at("thresholds", F.lit("review"))
    named = [F.trim(c) != "" for c in ("model_id", "model_version", "created_at")]
    finite = [F.col(c).isNotNull() for c in ("weights", "metrics", "training_set_summary")]
    sources = F.col("_by_source")
    calibration_ok = ~F.col("_has") | (
        F.col("_v1")
        & sources.isNotNull()
        & (~F.col("_has_global") | F.col("_global").isNotNull())
        & F.forall(F.map_entries(sources), lambda e: (F.trim(e["key"]) != "") & e["value"].isNotNull())
        & (F.col("_global").isNotNull() | (F.size(sources) > 0))
    )
    checks = named + finite + [
        F.col("feature_schema_version") == S.FEATURE_SCHEMA_VERSION,
        is_finite(F.col("intercept")),
        positive.between(0, 1) & review.between(0, 1) & (review <= positive),
        calibration_ok,
    ]
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])
    calibration = F.when(F.col("_has"), F.struct(F.col("_global").alias("global"), sources.alias("by_source")))
    out = fenced(df, valid=ok, boundary_calibration=calibration).filter("valid")
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.struct_of(S.MODEL)])


def active_model(models: DataFrame, events: DataFrame, registry: str | None = "default") -> DataFrame:
    """The promoted model if it is valid, otherwise no row (scores fall back to heuristics); ``None``: of each registry."""
    from ..operators.registry import promoted_model

    return promoted_model(events, models, registry)
