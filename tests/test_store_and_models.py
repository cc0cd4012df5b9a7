"""Golden cases for feedback, training, registry, sources, features and scores."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fixtures import cue_df, evidence_df
from reelmark.operators import dashboard, feedback as fb, features as ft, fusion, registry, reports, scoring, training
from reelmark.sources import captions, intake, schemas as S, store

APP = "sample-app"


def payload(**over):
    body = {
        "app": APP, "version": 2, "createdAt": "2026-07-07T10:00:00.000Z", "clientId": "client_fixture",
        "videoUrl": "https://video.example/watch?v=abc123", "videoId": "abc123", "occurrenceId": "candidate-42",
        "occurrenceType": "candidate", "source": "transcript", "startSeconds": 42, "summary": "0:42-1:30", "reason": "cue",
        "feedback": "accurate", "modelId": "baseline", "modelVersion": "1", "modelSource": "fallback",
        "featureSchemaVersion": 2, "heuristicConfidence": 0.74, "modelConfidence": 0.82,
        "candidateFeatures": {"heuristicConfidence": 0.74, "evidenceTotal": 2},
        "evidenceSnapshot": [{"source": "transcript", "kind": "ad-read-start", "startSeconds": 42, "confidence": 0.85, "reason": "cue"}],
    }
    body.update(over)
    return json.dumps({k: v for k, v in body.items() if v != "drop"})


def intake_df(spark, bodies):
    rows = [(f"f{i}", datetime(2026, 7, 7, 10, i), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "id string, received_at timestamp, body string")


def test_feedback_intake(spark):
    cases = [
        (payload(), None), (payload(clientId="drop", source="drop", evidenceSnapshot="drop"), None),
        (payload(videoId=None, videoUrl=None), None), ("not json", "body"), (payload(app="x"), "app"),
        (payload(clientId="a b"), "clientId"), (payload(clientId="x" * 129), "clientId"), (payload(endSeconds=42), "endSeconds"),
        (payload(createdAt="2026-07-07"), "createdAt"), (payload(startSeconds="42"), "startSeconds"),
        (payload(startSeconds=-1), "startSeconds"), (payload(feedback="meh"), "feedback"), (payload(summary=""), "summary"),
        (payload(candidateFeatures={"a": "1"}), "candidateFeatures"), (payload(featureSchemaVersion=1.5), "featureSchemaVersion"),
        (payload(evidenceSnapshot=[{"source": ""}]), "evidenceSnapshot"), (payload(modelConfidence=1.2), "modelConfidence"),
        (payload(occurrenceType="missed-segment", endSeconds=90), "missedLabel"),
        (payload(occurrenceType="missed-segment", endSeconds=900, feedback="missed_context", source="user-missed-segment"), "missedRange"),
        (payload(occurrenceType="missed-segment", endSeconds=90, feedback="missed_context", source="user-missed-segment"), None),
        (payload(videoUrl="drop"), "videoUrl"),
    ]
    good, bad = intake.ingest_feedback(intake_df(spark, [c[0] for c in cases]), APP)
    errors = {r.id: r.errors for r in bad.collect()}
    ids = {r.id for r in good.collect()}
    for i, (_, error) in enumerate(cases):
        if error is None:
            assert f"f{i}" in ids, (i, errors.get(f"f{i}"))
        else:
            assert error in errors[f"f{i}"], (i, errors.get(f"f{i}"))
    row = good.filter("id = 'f0'").first()
    assert row.candidate_features == {"heuristicConfidence": 0.74, "evidenceTotal": 2.0}
    assert row.evidence_snapshot[0].kind == "ad-read-start" and row.start_s == 42.0


def test_keys_and_first_write(spark):
    import hashlib

    bodies = [
        payload(), payload(createdAt="2026-07-24T10:05:00.000Z", modelVersion="newer"), payload(feedback="false_positive"),
        payload(endSeconds=95), payload(clientId="drop"), payload(videoId=None, videoUrl=None), payload(startSeconds=42.12345),
    ]
    keyed = fb.dedup_key(intake.ingest_feedback(intake_df(spark, bodies), APP)[0])
    rows = {r.id: r.dedup_key for r in keyed.collect()}
    text = (
        '{"version":1,"clientId":"client_fixture","video":"abc123","occurrenceId":"candidate-42","occurrenceType":"candidate",'
        '"source":"transcript","startSeconds":42,"endSeconds":null,"feedback":"accurate"}'
    )
    assert rows["f0"] == rows["f1"] == "feedback-v1-" + hashlib.sha256(text.encode()).hexdigest()
    text = text.replace('"startSeconds":42,', '"startSeconds":42.123,')
    assert rows["f6"] == "feedback-v1-" + hashlib.sha256(text.encode()).hexdigest()
    assert rows["f4"] is None and rows["f5"] is None and len(set(rows.values())) == 5
    assert {r.id for r in fb.first_write_wins(keyed).collect()} == {"f0", "f2", "f3", "f4", "f5", "f6"}
    assert {r.stored_id: r.retries for r in fb.retry_counts(keyed).collect()}["f0"] == 1
    half = keyed.withColumn("dedup_key", F.when(F.col("id") == "f1", F.col("dedup_key")))
    assert {r.id for r in fb.backfill_keys(half).collect()} == {"f2", "f3", "f6"}


def review_df(spark, rows):
    data = [(f"r{i}", f, label, None, fix, datetime(2026, 7, 8, 0, i)) for i, (f, label, fix) in enumerate(rows)]
    return spark.createDataFrame(data, S.REVIEW)


def test_reviews_and_dataset(spark):
    bodies = [json.dumps(b) for b in (
        {"label": "positive"}, {"label": "wrong_timing"}, {"label": "wrong_timing", "boundaryCorrection": {"startSeconds": 5, "endSeconds": 5}},
        {"label": "positive", "boundaryCorrection": {"startSeconds": 5}}, {"label": "wrong_timing", "boundaryCorrection": {"startSeconds": 5}}, {"label": "?"},
    )]
    raw = spark.createDataFrame([(f"r{i}", "f", datetime(2026, 1, 1), b) for i, b in enumerate(bodies)], "id string, feedback_id string, reviewed_at timestamp, body string")
    good, bad = intake.validate_reviews(raw)
    assert {r.id for r in good.collect()} == {"r0", "r4"} and bad.count() == 4
    feedback = intake.ingest_feedback(
        intake_df(spark, [payload(endSeconds=90), payload(candidateFeatures="drop"), payload(featureSchemaVersion=1), payload(), payload()]), APP
    )[0]
    review = review_df(spark, [
        ("f0", "positive", None), ("f0", "wrong_timing", (47.0, 96.0)), ("f1", "positive", None), ("f2", "duplicate", None), ("f3", "positive", None),
    ])
    rows = {r.feedback_id: r for r in fb.dataset_rows(feedback, review).collect()}
    assert rows["f0"].exclusion_reason.startswith("wrong_timing is stored") and rows["f0"].start_offset_s == 5.0 and rows["f0"].end_offset_s == 6.0
    assert "does not include candidate features" in rows["f1"].exclusion_reason
    assert rows["f2"].exclusion_reason == "Feature schema 1 is not compatible with active schema 2."
    assert rows["f3"].trainable and rows["f4"].exclusion_reason == "Feedback has not been reviewed yet."
    examples = fb.training_examples(feedback, review)
    assert {r.feedback_id: r.label for r in examples.collect()} == {"f2": 0, "f3": 1}
    ready = fb.training_readiness(examples).first()
    assert (ready.total_examples, ready.compatible_examples, ready.ready) == (2, 1, False) and "at least one" in ready.blocker
    b = fb.boundary_examples(feedback, review).collect()
    assert [(r.feedback_id, r.source, r.predicted_start_s, r.predicted_end_s, r.corrected_start_s, r.corrected_end_s) for r in b] == [
        ("f0", "transcript", 42.0, 90.0, 47.0, 96.0)
    ]
    quality = {r.source: r for r in dashboard.detector_quality(feedback, review).collect()}
    assert (quality["transcript"].total, quality["transcript"].pending, quality["transcript"].positive_rate) == (5, 1, 0.5)
    queue = dashboard.review_queue(feedback, review).collect()
    assert [(r.id, r.watch_url) for r in queue] == [("f4", "https://video.example/watch?v=abc123&t=42s")]
    assert [r.id for r in dashboard.feedback_search(feedback, review, "CANDIDATE-42", sort="received-asc").collect()] == ["f0", "f1", "f2", "f3", "f4"]


def test_tables(spark, tmp_path):
    feedback = intake.ingest_feedback(intake_df(spark, [payload(), payload()]), APP)[0]
    store.append(feedback, str(tmp_path / "t"), "feedback")
    store.append(feedback.withColumn("id", F.concat("id", F.lit("x"))), str(tmp_path / "t"), "feedback")
    assert [r.id for r in store.listing(spark, str(tmp_path / "t"), "feedback").collect()] == ["f1", "f1x", "f0", "f0x"]
    store.write_json_lines(store.export_model(feedback.withColumn("model_id", F.lit("m")), "m"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def scored_df(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "label int, score double")


def test_thresholds_and_auc(spark):
    df = scored_df(spark, [(0, 0.1), (0, 0.2), (1, 0.6), (0, 0.7), (1, 0.8), (1, 0.9)])
    c = training.calibrate_thresholds(df).first()
    assert (c.positive, c.review, c.calibrated, c.examples, c.positives, c.negatives) == (0.8, 0.6, True, 6, 3, 3)
    c = training.calibrate_thresholds(scored_df(spark, [(1, 0.7), (1, 0.9)])).first()
    assert (c.positive, c.review, c.calibrated) == (0.65, 0.45, False)
    assert training.auc(df).first().auc == pytest.approx(8 / 9)
    assert training.auc(scored_df(spark, [(1, 0.5), (0, 0.5), (0, 0.1)])).first().auc == 0.75
    assert training.auc(scored_df(spark, [(1, 0.5)])).first().auc == 0.5


def test_training(spark):
    rows = [
        (f"e{i}", f"f{i}", f"video-{i // 2}", f"c{i}", i % 2, 2, {"heuristicConfidence": 0.2 + 0.6 * (i % 2) + i / 1000, "startSeconds": 9.0}, datetime(2026, 1, 1))
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "id string, feedback_id string, video_id string, occurrence_id string, label int, feature_schema_version int, features map<string,double>, created_at timestamp")
    split = training.group_split(df).collect()
    sides = {}
    for r in split:
        sides.setdefault(r.video_id, set()).add(r.holdout)
    assert all(len(s) == 1 for s in sides.values()) and any(r.holdout for r in split)
    intercept, weights = training.train_logistic(df.filter("id < 'e3'"), ["heuristicConfidence"], 5)
    sample = [(r[6]["heuristicConfidence"], r[4]) for r in rows if r[0] < "e3"]
    b = w = 0.0
    import math

    for _ in range(5):
        errors = [1 / (1 + math.exp(-(b + w * x))) - y for x, y in sample]
        gb, gw = sum(errors), sum(e * x for e, (x, _) in zip(errors, sample))
        w = round(w - 0.08 * (gw / len(sample) + 0.001 * w), 6)
        b = round(b - 0.08 * gb / len(sample), 6)
    assert (intercept, weights["heuristicConfidence"]) == pytest.approx((b, w), abs=1e-6)
    now = datetime(2026, 7, 7, 10, 0, 0, tzinfo=timezone.utc)
    model = training.model_artifact(df, now, iterations=3).first()
    again = training.model_artifact(df, now, iterations=3).first()
    assert model == again and model.model_id.startswith("model_") and model.model_version == "2026.07.07.100000"
    assert list(model.weights) == ["heuristicConfidence"] and model.training_set_summary["examples"] == 40
    assert model.metrics["thresholdsCalibrated"] == 1 and model.metrics["auc"] == 1.0


def boundary_df(spark, n, video):
    rows = [(f"f{i}", video(i), "transcript", 100.0 + i, 160.0 + i, 105.0 + i, 166.0 + i) for i in range(n)]
    return spark.createDataFrame(
        rows, "feedback_id string, video_id string, source string, predicted_start_s double, predicted_end_s double, corrected_start_s double, corrected_end_s double"
    )


def test_boundary_calibration(spark):
    out = {r.source: r for r in training.calibrate_boundaries(boundary_df(spark, 30, lambda i: f"video-{i}")).collect()}
    assert set(out) == {"*", "transcript"}
    r = out["*"]
    assert (r.start_offset_s, r.end_offset_s, r.baseline_mae_s, r.calibrated_mae_s) == (5.0, 6.0, 5.5, 0.0)
    assert training.calibrate_boundaries(boundary_df(spark, 20, lambda i: "same-video")).count() == 0


def test_grouped_median(spark):
    import random
    import statistics

    rng = random.Random(2)
    data = [(k, float(rng.choice([rng.randrange(-50, 50), rng.random() * 9]))) for k in "abc" for _ in range(rng.choice([7, 40, 41]))]
    got = {r.k: r.med for r in training.grouped_median(spark.createDataFrame(data, "k string, v double"), "k", "v", "med").collect()}
    assert got == {k: pytest.approx(statistics.median(v for kk, v in data if kk == k)) for k in "abc"}


def model_rows(spark, items):
    docs = []
    for name, over, boundary in items:
        metrics = {
            "validationExamples": 40, "thresholdsCalibrated": 1, "thresholdCalibrationExamples": 40, "thresholdCalibrationPositives": 20,
            "thresholdCalibrationNegatives": 20, "thresholdCalibrationGroups": 10, "positivePrecision": 0.95, "positiveRecall": 0.75,
            "reviewRecall": 0.98, "auc": 0.9, **over,
        }
        profile = {"startOffsetSeconds": 5, "endOffsetSeconds": 6, "trainingExamples": 30, "validationExamples": 8, "videoGroups": 15, "baselineMaeSeconds": 5.5, "calibratedMaeSeconds": boundary}
        doc = {
            "modelId": name, "modelVersion": "v", "featureSchemaVersion": 2, "createdAt": "2026-07-24T00:00:00.000Z", "promotedAt": None, "intercept": 0,
            "weights": {"heuristicConfidence": 1, "qrCount": -3}, "thresholds": {"positive": 0.75, "review": 0.5}, "metrics": metrics, "trainingSetSummary": {"examples": 200},
        }
        if boundary is not None:
            doc["boundaryCalibration"] = {"version": 1, "global": profile, "bySource": {"transcript": profile}}
        docs.append(doc)
    return docs


def load(spark, docs):
    return intake.load_models(spark.createDataFrame([(json.dumps(d),) for d in docs], "document string"))


def test_models_and_safety(spark):
    good, tiny, base, worse, removed, slow = docs = model_rows(spark, [
        ("good", {}, None), ("tiny", {"thresholdsCalibrated": 0, "thresholdCalibrationExamples": 4}, None),
        ("base", {"positivePrecision": 0.96, "positiveRecall": 0.82, "reviewRecall": 0.98, "auc": 0.92}, 0.4),
        ("worse", {"positivePrecision": 0.91, "positiveRecall": 0.7, "reviewRecall": 0.9, "auc": 0.82}, 0.4),
        ("removed", {}, None), ("slow", {}, 1.2),
    ])
    broken = [
        {**good, "modelId": " "}, {**good, "featureSchemaVersion": 1}, {**good, "weights": {"a": "x"}}, {**good, "thresholds": {"positive": 0.4, "review": 0.5}},
        {**good, "boundaryCalibration": {"version": 1, "bySource": {}}}, {**base, "boundaryCalibration": {"version": 2, "bySource": base["boundaryCalibration"]["bySource"]}},
        model_rows(spark, [("flat", {}, 5.5)])[0],
    ]
    models = load(spark, docs + broken).cache()
    assert sorted(r.model_id for r in models.collect()) == ["base", "good", "removed", "slow", "tiny", "worse"]
    alone = {r.model_id: r for r in registry.promotion_safety(models, None).collect()}
    assert alone["good"].safe and any("not calibrated" in b for b in alone["tiny"].blockers)
    assert any("at least 20.000; received 4.000" in b for b in alone["tiny"].blockers)
    beside = {r.model_id: list(r.blockers) for r in registry.promotion_safety(models, models.filter("model_id = 'base'")).collect()}
    assert [b.split(" regresses")[0] for b in beside["worse"]] == ["Display precision", "Display recall", "Review recall", "AUC"]
    assert "Candidate removes the promoted model boundary calibration." in beside["removed"]
    assert [b.split(" regresses")[0] for b in beside["slow"] if "MAE" in b] == ["Global boundary MAE", "transcript boundary MAE"]
    assert [r.feature for r in registry.top_weights(models.filter("model_id = 'good'"), 1).collect()] == ["qrCount"]
    assert registry.model_list(models, "slow").first().model_id == "slow"
    report = registry.evaluation_report(models, models.filter("model_id = 'base'")).filter("model_id = 'worse'").first()
    assert report.metric_deltas["auc"] == -0.1 and report.threshold_calibration.mode == "validation"


def test_promotions(spark):
    log = [("promote", "a"), ("promote", "b"), ("rollback", "a"), ("rollback", "b"), ("promote", "a"), ("rollback", "a"), ("rollback", "b"), ("rollback", "a"), ("rollback", "a")]
    rows = [("default", f"p{i:02}", m, datetime(2026, 1, 1, 0, i), a) for i, (a, m) in enumerate(log)]
    df = spark.createDataFrame(rows, "registry string, id string, model_id string, promoted_at timestamp, action string")
    got = [(r.accepted, r.active_model_id) for r in registry.replay_promotions(df).orderBy("id").collect()]
    assert got == [(True, "a"), (True, "b"), (False, "b"), (True, "a"), (True, "a"), (True, "b"), (True, "a"), (True, "b"), (False, "b")]


def test_captions(spark):
    events = {"events": [
        {"tStartMs": 1200, "dDurationMs": 3000, "segs": [{"utf8": "Today's "}, {"utf8": "sponsor\n is"}, {"x": 1}]},
        {"tStartMs": "5", "segs": [{"utf8": "no"}]}, {"tStartMs": 5000}, 7, {"tStartMs": 6000, "segs": [{"utf8": " \n"}]},
        {"tStartMs": 7500, "dDurationMs": "x", "segs": [{"utf8": "last"}, {"utf8": 4}]},
    ]}
    df = spark.createDataFrame([("v", json.dumps(events)), ("w", "nope"), ("x", '{"events":{}}')], "video_id string, payload string")
    assert [(r.start_s, r.dur_s, r.text) for r in captions.caption_events_to_cues(df).orderBy("cue_idx").collect()] == [
        (1.2, 3.0, "Today's sponsor is"), (7.5, 0.0, "last"),
    ]
    player = {"captions": {"playerCaptionsTracklistRenderer": {"captionTracks": [
        {"baseUrl": "https://c.example/1", "languageCode": "fr", "name": {"simpleText": "French"}},
        {"baseUrl": "https://c.example/2", "languageCode": "en", "name": {"runs": [{"text": "English "}, {"text": "(auto)"}]}, "kind": "asr"},
        {"languageCode": "en"}, {"baseUrl": "https://c.example/3", "languageCode": "EN-us"},
    ]}}, "note": "brace } and \" quote"}
    page = f"<script>var x = 1; ytInitialPlayerResponse = {json.dumps(player)};var y = {{}};</script>"
    df = spark.createDataFrame([("v", page), ("w", "<html>"), ("x", "ytInitialPlayerResponse = {broken")], "video_id string, html string")
    tracks = captions.pages_to_caption_tracks(df)
    assert [(r.lang, r.name, r.kind) for r in tracks.orderBy("track_idx").collect()] == [("fr", "French", None), ("en", "English (auto)", "asr"), ("EN-us", "", None)]
    assert captions.pick_caption_track(tracks).first().lang == "EN-us"
    assert captions.assigned_object("a = {'}': '\\'}'} tail", "a") == "{'}': '\\'}'}"


def test_phrase_groups(spark):
    group = {"id": "g", "kind": "ad-read-start", "confidence": 0.5, "reasonLabel": "G", "phrases": [" a ", "b", "a"]}
    docs = {"ok": [group, {**group, "id": "h", "enabled": False}], "bad": [group, {**group, "phrases": [" "]}], "kind": [{**group, "kind": "x"}], "empty": []}
    df = spark.createDataFrame([*[(k, json.dumps(v)) for k, v in docs.items()], ("text", "{")], "config_id string, document string")
    out = intake.load_phrase_groups(df).collect()
    count = {k: sum(r.config_id == k for r in out) for k in [*docs, "text"]}
    assert count == {"ok": 4, "bad": 44, "kind": 44, "empty": 0, "text": 44}
    assert [(r.phrase, r.enabled) for r in out if r.config_id == "ok" and r.group_id == "h"] == [("a", False), ("b", False)]


def candidate(spark, rows, start, end, confidence):
    member = evidence_df(spark, rows).withColumn("cand_idx", F.lit(0).cast("bigint"))
    cand = spark.createDataFrame([("v", 0, start, end, confidence)], "video_id string, cand_idx bigint, start_s double, end_s double, confidence double")
    return cand, member


def test_features(spark):
    cand, member = candidate(spark, [
        {"kind": S.START, "start_s": 100, "confidence": 0.85, "reason": "start", "raw": {"phrase_group_id": "sponsor-start"}},
        {"source": S.QR_CODE, "kind": S.PRESENCE, "start_s": 108, "confidence": 0.9, "reason": "qr", "raw": {"value": "https://brand.example/qr", "location": ((100.0, 40.0), (180.0, 120.0))}},
        {"source": S.PROGRESS_BAR, "kind": S.PRESENCE, "start_s": 112, "confidence": 0.62, "reason": "bar", "raw": {"start_x": 20.0, "end_x": 140.0, "y": 280.0, "rows": 3.0}},
        {"source": S.VISIBLE_LINK, "kind": S.PRESENCE, "start_s": 115, "confidence": 0.72, "reason": "link"},
        {"kind": S.END, "start_s": 160, "confidence": 0.7, "reason": "please use"},
        {"kind": S.PRESENCE, "start_s": 161, "confidence": 0.7, "reason": "code now"},
    ], 100.0, 160.0, 0.74)
    context = spark.createDataFrame([("v", 0, "This episode is made possible by Acme. Visiting")], "video_id string, cand_idx bigint, transcript_context string")
    video = spark.createDataFrame([("v", 1000.0)], "video_id string, duration_s double")
    r = ft.candidate_features(cand, member, context, video).first().asDict()
    want = {
        "evidenceTotal": 6, "transcriptStartCount": 1, "transcriptEndCount": 1, "qrCount": 1, "qrLocationCount": 1, "avgQrBoxAreaPixels": 6400, "avgQrBoxCenterX": 140,
        "avgQrBoxCenterY": 80, "avgProgressBarWidthPixels": 121, "avgProgressBarY": 280, "avgProgressBarRows": 3, "maxTranscriptConfidence": 0.85, "avgTranscriptConfidence": 0.75,
        "startSeconds": 100, "durationSeconds": 60, "isOpenEnded": 0, "normalizedVideoPosition": 0.1, "evidenceTimeSpanSeconds": 61, "hasTranscriptAndQr": 1, "hasQrAndVisibleLink": 1,
        "isFrameOnly": 0, "isTranscriptOnly": 0, "matchedPhraseGroupCount": 1, "sponsorPhraseHitCount": 1, "callToActionPhraseHitCount": 1, "nearbyEndCue": 1, "heuristicConfidence": 0.74,
    }
    assert {k: r[k] for k in want} == want and len(r) == 40


def test_scoring(spark):
    cand, member = candidate(spark, [
        {"kind": S.START, "start_s": 100, "confidence": 0.85}, {"source": S.QR_CODE, "kind": S.PRESENCE, "start_s": 100, "confidence": 0.9, "raw": {"value": "x", "location": ((1.4, 2.0), (11.6, 5.0))}},
    ], 100.0, 160.0, 0.74)
    vector = ft.candidate_features(cand, member)
    model = scoring.Model("m", "1", -1.0, {"heuristicConfidence": 2.0, "qrCount": 0.5, "unknown": 9.0}, {"positive": 0.8, "review": 0.5}, None, {"transcript": {"start_offset_s": 5.0, "end_offset_s": None}})
    out = scoring.select_bands(scoring.apply_boundary_offsets(scoring.apply_model(cand, vector, model), member, model), model).first()
    assert out.confidence == pytest.approx(1 / (1 + 2.718281828459045 ** -0.98), abs=1e-6) and out.heuristic_confidence == 0.74
    assert (out.band, out.start_s, out.end_s, out.model_source) == ("review", 105.0, 165.0, "downloaded")
    plain = scoring.select_bands(scoring.apply_model(cand, vector, None), None).first()
    assert (plain.confidence, plain.band, plain.model_source, plain.model_id) == (0.74, "display", "fallback", None)
    shrink = scoring.Model("m", "1", 0.0, {}, {}, {"start_offset_s": 0.0, "end_offset_s": -60.0})
    assert scoring.apply_boundary_offsets(cand, member, shrink).first().end_s == 160.0
    view = scoring.candidate_view(cand, member).first()
    assert (view.view_id, view.summary) == ("100-160", "1:40-2:40 · 74% · transcript + QR")
    assert {r.detail for r in scoring.evidence_view(member).collect()} == {None, "x (QR box 1,2 10x3)"}
    assert scoring.skippable(cand, member).count() == 0


def test_timecodes_and_missed_segments(spark):
    codes = {"1:20": 80.0, "1:02:03": 3723.0, "1:75": None, "90.5": 90.5, "1:60:00": None, "x": None, " 5 ": 5.0, "1:2:3:4": None, "1.5:20": None}
    df = spark.createDataFrame([(k, v) for k, v in codes.items()], "t string, e double")
    assert reports.with_timecode(df, "t", "s").filter("not (s <=> e)").count() == 0
    assert [r[0] for r in spark.createDataFrame([(80.0,), (3723.0,)], "s double").select(reports.timecode_text(F.col("s"))).collect()] == ["1:20", "1:02:03"]
    report = spark.createDataFrame([("r1", "v", 100.0, 160.0, 500.0), ("r2", "v", 300.0, 320.0, 500.0)], "report_id string, video_id string, start_s double, end_s double, duration_s double")
    ev = evidence_df(spark, [{"kind": S.START, "start_s": 90, "end_s": 101.0, "confidence": 0.6}, {"kind": S.END, "start_s": 160, "confidence": 0.7}, {"kind": S.END, "start_s": 161, "confidence": 0.9}])
    cues = cue_df(spark, [(86, "before  it"), (80, "too early"), (168, "after")])
    out = {r.report_id: r for r in reports.missed_segment_context(report, ev, cues, None).collect()}
    assert (out["r1"].heuristic_confidence, out["r1"].n_evidence, out["r1"].transcript_context) == (0.7, 2, "before it after")
    assert out["r1"].candidate_features["evidenceTotal"] == 2.0
    assert (out["r2"].n_evidence, out["r2"].candidate_features, out["r2"].model_source) == (0, None, "fallback")


def test_results_do_not_depend_on_partitions(spark):
    rows = [{"video_id": f"v{i % 3}", "ev_idx": i, "source": S.QR_CODE if i % 2 else "transcript", "kind": S.PRESENCE if i % 5 else S.START, "start_s": (i * 37) % 400, "confidence": 0.5, "raw": {"value": f"c{i % 2}"}} for i in range(200)]
    df = evidence_df(spark, rows)
    one = fusion.candidate_pool(df.coalesce(1)).collect()
    many = fusion.candidate_pool(df.repartition(13)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) > 20


# ---- tables that change by key ------------------------------------------------------


def runs(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at string, status string, metrics map<string,double>")


def test_keyed_tables_rewrite_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    many = [(f"run-{i}", f"2024-01-{1 + i % 28:02d}", "running", {"auc": i / 1000}) for i in range(1000)]
    first = store.upsert(runs(spark, many), root, "training_run")
    second = store.upsert(runs(spark, [("run-7", "2024-01-08", "completed", None), ("new", "2024-02-01", "running", {})]), root, "training_run")
    written = {p.name for p in (tmp_path / "training_run/data" / f"version={second}").iterdir() if p.name.startswith("bucket=")}
    assert 1 <= len(written) <= 2
    want = {r[0]: r[2] for r in many} | {"run-7": "completed", "new": "running"}
    assert {r.id: r.status for r in store.read(spark, root, "training_run").collect()} == want
    assert {r.id: r.status for r in store.snapshot(spark, root, "training_run", first).collect()} == {r[0]: r[2] for r in many}
    listed = [(r.created_at, r.id) for r in store.listing(spark, root, "training_run").collect()]
    assert listed == sorted(listed, key=lambda x: x[1]) or [x[0] for x in listed] == sorted((x[0] for x in listed), reverse=True)


def test_keyed_tables_delete_and_forget(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        store.snapshot(spark, root, "training_run")
    store.upsert(runs(spark, [("a", "2024-01-01", "x", None), ("b", "2024-01-02", "y", None)]), root, "training_run")
    store.delete(spark.createDataFrame([("a",), ("a",), ("missing",)], "id string"), root, "training_run")
    assert [r.id for r in store.read(spark, root, "training_run").collect()] == ["b"]
    last = store.delete(spark.createDataFrame([("b",)], "id string"), root, "training_run")
    left = store.read(spark, root, "training_run")
    assert left.collect() == [] and left.columns == ["id", "created_at", "status", "metrics"]
    store.vacuum(spark, root, "training_run", keep=1)
    assert store.versions(spark, root, "training_run") == [last]
    store.upsert(runs(spark, []), root, "training_run")
    store.upsert(runs(spark, [("b", "2024-01-02", "again", None)] * 2), root, "training_run")
    assert [(r.id, r.status) for r in store.read(spark, root, "training_run").collect()] == [("b", "again")]


def test_a_change_that_was_lost_is_never_read(spark, tmp_path):
    root = str(tmp_path)
    store.upsert(runs(spark, [("a", "2024-01-01", "x", None)]), root, "training_run")
    # A writer that ended between its rows and its commit, and one that ended within the commit.
    lost = runs(spark, [("a", "2024-01-01", "lost", None)]).withColumn("bucket", F.lit(5))
    lost.write.partitionBy("bucket").parquet(f"{root}/training_run/data/version=9")
    (tmp_path / "training_run/commits/version=9").mkdir()
    assert [r.status for r in store.read(spark, root, "training_run").collect()] == ["x"]
    assert store.upsert(runs(spark, [("c", "2024-01-01", "z", None)]), root, "training_run") == 10
    assert {(r.id, r.status) for r in store.read(spark, root, "training_run").collect()} == {("a", "x"), ("c", "z")}
    # Of rows of one key in one change, the newest stays.
    store.upsert(runs(spark, [("c", "2024-01-03", "new", None), ("c", "2024-01-02", "old", None)]), root, "training_run")
    assert store.read(spark, root, "training_run").filter("id = 'c'").first().status == "new"
    store.vacuum(spark, root, "training_run", keep=1)
    assert {(r.id, r.status) for r in store.read(spark, root, "training_run").collect()} == {("a", "x"), ("c", "new")}
