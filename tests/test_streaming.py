"""Stateful jobs: golden sequences, and streams give what the batch jobs give."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from reelmark.operators import admission, frames, playback, status
from reelmark.operators import fusion
from reelmark.streaming import jobs

OBS = (
    "video_id string, frame_idx bigint, t_s double, y double, rows double, frame_width double, frame_height double, "
    "track_start_x double, track_end_x double, start_x double, end_x double, fill_ratio double, confidence double"
)


def obs(video, i, t, fill, y=180, track=(100, 800), missing=False):
    if missing:
        return (video, i, float(t), *[None] * 9, None)
    s, e = track
    end = s + round(fill * (e - s + 1)) - 1
    return (video, i, float(t), float(y), 3.0, 960.0, 540.0, float(s), float(e), float(s), float(end), (end - s + 1) / (e - s + 1), 0.6)


SEQUENCES = {
    "static": ([(0, 0.5), (5, 0.5), (10, 0.5)], []),
    "moving": ([(0, 0.2), (5, 0.3), (10, 0.4)], [(0.0, 2, 5.0)]),
    "slow": ([(0, 0.2), (5, 0.21), (10, 0.22), (15, 0.23)], [(0.0, 4, 15.0)]),
    "countdown": ([(0, 0.8), (5, 0.7)], [(0.0, 2, 5.0)]),
    "jump": ([(0, 0.1), (5, 0.7), (10, 0.75)], [(5.0, 2, 10.0)]),
    "gap": ([(0, 0.2), (21, 0.3)], []),
    "seek": ([(30, 0.2), (10, 0.3), (15, 0.4)], [(10.0, 2, 15.0)]),
}


def rows_of():
    out = [obs(k, i, t, f) for k, (seq, _) in SEQUENCES.items() for i, (t, f) in enumerate(seq)]
    out += [obs("lost", 0, 0, 0.2), obs("lost", 1, 5, 0, missing=True), obs("lost", 2, 10, 0.3)]
    out += [obs("moved", 0, 0, 0.2), obs("moved", 1, 5, 0.3, y=300)]
    return out


def random_rows():
    rng = random.Random(3)
    out = []
    for v in range(6):
        t = 0.0
        fill = 0.1
        for i in range(80):
            t += rng.choice([1, 5, 5, 5, 25, -3])
            fill = min(0.95, max(0.05, fill + rng.choice([0, 0.01, 0.03, -0.02, 0.6])))
            out.append(obs(f"r{v}", i, t, fill, missing=rng.random() < 0.05))
    return out


def as_stream(spark, df, tmp_path, parts=1, order=None):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    if parts == 1:
        df.coalesce(1).write.parquet(path)
    else:
        size = df.count() // parts + 1
        rows = df.orderBy(*order).collect()
        for i in range(parts):
            spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path, mode="append", seconds=None):
    """Drains a stream; one with timers never runs dry and is stopped after ``seconds``."""
    out = f"{tmp_path}/{uuid.uuid4().hex}"
    if seconds is None:
        jobs.run_to_table(stream, out, mode)
    else:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
        query = writer.foreachBatch(jobs.save_batches(out)).trigger(processingTime="1 second").start()
        query.awaitTermination(seconds)
        query.stop()
    return spark.read.parquet(f"{out}/data")


def test_progress_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(rows_of() + random_rows(), OBS)
    batch = {(r.video_id, r.start_s, r.temporal_observations, r.confirmed_at_s) for r in frames.confirm_progress(df).collect()}
    golden = {(k, *c) for k, (_, found) in SEQUENCES.items() for c in found}
    assert {b for b in batch if not b[0].startswith("r")} == golden
    ev = frames.confirmation_evidence(frames.confirm_progress(df).filter("video_id = 'moving'")).first()
    assert ev.confidence == 0.78 and ev.raw.fill_delta == pytest.approx(0.1, abs=0.002)
    stream = as_stream(spark, df, tmp_path, 3, ["frame_idx", "video_id"])
    got = run(spark, jobs.stream_progress(stream), tmp_path).collect()
    assert {(r.video_id, r.start_s, r.temporal_observations, r.confirmed_at_s) for r in got} == batch
    assert len(batch) > len(golden)


def test_scan_filter(spark):
    times = [0, 0.01, 0.04, 0.06, 5, 5.05, 5.2, 3, 3.02, float("nan"), 9]
    df = spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(times)], "video_id string, frame_idx int, t_s double")
    kept, last = [], None
    for t in times:
        if t != t:
            continue
        if last is None or abs(t - last) > 0.05:
            kept.append(t)
            last = t
    got = [r.t_s for r in frames.scan_filter(df).orderBy("frame_idx").collect()]
    assert got == kept


def scanlines(spark, left, right, dim_to, rows=(40, 41, 42), width=200, height=120):
    data = []
    for y in range(height):
        lum = [20.0] * width
        if y in rows:
            for x in range(left, dim_to):
                lum[x] = 220.0 if x <= right else 100.0
        data.append(("v", 0, 12.0, y, width, height, lum))
    return spark.createDataFrame(data, "video_id string, frame_idx int, t_s double, y int, width int, height int, lum array<double>")


def test_progress_bars_in_frames(spark):
    found = frames.progress_bars(scanlines(spark, 20, 109, 160)).collect()
    assert len(found) == 1
    r = found[0].raw
    assert (r.y, r.start_x, r.end_x, r.rows, r.track_start_x, r.track_end_x) == (40.0, 20.0, 109.0, 3.0, 20.0, 159.0)
    assert found[0].confidence == pytest.approx(0.2 + 90 / 200 * 0.45 + 0.16) and r.fill_ratio == pytest.approx(90 / 140)
    assert frames.progress_bars(scanlines(spark, 20, 109, 110)).count() == 0  # no dim track
    assert frames.progress_bars(scanlines(spark, 20, 60, 160)).count() == 0  # too short
    assert frames.progress_bars(scanlines(spark, 20, 109, 160, rows=(110, 111))).count() == 0  # player controls
    assert frames.bright_runs(scanlines(spark, 20, 109, 160)).count() == 3


def test_admission_batch_and_stream(spark, tmp_path):
    rng = random.Random(9)
    rows, t = [], {c: 0 for c in "abc"}
    for i in range(400):
        c = rng.choice("aaab")
        t[c] += rng.choice([0, 1, 2, 7])
        rows.append((c, i, t[c]))
    df = spark.createDataFrame(rows, "client_key string, request_id bigint, at int").select("client_key", "request_id", F.timestamp_seconds("at").alias("asked_at"))
    key = lambda r: (r.client_key, r.request_id, r.admitted, r.remaining, r.reset_at, r.retry_after_s)
    batch = {key(r) for r in admission.request_admission(df, 3, 10.0).collect()}
    want, gates = set(), {}
    for c, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        n, reset = gates.get(c, (0, -1))
        if reset <= at:
            n, reset = 0, at + 10
        ok = n < 3
        n += ok
        gates[c] = (n, reset)
        left = 3 - n if ok else 0
        want.add((c, i, ok, left, float(reset), max(1, reset - at) if left == 0 else None))
    assert batch == want
    got = run(spark, jobs.request_admission(as_stream(spark, df, tmp_path, 2, ["asked_at", "request_id"]), 3, 10.0), tmp_path)
    assert {key(r) for r in got.collect()} == want


def skip_frames(spark):
    skippable = spark.createDataFrame(
        [("v", 1, 10.0, 60.0, 0.9), ("v", 2, 50.0, 90.0, 0.8), ("v", 3, 100.0, 140.0, 0.9)],
        "video_id string, cand_idx bigint, start_s double, end_s double, confidence double",
    )
    ticks = [
        ("s", 0, 5.0, True), ("s", 1, 12.0, False), ("s", 2, 12.5, True), ("s", 3, 12.6, True), ("s", 4, 70.0, True),
        ("s", 5, 139.0, True), ("s", 6, 120.0, True), ("late", 0, 70.0, True), ("late", 1, 20.0, True),
    ]
    tick = spark.createDataFrame(
        [(s, "v", ts, p, 200.0, play) for s, ts, p, play in ticks],
        "session_id string, video_id string, ts int, pos_s double, duration_s double, is_playing boolean",
    ).withColumn("ts", F.timestamp_seconds("ts"))
    return tick, skippable


def test_skips_batch_and_stream(spark, tmp_path):
    tick, skippable = skip_frames(spark)
    key = lambda r: (r.session_id, r.decision_id, r.from_s, round(r.to_s, 2))
    batch = {key(r) for r in playback.skip_decisions(tick, skippable).collect()}
    assert batch == {
        ("s", "10.0-60.0", 12.5, 60.15), ("s", "100.0-140.0", 120.0, 140.15), ("late", "50.0-90.0", 70.0, 90.15),
    }
    stream = as_stream(spark, tick, tmp_path, 3, ["ts", "session_id"])
    assert {key(r) for r in run(spark, jobs.stream_skips(stream, skippable), tmp_path).collect()} == batch
    undo = spark.createDataFrame([("s", "v", 3), ("s", "v", 4)], "session_id string, video_id string, ts int")
    undo = undo.withColumn("ts", F.timestamp_seconds("ts"))
    back = playback.undo_targets(playback.skip_decisions(tick, skippable), undo).collect()
    assert [(r.decision_id, r.target_s) for r in back] == [("10.0-60.0", 12.5)]


def test_ticks_that_share_an_instant_both_decide(spark, tmp_path):
    ranges = spark.createDataFrame([("v", 10.0, 60.0, 0.9, 1), ("v", 100.0, 160.0, 0.8, 2), ("v", 20.0, 70.0, 0.7, 3)], "video_id string, start_s double, end_s double, confidence double, cand_idx long")
    tick = spark.createDataFrame([("s", "v", 5, 25.0), ("s", "v", 5, 110.0), ("s", "v", 6, 65.0)], "session_id string, video_id string, t int, pos_s double")
    tick = tick.select("session_id", "video_id", F.timestamp_seconds("t").alias("ts"), "pos_s", F.lit(300.0).alias("duration_s"), F.lit(True).alias("is_playing"))
    want = {(10.0, 25.0), (100.0, 110.0)}
    assert {(r.start_s, r.from_s) for r in playback.skip_decisions(tick, ranges).collect()} == want
    streamed = run(spark, jobs.stream_skips(as_stream(spark, tick, tmp_path), ranges), tmp_path).collect()
    assert {(r.start_s, r.from_s) for r in streamed} == want


def test_stale_status_by_event_time(spark, tmp_path):
    rows = [("a", 0, "frames"), ("b", 1, "frames"), ("c", 2, "done"), ("b", 14, "fusion"), ("d", 40, "frames"), ("e", 50, "idle")]
    df = spark.createDataFrame([(v, t, p, 0.5, 1) for v, t, p in rows], "video_id string, t int, phase string, progress double, sample_count int")
    df = df.withColumn("updated_at", F.timestamp_seconds(F.col("t") + 1_000_000))
    source = as_stream(spark, df, tmp_path, 3, ["t"])
    sent = run(spark, jobs.latest_status(source, 15.0, "1 second"), tmp_path, "update").collect()
    # At the end the newest event is at 50, less the delay: b is silent since 14, d only since 40.
    assert {(r.video_id, r.phase) for r in sent if r.stale} == {("a", "frames"), ("b", "fusion")}
    want = {("a", "frames"), ("b", "frames"), ("b", "fusion"), ("c", "done"), ("d", "frames"), ("e", "idle")}
    assert {(r.video_id, r.phase) for r in sent if not r.stale} == want


def test_status_and_activity(spark, tmp_path):
    rows = [("a", 0, "frames", 0.4, 3), ("a", 10, "fusion", 1.7, -2), ("b", 5, "done", 0.9, 4), ("c", 30, "nope", 0.9, 4)]
    df = spark.createDataFrame(rows, "video_id string, t int, phase string, progress double, sample_count int")
    df = df.withColumn("updated_at", F.timestamp_seconds("t"))
    got = {r.video_id: r for r in status.latest_status(df, F.timestamp_seconds(F.lit(26))).collect()}
    assert (got["a"].phase, got["a"].progress, got["a"].sample_count, got["a"].stale) == ("fusion", 1.0, 0, True)
    assert (got["b"].stale, got["c"].phase, got["c"].progress) == (False, "idle", 0.0)
    source = as_stream(spark, df.drop("t"), tmp_path)
    streamed = run(spark, jobs.latest_status(source, 0.1), tmp_path, "update", 15).collect()
    assert {r.video_id for r in streamed if r.stale} == {"a"}
    assert {(r.video_id, r.phase, r.progress) for r in streamed if not r.stale} == {(r.video_id, r.phase, r.progress) for r in got.values()}
    ev = spark.range(60).select(
        F.concat(F.lit("v"), F.col("id") % 2).alias("video_id"), F.col("id").alias("ev_idx"), F.lit("transcript").alias("source"),
        F.lit("ad-read-start").alias("kind"), F.col("id").cast("double").alias("start_s"), F.timestamp_seconds(F.col("id") / 3).alias("seen_at"),
    )
    key = lambda r: (r.video_id, r.position, r.ev_idx)
    batch = {key(r) for r in status.recent_activity(ev).collect()}
    stream = as_stream(spark, ev, tmp_path, 2, ["ev_idx"])
    final = run(spark, jobs.recent_activity(stream), tmp_path, "update")
    last = final.groupBy("video_id").agg(F.max("batch").alias("batch"))
    assert {key(r) for r in final.join(last, ["video_id", "batch"]).collect()} == batch and len(batch) == 32


def test_stream_candidates(spark, tmp_path):
    from fixtures import bar, evidence_df

    rows = [
        {"video_id": "a", "ev_idx": 0, "kind": "ad-read-start", "start_s": 10, "confidence": 0.85},
        {"video_id": "a", "ev_idx": 1, "kind": "ad-read-end", "start_s": 60, "confidence": 0.7},
        {"video_id": "b", "ev_idx": 0, "kind": "ad-read-start", "start_s": 10, "confidence": 0.2},
        {**bar(16, 0.3), "video_id": "a", "ev_idx": 2},
    ]
    evidence = evidence_df(spark, rows)
    path = f"{tmp_path}/out"
    write = jobs.versioned_write(path, ["video_id", "end_s", "confidence", "band"])
    stream = as_stream(spark, evidence, tmp_path, 3, ["video_id", "ev_idx"])
    jobs.run_batches(stream, path, jobs.candidate_updates(lambda: evidence, write))
    got = {r.video_id: (r.end_s, r.confidence, r.band) for r in jobs.newest_versions(spark, path).collect()}
    assert got == {"a": (60.0, 0.98, "display"), "b": (None, 0.15, "reject")}
    assert fusion.candidate_pool(evidence).count() == 2


def test_videos_without_candidates_lose_their_older_rows(spark, tmp_path):
    path = f"{tmp_path}/v"
    write = jobs.versioned_write(path, ["video_id", "x"])
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "video_id string")
    rows = lambda *r: spark.createDataFrame(list(r), "video_id string, x int")
    write(rows(("a", 1), ("b", 1)), ids("a", "b"), 0)
    write(rows(("c", 2)), ids("b", "c"), 1)
    write(rows(("a", 3)), ids("a"), 2)
    assert {(r.video_id, r.x) for r in jobs.newest_versions(spark, path).collect()} == {("a", 3), ("c", 2)}
