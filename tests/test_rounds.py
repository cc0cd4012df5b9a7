"""Results found in rounds of joins against plain walks: anchors, matching, promotion logs."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reelmark.functions.pieces import restarted
from reelmark.operators import evaluation, frames, fusion, registry


def walked(times, gap, inclusive):
    out, anchor = {}, None
    for t in sorted(set(times)):
        if anchor is None or (t - anchor >= gap if inclusive else t - anchor > gap):
            anchor = t
        out[t] = anchor
    return out


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("gap", [6.0, 0.3])
def test_anchors_are_those_of_a_walk(spark, gap, inclusive):
    rng = random.Random(int(gap * 10) + inclusive)
    rows = []
    for k, step in enumerate([0.05, 0.3, 1.0, 3.0, 6.0, 5.999999, 40.0, 0.02, 2.0, 0.1]):
        t = [-20.0, 0.0, 7.5][k % 3]
        for _ in range(150):
            rows.append((f"k{k}", t))
            t += rng.choice([step, step, step * rng.random(), 0.0])
    rows += [("grid", i * gap) for i in range(300)] + [("one", 5.0), ("two", 5.0), ("two", 5.0)]
    got = {(r.k, r.start_s): r.anchor_s for r in fusion.cluster_anchors(spark.createDataFrame(rows, "k string, start_s double"), ["k"], gap, inclusive).collect()}
    want = {(k, t): a for k in {r[0] for r in rows} for t, a in walked([x for y, x in rows if y == k], gap, inclusive).items()}
    assert got == want


def test_anchors_of_one_long_key(spark):
    """A quarter of a million instants of one key, dense and sparse, without a gap that cuts them."""
    rng = random.Random(3)
    times, t = [], 0.0
    for i in range(250_000):
        t += rng.random() * (0.001 if i % 50_000 < 40_000 else 4.0)
        times.append(t)
    df = spark.createDataFrame([("k", x) for x in times], "k string, start_s double").repartition(8)
    got = fusion.cluster_anchors(df, ["k"]).select("anchor_s").distinct().collect()
    assert {r[0] for r in got} == set(walked(times, 6.0, False).values())


def greedy(pairs):
    used_e, used_d, out = set(), set(), set()
    for p in sorted(pairs, key=lambda p: (-p[4], p[5], float("inf") if p[6] is None else p[6], p[1], p[3], p[2])):
        if (p[0], p[1]) not in used_e and (p[0], p[2]) not in used_d:
            used_e.add((p[0], p[1]))
            used_d.add((p[0], p[2]))
            out.add(p[:3])
    return out


PAIR = "case_id string, exp_idx int, cand_idx long, det_s double, score double, start_error double, end_error double, iou double"


def test_matching_in_rounds_is_the_greedy_one(spark):
    rng = random.Random(8)
    pairs = set()
    for case in range(6):
        for _ in range(200):
            score = rng.choice([0.3, 0.5, 0.5, 0.9, rng.random()])
            pairs.add((f"c{case}", rng.randrange(25), rng.randrange(30), float(rng.randrange(4)), score, float(rng.randrange(2)), rng.choice([None, 1.0]), score))
    # A chain in which each pair is beaten by the one before it, and ties that only the indices settle.
    pairs |= {("chain", i // 2, (i + 1) // 2, 0.0, 1.0 - i / 100, 0.0, 0.0, 0.5) for i in range(41)}
    pairs |= {("tie", e, c, 0.0, 0.5, 0.0, None, 0.0) for e in range(7) for c in range(7)}
    seen = {}
    for p in pairs:
        seen.setdefault(p[:3], p)
    rows = list(seen.values())
    got = evaluation.match_segments(spark.createDataFrame(rows, PAIR)).collect()
    assert {(r.case_id, r.exp_idx, r.cand_idx) for r in got} == greedy(rows) and len(got) == len(greedy(rows))
    assert evaluation.match_segments(spark.createDataFrame([], PAIR)).count() == 0


def test_one_piece_of_very_many_pairs(spark):
    """300,000 pairs that all compete in one case."""
    n = 550
    df = spark.range(n * n).select(
        F.lit("c").alias("case_id"), (F.col("id") % n).cast("int").alias("exp_idx"), F.floor(F.col("id") / n).alias("cand_idx"), F.lit(0.0).alias("det_s"),
        (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("score"), F.lit(0.0).alias("start_error"),
        F.lit(None).cast("double").alias("end_error"), F.lit(0.0).alias("iou"),
    )
    rows = [tuple(r) for r in df.collect()]
    got = {tuple(r)[:3] for r in evaluation.match_segments(df).collect()}
    assert got == greedy(rows) and len(got) == n


def replayed(log):
    before, newest, active, out = {}, None, None, []
    for action, model in log:
        ok = action == "promote" or (active is not None and active == model)
        if action == "promote":
            before[model] = newest
            newest = active = model
        elif ok:
            active = before[model]
        out.append((ok, active))
    return out


LOG = "registry string, id string, model_id string, promoted_at timestamp, action string"


def log_rows(name, log, start=datetime.datetime(2026, 7, 1)):
    """Every third action shares its instant with the one before, so ids decide."""
    return [(name, f"e{i:06d}", m, start + datetime.timedelta(minutes=i - (i % 3 == 2)), a) for i, (a, m) in enumerate(log)]


def test_promotion_logs_are_those_of_a_replay(spark):
    rng = random.Random(4)
    logs = {}
    for k in range(30):
        models = "abcd"[: rng.randint(1, 4)]
        logs[f"r{k}"] = [("promote" if rng.random() < rng.choice([0.2, 0.5]) else "rollback", rng.choice(models)) for _ in range(rng.randint(1, 60))]
    logs["loop"] = [("promote", "a"), ("promote", "a")] + [("rollback", "a")] * 9
    logs["deep"] = [("promote", f"m{i}") for i in range(40)] + [("rollback", f"m{i}") for i in reversed(range(40))]
    rows = [r for name, log in logs.items() for r in log_rows(name, log)]
    got = registry.replay_promotions(spark.createDataFrame(rows, LOG)).orderBy("registry", "id").collect()
    by = {}
    for r in got:
        by.setdefault(r.registry, []).append((r.accepted, r.active_model_id))
    assert by == {name: replayed(log) for name, log in logs.items()}
    assert registry.replay_promotions(spark.createDataFrame([], LOG)).count() == 0


def test_one_long_promotion_log(spark):
    rng = random.Random(6)
    log = [(rng.choice(["promote", "rollback", "rollback"]), f"m{rng.randrange(5)}") for _ in range(40_000)]
    got = registry.replay_promotions(spark.createDataFrame(log_rows("r", log), LOG)).orderBy("id").collect()
    assert [(r.accepted, r.active_model_id) for r in got] == replayed(log)


def kept_frames(rows):
    out, last = set(), {}
    for v, i, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if t is not None and (v not in last or abs(t - last[v]) > frames.SAME_POSITION_S):
            out.add((v, i))
            last[v] = t
    return out


def test_kept_frames_are_those_of_a_walk(spark):
    rng = random.Random(5)
    rows = []
    for v, steps in enumerate([[0.0], [0.02], [0.02, 0.07], [0.04, -0.04], [0.0, 0.03, -0.08], [5.0, -3.0, 0.01], [0.05], [0.025, 0.0]]):
        t = 0.0
        for i in range(120):
            rows.append((f"v{v}", i, None if rng.random() < 0.02 else t))
            t += rng.choice([*steps, steps[0] * rng.random()])
    got = frames.scan_filter(spark.createDataFrame(rows, "video_id string, frame_idx int, t_s double")).collect()
    assert {(r.video_id, r.frame_idx) for r in got} == kept_frames(rows) and len(got) == len(kept_frames(rows))


def test_pieces_restart_where_a_value_has_left_its_base(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice([0.1, 0.3, 0.5, 0.7, 0.9])) for k in "abc" for i in range(rng.randint(1, 40))]
    want = set()
    for k in "abc":
        start = base = None
        for _, i, x in [r for r in rows if r[0] == k]:
            if base is None or abs(x - base) > 0.5:
                start, base = i, x
            want.add((k, i, start, base))
    got = restarted(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], "i", "x", 0.5)
    assert {(r.k, r.i, r.start, r.base) for r in got.collect()} == want
    assert restarted(spark.createDataFrame([], "k string, i int, x double"), ["k"], "i", "x", 0.5).count() == 0
