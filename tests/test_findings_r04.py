"""Faults named in FINDINGS_r04.md, each by a case that the code before did not pass."""

from __future__ import annotations

import pkgutil
import random
from importlib import import_module

from pyspark.sql import functions as F

import reelmark
from reelmark.functions import tables
from reelmark.operators import playback
from reelmark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_send_no_table_through_the_driver(spark, monkeypatch):
    """Neither in the last step nor in one that is written before; at this size Spark would broadcast all of them."""
    plans = []

    def settle(df, *args, **more):
        plans.append(plan(df))
        return tables.settle(df, *args, **more)

    for m in pkgutil.walk_packages(reelmark.__path__, "reelmark."):
        found = import_module(m.name)
        if found is not tables and getattr(found, "settle", None) is tables.settle:
            monkeypatch.setattr(found, "settle", settle)
    plans.append(plan(QUERIES["select_bands"](spark, SF)))
    joined = [p for p in plans if "Join" in p]
    assert len(plans) > 15 and len(joined) > 8
    assert not any("Broadcast" in p for p in plans)


def test_undo_takes_back_the_latest_decision_unless_it_was_cleared(spark):
    """Against the one slot that a player keeps: set by a decision, emptied by an undo, by switching off and by a reset."""
    rng, moments = random.Random(4), []
    for n in range(400):
        moments.append((f"s{n % 8}", rng.choice("vw"), rng.randrange(60), rng.choice((0, 0, 1, 1, 2)), n))
    rows = {k: [(s, v, t, float(n), f"d{n}", n) for s, v, t, step, n in moments if step == k] for k in range(3)}
    at = F.timestamp_seconds("t").alias("ts")
    frame = lambda k: spark.createDataFrame(rows[k], "session_id string, video_id string, t long, from_s double, decision_id string, cand_idx long")
    decision = frame(0).select("session_id", "video_id", at, "decision_id", "from_s", "cand_idx")
    undo, cleared = (frame(k).select("session_id", "video_id", at) for k in (1, 2))

    def slots(steps):
        slot, want = {}, []
        for s, v, t, step, n in sorted(moments, key=lambda m: m[2:]):
            if step in steps:
                if step == 1 and (s, v) in slot:
                    want.append((s, v, t, *slot[s, v], float(slot[s, v][1][1:])))
                slot.pop((s, v), None)
                if step == 0:
                    slot[s, v] = (t, f"d{n}", float(n), n)
        return sorted(want)

    def found(out):
        seconds = [F.unix_timestamp(c).alias(c) for c in ("ts", "decided_at")]
        return sorted(tuple(r) for r in out.select("session_id", "video_id", *seconds, "decision_id", "from_s", "cand_idx", "target_s").collect())

    assert found(playback.undo_targets(decision, undo, cleared)) == slots({0, 1, 2})
    assert found(playback.undo_targets(decision, undo)) == slots({0, 1}) != slots({0, 1, 2})
