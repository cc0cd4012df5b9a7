"""Skip decisions over playback positions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import intervals
from ..functions.walk import ordered_walk

# Fixed values (must match for right results).
MIN_SAVED_S = 1.25
EXIT_PADDING_S = 0.15

CELL_S = 60.0
DECISION = (
    "session_id string, video_id string, ts timestamp, decision_id string, start_s double, end_s double, "
    "confidence double, from_s double, to_s double, skipped_s double, cand_idx bigint"
)
RANGE_COLUMNS = ["start_s", "end_s", "confidence", "cand_idx"]


def offers(tick: DataFrame, skippable: DataFrame) -> DataFrame:
    """Playing ticks inside a skippable range that would save enough time: one row per tick and range."""
    live = tick.filter(
        F.col("is_playing") & F.col("pos_s").isNotNull() & ~F.isnan("pos_s") & (F.abs("pos_s") < float("inf"))
    ).withColumn("from_s", F.greatest(F.lit(0.0), F.col("pos_s")))
    ranges = skippable.select("video_id", *RANGE_COLUMNS)
    inside = intervals.overlap_join(
        live, ranges, ["video_id"], (F.col("from_s"), F.col("from_s")), (F.col("start_s"), F.col("end_s")), CELL_S
    ).filter(F.col("from_s") < F.col("end_s"))
    target = F.col("end_s") + EXIT_PADDING_S
    limit = F.when(F.col("duration_s").isNotNull(), F.greatest(F.lit(0.0), F.col("duration_s")))
    out = inside.withColumn("to_s", F.least(limit, target)).withColumn("skipped_s", F.col("to_s") - F.col("from_s"))
    return out.filter(F.col("skipped_s") >= MIN_SAVED_S)


def skip_decisions(tick: DataFrame, skippable: DataFrame) -> DataFrame:
    """Skips per session, in time order, never into a range that overlaps a handled one.

    Ranges offered at the same tick overlap each other, so a range that loses its first offer
    is handled for good. Only the first offer of each session and range can decide; taking it
    before the shuffle leaves at most one row per session and range for the ordered pass. Of several positions at
    the instant of a first offer the earliest counts; of candidates with one range the first.
    """
    detail = F.struct("from_s", "to_s", "skipped_s")
    first = (
        offers(tick, skippable)
        .groupBy("session_id", "video_id", *RANGE_COLUMNS)
        .agg(F.min("ts").alias("ts"), F.min_by(detail, F.struct("ts", "from_s")).alias("_row"))
        .select("session_id", "video_id", *RANGE_COLUMNS, "ts", "_row.*")
    )
    keys = ["session_id", "video_id"]
    return ordered_walk(first, keys, ["ts", "start_s", "cand_idx"], _decide, DECISION)


def _decide():
    handled: list[tuple[float, float]] = []

    def step(r):
        # Ranges offered at one tick overlap each other, so a tick decides once at most, also where ticks share an instant.
        if any(r.start_s < e and r.end_s > s for s, e in handled):
            return None
        handled.append((r.start_s, r.end_s))
        name = decision_id(r.start_s, r.end_s)
        return (
            r.session_id, r.video_id, r.ts, name, r.start_s, r.end_s, r.confidence, r.from_s, r.to_s, r.skipped_s,
            r.cand_idx,
        )

    return step


def decision_id(start_s: float, end_s: float) -> str:
    return f"{start_s:.1f}-{end_s:.1f}"


def with_decision_id(rows: pd.DataFrame) -> pd.DataFrame:
    ids = [decision_id(s, e) for s, e in zip(rows["start_s"], rows["end_s"])]
    names = [c.split()[0] for c in DECISION.split(", ")]
    return rows.assign(decision_id=ids)[names]


def undo_targets(decision: DataFrame, undo: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Which decision each undo takes back, and where the player returns to: one row per undo that finds one.

    ``undo`` and ``cleared``: ``session_id, video_id, ts``. Only the latest decision can be taken back, once, and not after a
    clearing (skipping switched off, the notice closed, the session reset); no undo reaches further back. A row has the
    decision's columns with its time as ``decided_at``, ``ts`` of the undo and ``target_s``, where the skip started from.
    The range stays handled. At one instant decisions come first, then undos, then clearings.
    """
    keys = ["session_id", "video_id"]
    body = F.struct(F.col("ts").alias("decided_at"), *[c for c in decision.columns if c not in (*keys, "ts")])
    both = decision.select(*keys, "ts", F.lit(0).alias("step"), body.alias("decision"))
    for step, at in ((1, undo), (2, cleared)):
        if at is not None:
            both = both.unionByName(at.select(*keys, "ts", F.lit(step).alias("step")), allowMissingColumns=True)
    # A decision counts for the undo right after it: one that follows another undo or a clearing finds nothing left.
    order = Window.partitionBy(*keys).orderBy("ts", "step", "decision.from_s")
    before = F.lag(F.struct("step", "decision")).over(order)
    found = both.withColumn("_before", before).filter("step = 1 and _before.step = 0")
    return found.select(*keys, "ts", "_before.decision.*", F.col("_before.decision.from_s").alias("target_s"))
