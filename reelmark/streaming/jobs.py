"""Streaming forms of the stateful jobs. Every job takes and returns a streaming DataFrame.

Rows of one key in one micro-batch are put in event order before the state sees them; the size
of a micro-batch is set by the source (files or offsets per trigger).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import settle
from ..operators import frames, fusion, playback, pool_features as pf, scoring
from ..operators.admission import ADMISSION_OUT, Gate, admit
from ..operators.feedback import dedup_key
from ..operators.status import STALE_AFTER_S, normalize_status


class _FirstWriteProcessor(StatefulProcessor):
    """The state of a key says that it has been written; it holds nothing else."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._written = handle.getValueState("written", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.received_at is not None, r.received_at, r.id is not None, r.id))
        if not self._written.exists():
            self._written.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._written.update((True,))

    def close(self) -> None:
        pass


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row by time and id of each key in one part of a micro-batch."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    order = [(c, "ascending") for c in ("dedup_key", "received_at", "id")]
    place = pc.sort_indices(table.select([c for c, _ in order]), sort_keys=order, null_placement="at_start")
    keys = table["dedup_key"].combine_chunks().take(place)
    opens = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
    first = pa.concat_arrays([pa.array([True] * min(1, len(keys))), opens])
    yield from table.take(place.filter(first)).to_batches()


def stream_dedup(feedback: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First write of a key wins for good, on a stream; rows without a key always pass.

    Within a batch the first row by time and id counts; it is picked in Arrow batches before the state sees the keys.
    Keys written before are kept as keyed state without expiry, so a late row is judged like all others and a batch only
    looks up its own keys. ``stored``: a table with the ``dedup_key`` of rows written before the stream first started,
    with which the state begins; later starts with it read the state of the checkpoint instead. Without ``stored`` the
    state is that of Spark's own dedup; with it each key goes through a Python step.
    """
    keyed = dedup_key(feedback)
    one = keyed.filter("dedup_key is not null").repartition("dedup_key").mapInArrow(_first_of_batch, keyed.schema)
    if stored is None:
        first = one.dropDuplicates(["dedup_key"])
    else:
        known = stored.filter("dedup_key is not null").select("dedup_key").distinct().groupBy("dedup_key")
        first = one.groupBy("dedup_key").transformWithState(_FirstWriteProcessor(), keyed.schema, "append", "none", known)
    return first.unionByName(keyed.filter("dedup_key is null"))


class _Ordered(StatefulProcessor):
    """Shared shape: order the rows of the batch, fold them into one state row."""

    state_schema = ""
    order: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        before = self._state.get() if self._state.exists() else None
        after, out = self.fold(key, before, batch)
        if after is not None:
            self._state.update(tuple(after))
        if len(out):
            yield out

    def fold(self, key, state, batch: pd.DataFrame):
        raise NotImplementedError

    def close(self) -> None:
        pass


class _ProgressProcessor(_Ordered):
    state_schema = (
        "y double, frame_width double, frame_height double, track_start_x double, track_end_x double, "
        "baseline_fill double, first_seen_s double, last_seen_s double, observations int, confirmed boolean, "
        "tracking boolean"
    )
    order = ["frame_idx"]

    def fold(self, key, state, batch):
        track = None
        if state is not None and state[-1]:
            track = frames.Track(*state[:-1])
        out = []
        for o in batch.itertuples(index=False):
            if not o.ok:
                track = None
                continue
            track, found = frames.track_step(track, o)
            if found:
                out.append(frames.confirmation_row(o, found))
        rows = pd.DataFrame(out, columns=[c.split()[0] for c in frames.CONFIRMATION.split(", ")])
        kept = track or frames.Track(0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, False)
        plain = [float(v) for v in kept[:8]] + [int(kept.observations), bool(kept.confirmed)]
        return (*plain, track is not None), rows


def stream_progress(bar_obs: DataFrame) -> DataFrame:
    """Confirmed progress bars of a stream of per-frame observations."""
    obs = bar_obs.withColumn("ok", frames.valid_geometry(bar_obs))
    plain = [F.col(c).cast("double").alias(c) for c in frames.GEOMETRY]
    obs = obs.select(
        "video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), "t_s", "fill_ratio", "confidence", "ok", *plain
    )
    return obs.groupBy("video_id").transformWithStateInPandas(
        _ProgressProcessor(), frames.CONFIRMATION, "append", "none"
    )


class _AdmissionProcessor(_Ordered):
    state_schema = "count int, reset_at double"
    order = ["at_s", "request_id"]

    def __init__(self, limit: int, window_s: float) -> None:
        self._limit, self._window = limit, window_s

    def fold(self, key, state, batch):
        gate = Gate(*state) if state is not None else None
        gate, rows = admit(gate, batch, self._limit, self._window)
        return (int(gate.count), float(gate.reset_at)), rows


def request_admission(request: DataFrame, limit: int = 60, window_s: float = 60.0) -> DataFrame:
    """Admission decisions for a stream of ``client_key, request_id, asked_at``."""
    timed = request.select("client_key", "request_id", F.col("asked_at").cast("timestamp").cast("double").alias("at_s"))
    return timed.groupBy("client_key").transformWithStateInPandas(
        _AdmissionProcessor(limit, window_s), ADMISSION_OUT, "append", "none"
    )


class _SkipProcessor(StatefulProcessor):
    """Ranges already handled in a session; ranges are few, bounded by a video's candidates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handled = handle.getListState("handled", "start_s double, end_s double")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "start_s", "cand_idx", "from_s"], kind="stable")
        handled = [tuple(h) for h in self._handled.get()] if self._handled.exists() else []
        taken = []
        for i, r in zip(batch.index, batch.itertuples(index=False)):
            # Ranges offered at one tick overlap each other, so a tick decides once at most.
            if any(r.start_s < e and r.end_s > s for s, e in handled):
                continue
            handled.append((float(r.start_s), float(r.end_s)))
            taken.append(i)
        if taken:
            self._handled.put(handled)
            yield playback.with_decision_id(batch.loc[taken])

    def close(self) -> None:
        pass


def stream_skips(tick: DataFrame, skippable: DataFrame) -> DataFrame:
    """Skip decisions of a tick stream joined with a static table of skippable ranges."""
    offered = playback.offers(tick, skippable).select(
        "session_id", "video_id", "ts", *playback.RANGE_COLUMNS, "from_s", "to_s", "skipped_s"
    )
    return offered.groupBy("session_id", "video_id").transformWithStateInPandas(
        _SkipProcessor(), playback.DECISION, "append", "none"
    )


def _epoch_ms(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).tz_localize("UTC").value // 1_000_000)


class _StatusProcessor(StatefulProcessor):
    """Last status per video, and a stale mark when a running scan falls silent."""

    def __init__(self, stale_after_s: float | None, event_time: bool) -> None:
        self._after_ms = None if stale_after_s is None else int(stale_after_s * 1000)
        self._event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState(
            "last", "updated_at timestamp, phase string, progress double, sample_count bigint, running boolean"
        )

    def handleInputRows(self, key, rows, timerValues):
        newest = pd.concat(list(rows), ignore_index=True).sort_values("updated_at", kind="stable").iloc[-1]
        if self._state.exists() and pd.Timestamp(self._state.get()[0]) > newest.updated_at:
            return
        row = (
            newest.updated_at.to_pydatetime(), newest.phase, float(newest.progress), int(newest.sample_count),
            bool(newest.running),
        )
        self._state.update(row)
        for t in self._handle.listTimers() if self._after_ms is not None else ():
            self._handle.deleteTimer(t)
        if newest.running and self._after_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs() if not self._event_time else _epoch_ms(newest.updated_at)
            self._handle.registerTimer(now + self._after_ms + 1)
        yield self._row(key, row, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._state.exists() and self._state.get()[4]:
            yield self._row(key, tuple(self._state.get()), True)

    def _row(self, key, row, stale: bool) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], *row[:4], stale)], columns=["video_id", "updated_at", "phase", "progress", "sample_count", "stale"]
        )

    def close(self) -> None:
        pass


STATUS_OUT = "video_id string, updated_at timestamp, phase string, progress double, sample_count bigint, stale boolean"


def latest_status(status: DataFrame, stale_after_s: float | None = STALE_AFTER_S, delay: str | None = None) -> DataFrame:
    """Newest status per video, sent whenever it changes, and again as stale after a silence.

    With ``delay``, silence is measured in the time of the events: a scan is stale once a status of any video is
    ``stale_after_s`` and the delay later, and older rows than that delay are left out. A replay then gives the same rows.
    Without it the clock decides, for sources that may stop altogether. With ``stale_after_s`` of ``None`` nothing
    becomes stale.
    """
    rows = normalize_status(status)
    mode = "none" if stale_after_s is None else "ProcessingTime"
    if delay is not None and stale_after_s is not None:
        rows, mode = rows.withWatermark("updated_at", delay), "EventTime"
    return rows.groupBy("video_id").transformWithStateInPandas(
        _StatusProcessor(stale_after_s, mode == "EventTime"), STATUS_OUT, "update", mode
    )


ACTIVITY_OUT = "video_id string, position int, ev_idx bigint, source string, kind string, start_s double, seen_at timestamp"


class _ActivityProcessor(StatefulProcessor):
    def __init__(self, k: int) -> None:
        self._k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getListState(
            "recent", "ev_idx bigint, source string, kind string, start_s double, seen_at timestamp"
        )

    def handleInputRows(self, key, rows, timerValues):
        cols = ["ev_idx", "source", "kind", "start_s", "seen_at"]
        order = {"by": ["seen_at", "ev_idx"], "ascending": [False, True], "kind": "stable"}
        best = pd.DataFrame([tuple(r) for r in self._recent.get()] if self._recent.exists() else [], columns=cols)
        for part in rows:
            both = pd.concat([best, part[cols]], ignore_index=True) if len(best) else part[cols]
            best = both.sort_values(**order).head(self._k)
        self._recent.put(
            [(int(r.ev_idx), r.source, r.kind, float(r.start_s), pd.Timestamp(r.seen_at).to_pydatetime()) for r in best.itertuples()]
        )
        out = best.assign(video_id=key[0], position=range(1, len(best) + 1))
        yield out[["video_id", "position", *cols]]

    def close(self) -> None:
        pass


def recent_activity(evidence: DataFrame, k: int = 16) -> DataFrame:
    """Newest rows per video, sent again whenever they change. Needs a ``seen_at`` column."""
    return evidence.groupBy("video_id").transformWithStateInPandas(_ActivityProcessor(k), ACTIVITY_OUT, "update", "none")


def candidate_updates(
    read_evidence: Callable[[], DataFrame],
    write: Callable[[DataFrame, DataFrame, int], None],
    model: scoring.Model | None = None,
    nfkc: bool = True,
    features: bool = True,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: recomputes candidates and bands of the videos touched by a batch.

    ``read_evidence`` returns the evidence table that already holds the batch; ``write`` gets the new rows
    and the touched videos, whose older rows they replace. The batch only selects videos, so repeats do no harm.
    Without a model no score rests on the features: pass ``features=False`` if ``write`` keeps none of them.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        touched = settle(batch.select("video_id").distinct())
        evidence = settle(read_evidence().join(touched, "video_id", "left_semi"))
        write(scored_candidates(evidence, model, nfkc, features), touched, batch_id)

    return update


def versioned_write(path: str, columns: list[str]) -> Callable[[DataFrame, DataFrame, int], None]:
    """Adds a version of the touched videos: their rows, and that they were touched. Nothing is rewritten."""

    def write(rows: DataFrame, touched: DataFrame, batch_id: int) -> None:
        rows.select(*columns).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{path}/touched/batch={batch_id}")

    return write


def newest_versions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each video from the last batch that touched it; none if that batch left it without any."""
    last = spark.read.parquet(f"{path}/touched").groupBy("video_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/data").join(last, ["video_id", "batch"]).drop("batch")


def scored_candidates(evidence: DataFrame, model: scoring.Model | None, nfkc: bool = True, features: bool = True) -> DataFrame:
    items = settle(fusion.coalesce_frames(evidence))
    parts = fusion.pool_parts(items)
    pool = settle(fusion.candidate_pool(items, True, parts))
    vector = pf.pool_features(items, pool, nfkc=nfkc, parts=parts) if features or model else pool.select(*fusion.CAND)
    applied = scoring.apply_model(pool, vector, model)
    moved = scoring.apply_boundary_offsets(applied, fusion.boundary_members(items, parts.chains), model)
    return scoring.select_bands(moved, model)


def run_batches(stream: DataFrame, path: str, update: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream through a ``foreachBatch`` body until all that is available is processed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(update)
    writer.trigger(availableNow=True).start().awaitTermination()


def save_batches(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that puts each batch into its own folder of ``path``/data."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    return save


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream into ``path``/data until all that is available is processed."""
    run_batches(stream, path, save_batches(path), mode)
