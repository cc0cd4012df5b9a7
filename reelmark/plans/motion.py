"""Queries: frames over time, skip decisions and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import settle, spread
from ..operators import frames, playback
from ..streaming import jobs
from . import derived as d, detect
from .registry import query, rnd
from .streams import as_stream, drained, in_order, new_folder

# ---- scanlines: one small frame per part ------------------------------------------

# Width 40, height 60: runs of at least 14 pixels, tracks of at least 4, groups of 2 to 4 rows.
_BAR_SQL = """select p_partkey as n, 'v' || cast(p_partkey % 97 as string) as video_id, cast(p_partkey as int) as frame_idx,
  p_partkey % 4 + 2 as left_x, p_partkey % 4 + 2 + 11 + p_partkey % 9 as right_x, 30 + p_partkey % 8 as dim_x,
  5 + p_partkey % 50 as top_y, 1 + p_partkey % 6 as n_rows from {part}"""
BARS = f"""bar as ({_BAR_SQL.format(part='part')}),
run_row as (select b.*, unnest(range(top_y, top_y + n_rows)) as y from bar b),
run as (select *, right_x - left_x + 1 as length from run_row where y < 49 and right_x - left_x + 1 >= 14)"""
# A pixel must be much brighter than the darkest neighbour at distance 2, so a tall solid bar only
# shows in the rows (and columns) near its edge.


def scanlines(spark, sf):
    # Dealt by frame before the rows are made, so that the windows over a frame need no shuffle of pixels.
    bar = spread(spark.sql(_BAR_SQL, part=d.table(spark, sf, "part")), *frames.FRAME, rows=4096)
    row = bar.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(59))))
    on = (F.col("y") >= F.col("top_y")) & (F.col("y") < F.col("top_y") + F.col("n_rows"))
    pixel = F.transform(
        F.sequence(F.lit(0), F.lit(39)),
        lambda x: F.when(on & (x >= F.col("left_x")) & (x <= F.col("right_x")), 220.0)
        .when(on & (x > F.col("right_x")) & (x <= F.col("dim_x")), 100.0)
        .otherwise(20.0),
    )
    pixel = F.when(on, pixel).otherwise(F.array_repeat(F.lit(20.0), 40))
    return row.select(
        "video_id", "frame_idx", F.col("n").cast("double").alias("t_s"), "y", F.lit(40).alias("width"), F.lit(60).alias("height"),
        pixel.alias("lum"),
    )


RUNS = f"""{BARS}, kept_run as (select * from run where n_rows <= 4 or y < top_y + 2 or y >= top_y + n_rows - 2)"""


@query("bright_runs", f"with {RUNS} select video_id, frame_idx, cast(y as int) as y, cast(left_x as int) as start_x, cast(right_x as int) as end_x from kept_run")
def _(spark, sf):
    out = frames.bright_runs(scanlines(spark, sf))
    return out.select("video_id", "frame_idx", "y", "start_x", "end_x")


GROUPS = f"""{RUNS}, numbered as (select *, y - row_number() over (partition by frame_idx order by y) as grp from kept_run),
sized as (select *, count(*) over (partition by frame_idx, grp) as rows_in from numbered),
grouped as (select * from sized where rows_in between 2 and 4)"""


@query("run_groups", f"with {GROUPS} select video_id, frame_idx, cast(y as int) as y, rows_in as n_rows from grouped")
def _(spark, sf):
    return frames.run_groups(frames.bright_runs(scanlines(spark, sf))).select("video_id", "frame_idx", "y", "n_rows")


@query(
    "progress_bars",
    f"""with {GROUPS}, g as (select video_id, frame_idx, n, grp, min(y) as y, rows_in, left_x, right_x, dim_x, length from grouped where dim_x - right_x >= 4 group by all),
best as (select * from g qualify row_number() over (partition by frame_idx order by length / 40.0 + rows_in * 0.1 desc, y) = 1)
select video_id, cast(frame_idx as bigint) as ev_idx, cast(y as double) as y, cast(left_x as double) as start_x, cast(right_x as double) as end_x, cast(rows_in as double) as n_rows,
  cast(dim_x as double) as track_end_x, {rnd('(length / cast(dim_x - left_x + 1 as double))', 6)} as fill_ratio,
  {rnd('least(0.75e0, greatest(0.2e0, 0.2e0 + length / 40.0e0 * 0.45e0 + least(0.2e0, (rows_in - 1) * 0.08e0)))', 6)} as confidence from best""",
)
def _(spark, sf):
    from ..functions.numbers import js_round

    out = frames.progress_bars(scanlines(spark, sf))
    return out.select(
        "video_id", "ev_idx", "raw.y", "raw.start_x", "raw.end_x", F.col("raw.rows").alias("n_rows"), "raw.track_end_x",
        js_round(F.col("raw.fill_ratio"), 6).alias("fill_ratio"), js_round(F.col("confidence"), 6).alias("confidence"),
    )


# ---- bars over time -----------------------------------------------------------------

_OBS_SQL = """select 'v' || cast(user_id as string) as video_id, k as frame_idx, k * 5.0e0 + case when event_id % 7 = 0 then 30 else 0 end as t_s,
  case when event_id % 13 <> 0 then case when event_id % 17 = 0 then 480.0e0 else 180.0e0 end end as y, 3.0e0 as rows, 960.0e0 as frame_width,
  540.0e0 as frame_height, 100.0e0 as track_start_x, 799.0e0 as track_end_x, 100.0e0 as start_x, 99.0e0 + f * 7 as end_x, f / 100.0e0 as fill_ratio, 0.6e0 as confidence
from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k,
        case when event_id % 11 = 0 then 90 else event_id % 20 + 5 end as f from {events}) e"""


def bar_observations(spark, sf):
    return spark.sql(_OBS_SQL, events=d.table(spark, sf, "events"))


_SAME = "(s.alive and o.y is not null and o.t_s - s.last_s > 0 and o.t_s - s.last_s <= 20 and abs(s.y / 540 - o.y / 540) <= 0.035 and abs(o.fill_ratio - s.base) <= 0.5)"
TRACKED = f"""obs as ({_OBS_SQL.format(events='events')}),
track as (
  select video_id, cast(0 as bigint) as k, false as alive, 0.0e0 as y, 0.0e0 as base, 0.0e0 as first_s, 0.0e0 as last_s, 0 as n, false as done, false as fired, 0.0e0 as delta
  from (select distinct video_id from obs) v
  union all
  select s.video_id, o.frame_idx, o.y is not null, o.y, case when {_SAME} then s.base else o.fill_ratio end, case when {_SAME} then s.first_s else o.t_s end, o.t_s,
    case when {_SAME} then s.n + 1 else 1 end,
    case when {_SAME} then s.done or abs(o.fill_ratio - s.base) >= 0.025 else false end,
    {_SAME} and not s.done and abs(o.fill_ratio - s.base) >= 0.025, o.fill_ratio - s.base
  from track s join obs o on s.video_id = o.video_id and o.frame_idx = s.k + 1
)"""
_TRACK_OUT = f"with recursive {TRACKED} select video_id, k as frame_idx, first_s as start_s, n as temporal_observations, {rnd('delta', 4)} as fill_delta, last_s as confirmed_at_s from track where fired"


def _confirmed(df):
    from ..functions.numbers import js_round

    return df.select(
        "video_id", "frame_idx", "start_s", "temporal_observations", js_round(F.col("fill_delta"), 4).alias("fill_delta"), "confirmed_at_s"
    )


@query("confirm_progress", _TRACK_OUT)
def _(spark, sf):
    return _confirmed(frames.confirm_progress(bar_observations(spark, sf)))


@query(
    "scan_filter",
    """select 'v' || user_id as video_id, k as frame_idx from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events) e
where k % 2 = 0 or k = 1 or event_id % 3 = 2""",
)
def _(spark, sf):
    seen = spark.sql(
        """select 'v' || cast(user_id as string) as video_id, k as frame_idx, floor(k / 2) * 5.0e0 + case when k % 2 = 1 then 0.03125e0 * (event_id % 3) else 0 end as t_s
        from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from {events}) e""",
        events=d.table(spark, sf, "events"),
    )
    return frames.scan_filter(seen).select("video_id", "frame_idx")


# ---- skips ----------------------------------------------------------------------------

_WALKED = f"""{detect.SKIP}, offer as (
  select t.session_id, t.video_id, t.ts, t.pos_s as from_s, s.cand_idx, s.start_s, s.end_s, least(duration_s, end_s + 0.15e0) as to_s
  from d_tick t join skippable s on t.video_id = s.video_id and t.pos_s >= s.start_s and t.pos_s < s.end_s
  where is_playing and least(duration_s, end_s + 0.15e0) - t.pos_s >= 1.25e0
), first_offer as (
  select * from offer qualify row_number() over (partition by session_id, cand_idx order by ts) = 1
), ordered as (select *, row_number() over (partition by session_id order by ts, start_s, cand_idx) as k from first_offer),
walk as (
  select session_id, cast(0 as bigint) as k, cast([] as double[]) as ss, cast([] as double[]) as es, false as taken from (select distinct session_id from ordered) x
  union all
  select w.session_id, o.k, case when free then list_append(ss, o.start_s) else ss end, case when free then list_append(es, o.end_s) else es end, free
  from walk w join ordered o on w.session_id = o.session_id and o.k = w.k + 1,
    lateral (select len(list_filter(range(1, len(ss) + 1), lambda i: o.start_s < es[i] and o.end_s > ss[i])) = 0 as free) f
), decided as (select o.* from walk w join ordered o on w.session_id = o.session_id and w.k = o.k where taken)"""
_DECIDED = f"{_WALKED} select session_id, video_id, cand_idx, from_s, {rnd('to_s', 6)} as to_s from decided"
_DECIDED_VIEWS = ["d_evidence", "d_tick"]


def _decisions(decided):
    from ..functions.numbers import js_round

    return decided.select("session_id", "video_id", "cand_idx", "from_s", js_round(F.col("to_s"), 6).alias("to_s"))


@query("skip_decisions", _DECIDED, _DECIDED_VIEWS)
def _(spark, sf):
    skippable = settle(detect.skippable(spark, sf))
    return _decisions(playback.skip_decisions(d.ticks(spark, sf), skippable))


@query(
    "undo_targets",
    f"""{_WALKED}, ev as (
  select session_id, video_id, ts, 0 as u, from_s from decided union all
  select session_id, video_id, ts, 1, null from d_tick where not is_playing
), l as (select *, lag(u) over w as pu, lag(from_s) over w as target_s from ev window w as (partition by session_id, video_id order by ts, u, from_s))
select session_id, video_id, ts, target_s from l where u = 1 and pu = 0""",
    _DECIDED_VIEWS,
)
def _(spark, sf):
    skippable = settle(detect.skippable(spark, sf))
    decided = settle(playback.skip_decisions(d.ticks(spark, sf), skippable))
    undo = d.ticks(spark, sf).filter("not is_playing").select("session_id", "video_id", "ts")
    return playback.undo_targets(decided, undo).select("session_id", "video_id", "ts", "target_s")


# ---- streams ----------------------------------------------------------------------------


@query("stream_progress", _TRACK_OUT)
def _(spark, sf):
    return _confirmed(drained(spark, jobs.stream_progress(in_order(spark, bar_observations(spark, sf), "frame_idx"))))


@query("stream_skips", _DECIDED, _DECIDED_VIEWS)
def _(spark, sf):
    skippable = settle(detect.skippable(spark, sf))
    decided = drained(spark, jobs.stream_skips(in_order(spark, d.ticks(spark, sf), "ts"), skippable))
    return _decisions(decided)


@query(
    "stream_candidates",
    f"{detect.FUSED} select video_id, cand_idx, start_s, confidence, case when confidence >= 0.4 then 'display' else 'reject' end as band from cand",
    ["d_evidence"],
)
def _(spark, sf):
    evidence = settle(d.evidence(spark, sf))
    path = new_folder(spark, "candidates")
    write = jobs.versioned_write(path, ["video_id", "cand_idx", "start_s", "confidence", "band"])
    jobs.run_batches(as_stream(spark, evidence, 3), path, jobs.candidate_updates(lambda: evidence, write, features=False))
    return jobs.newest_versions(spark, path)
