"""Progress bars in frames: bright runs, stacked runs, geometry, and confirmation over time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import anchors, ordered
from ..functions.numbers import half_up, is_finite, js_round
from ..functions.pieces import restarted
from ..functions.tables import settle
from ..sources.schemas import PRESENCE, PROGRESS_BAR, raw

# Fixed values (must match for right results).
IGNORE_BOTTOM = 0.18
MIN_WIDTH = 0.35
MIN_CONTRAST = 80.0
MIN_BRIGHT = 160.0
DIM_LOW, DIM_HIGH = 50.0, 155.0
MIN_ROWS = 2
MAX_HEIGHT = 0.06
MIN_TRACK_EXTENSION = 0.08
MATCHING_ROWS = 0.6
EDGE_TOLERANCE_PX = 3
MAX_GAP_S = 20.0
MIN_FILL_DELTA, MAX_FILL_DELTA = 0.025, 0.5
POSITION_TOLERANCE = 0.035
FILL_TOLERANCE = 1e-6
CONFIRMED_CONFIDENCE = 0.78
CONFIRMED_REASON = "Confirmed a changing horizontal progress bar across consecutive video frames."
SAME_POSITION_S = 0.05

FRAME = ["video_id", "frame_idx"]
TIME_BLOCK_S = 600.0
GEOMETRY = ["y", "rows", "frame_width", "frame_height", "track_start_x", "track_end_x", "start_x", "end_x"]


def bright_runs(scanline: DataFrame) -> DataFrame:
    """Maximal horizontal runs of bright pixels that stand out from their neighbours.

    ``scanline``: ``video_id, frame_idx, t_s, y, width, height, lum``. Windows span one frame, whose
    size is bounded by its height. Output: the scanline with ``start_x, end_x, length`` per run. Rows without
    a bright pixel only serve as neighbours: their own pixels are not compared.
    """
    w = Window.partitionBy(*FRAME).orderBy("y")
    # A frame that ends at the current row's side would be read again for each of its rows.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = scanline.withColumn("_up", F.coalesce(F.lag("lum", 2).over(w), F.first("lum").over(whole))).withColumn(
        "_down", F.coalesce(F.lead("lum", 2).over(w), F.last("lum").over(whole))
    )
    kept = near.filter((F.col("y") < F.floor(F.col("height") * (1 - IGNORE_BOTTOM))) & (F.array_max("lum") >= MIN_BRIGHT))
    lum, width = F.col("lum"), F.col("width")

    def bright(v: Column, x: Column) -> Column:
        left = F.element_at(lum, (F.greatest(F.lit(0), x - 2) + 1).cast("int"))
        right = F.element_at(lum, (F.least(width - 1, x + 2) + 1).cast("int"))
        dark = F.least(left, right, F.element_at("_up", x + 1), F.element_at("_down", x + 1))
        return (v >= MIN_BRIGHT) & (v - dark >= MIN_CONTRAST)

    on = F.transform(lum, lambda v, x: bright(v, x))
    flagged = kept.withColumn("_on", on)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_on") - 1),
        lambda x: F.element_at("_on", x + 1) & ((x == 0) | ~F.element_at("_on", F.greatest(x, F.lit(1)))),
    )
    ends = F.filter(
        F.sequence(F.lit(0), F.size("_on") - 1),
        lambda x: F.element_at("_on", x + 1)
        & ((x == F.size("_on") - 1) | ~F.element_at("_on", F.least(x + 2, F.size("_on")))),
    )
    run = flagged.withColumn("r", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e")))).select(
        *scanline.columns, F.col("r.s").alias("start_x"), F.col("r.e").alias("end_x")
    )
    return run.withColumn("length", F.col("end_x") - F.col("start_x") + 1).filter(
        F.col("length") >= F.ceil(width * MIN_WIDTH)
    )


def run_groups(run: DataFrame) -> DataFrame:
    """Adds ``group_no``: runs on consecutive rows with nearly the same ends belong together.

    Only groups of plausible height stay.
    """
    order = Window.partitionBy(*FRAME).orderBy("y", "start_x")
    before = lambda c: F.lag(c).over(order)
    joins = (
        (F.col("y") == before("y") + 1)
        & (F.abs(F.col("start_x") - before("start_x")) <= EDGE_TOLERANCE_PX)
        & (F.abs(F.col("end_x") - before("end_x")) <= EDGE_TOLERANCE_PX)
    )
    opened = run.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    grouped = opened.withColumn("group_no", F.sum("_new").over(order)).drop("_new")
    size = F.count(F.lit(1)).over(Window.partitionBy(*FRAME, "group_no"))
    tallest = F.greatest(F.lit(MIN_ROWS), F.ceil(F.col("height") * MAX_HEIGHT))
    return grouped.withColumn("n_rows", size).filter((F.col("n_rows") >= MIN_ROWS) & (F.col("n_rows") <= tallest))


def _dim_length(pixels: Column) -> Column:
    """Number of leading pixels of track brightness."""
    first_other = F.array_position(
        F.transform(pixels, lambda v: (v >= DIM_LOW) & (v <= DIM_HIGH)), F.lit(False)
    )
    return F.when(first_other == 0, F.size(pixels)).otherwise(first_other - 1).cast("int")


def progress_bars(scanline: DataFrame) -> DataFrame:
    """Best progress-bar-like group per frame as an evidence row."""
    g = run_groups(bright_runs(scanline))
    lum = F.col("lum")
    right = _dim_length(F.slice(lum, F.col("end_x") + 2, F.greatest(F.col("width") - F.col("end_x") - 1, F.lit(0))))
    left = _dim_length(F.reverse(F.slice(lum, F.lit(1), F.col("start_x"))))
    m = g.withColumn("_right", right).withColumn("_left", left)
    matching = F.greatest("_right", "_left") >= F.ceil(F.col("width") * MIN_TRACK_EXTENSION)
    pick = F.struct(
        F.col("y").alias("y"), F.col("start_x").alias("start_x"), F.col("end_x").alias("end_x"), F.col("length").alias("length"),
        (F.col("start_x") - F.col("_left")).alias("track_start_x"), (F.col("end_x") + F.col("_right")).alias("track_end_x"),
    )
    widest = F.struct((-F.col("length")).alias("a"), F.col("y").alias("b"), F.col("start_x").alias("c"))
    per_group = m.groupBy(*FRAME, "t_s", "width", "height", "group_no", "n_rows").agg(
        F.count(F.when(matching, 1)).alias("_matching"),
        F.min_by(pick, F.when(matching, widest)).alias("track"),
        F.min_by(pick, widest).alias("wide"),
    )
    ok = per_group.filter(F.col("_matching") >= F.ceil(F.col("n_rows") * MATCHING_ROWS))
    score = F.col("wide.length") / F.col("width") + F.col("n_rows") * 0.1
    best = ok.groupBy(*FRAME, "t_s", "width", "height").agg(
        F.min_by(F.struct("n_rows", "track", "wide"), F.struct((-score).alias("s"), "group_no")).alias("b")
    )
    share = F.col("b.wide.length") / F.col("width")
    bonus = F.least(F.lit(0.2), F.greatest(F.lit(0), F.col("b.n_rows") - 1) * 0.08)
    confidence = F.least(F.lit(0.75), F.greatest(F.lit(0.2), F.lit(0.2) + share * 0.45 + bonus))
    track = F.col("b.track")
    return best.select(
        "video_id",
        F.col("frame_idx").cast("bigint").alias("ev_idx"),
        F.lit(PROGRESS_BAR).alias("source"),
        F.lit(PRESENCE).alias("kind"),
        F.col("t_s").alias("start_s"),
        F.lit(None).cast("double").alias("end_s"),
        confidence.alias("confidence"),
        F.concat(
            F.lit("Detected horizontal progress-bar-like line across "), half_up(share * 100).cast("string"),
            F.lit("% of frame width."),
        ).alias("reason"),
        raw(
            y=F.col("b.wide.y"), start_x=F.col("b.wide.start_x"), end_x=F.col("b.wide.end_x"), rows=F.col("b.n_rows"),
            frame_width=F.col("width"), frame_height=F.col("height"), track_start_x=track["track_start_x"],
            track_end_x=track["track_end_x"],
            fill_ratio=track["length"] / (track["track_end_x"] - track["track_start_x"] + 1),
        ).alias("raw"),
    )


class Track(NamedTuple):
    """State of one tracked bar."""

    y: float
    frame_width: float
    frame_height: float
    track_start_x: float
    track_end_x: float
    baseline_fill: float
    first_seen_s: float
    last_seen_s: float
    observations: int
    confirmed: bool


def valid_geometry(obs: DataFrame) -> Column:
    """True where the observation carries a consistent bar."""
    track = F.col("track_end_x") - F.col("track_start_x") + 1
    derived = (F.col("end_x") - F.col("start_x") + 1) / F.nullif(track, F.lit(0))
    checks = [is_finite(F.col(c).cast("double")) & (F.col(c) == F.floor(F.col(c))) for c in GEOMETRY]
    checks += [
        F.col("frame_width") > 0,
        F.col("frame_height") > 0,
        (F.col("rows") > 0) & (F.col("rows") <= F.col("frame_height")),
        (F.col("y") >= 0) & (F.col("y") < F.col("frame_height")),
        (F.col("track_start_x") >= 0) & (F.col("track_start_x") <= F.col("track_end_x")),
        F.col("track_end_x") < F.col("frame_width"),
        (F.col("start_x") >= F.col("track_start_x")) & (F.col("start_x") <= F.col("end_x")),
        F.col("end_x") <= F.col("track_end_x"),
        F.col("fill_ratio").between(0, 1),
        F.abs(F.col("fill_ratio") - derived) <= FILL_TOLERANCE,
        is_finite(F.col("t_s")),
    ]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return F.coalesce(ok, F.lit(False))


def track_step(state: Track | None, o) -> tuple[Track | None, dict | None]:
    """Next state and, at most once per track, the confirmation for one valid observation."""
    fresh = Track(
        o.y, o.frame_width, o.frame_height, o.track_start_x, o.track_end_x, o.fill_ratio, o.t_s, o.t_s, 1, False
    )
    if state is None or not 0 < o.t_s - state.last_seen_s <= MAX_GAP_S:
        return fresh, None
    moved = (
        abs(state.y / state.frame_height - o.y / o.frame_height),
        abs(state.track_start_x / state.frame_width - o.track_start_x / o.frame_width),
        abs(state.track_end_x / state.frame_width - o.track_end_x / o.frame_width),
    )
    delta = o.fill_ratio - state.baseline_fill
    if max(moved) > POSITION_TOLERANCE or abs(delta) > MAX_FILL_DELTA:
        return fresh, None
    confirm = not state.confirmed and abs(delta) >= MIN_FILL_DELTA
    after = fresh._replace(
        baseline_fill=state.baseline_fill,
        first_seen_s=state.first_seen_s,
        observations=state.observations + 1,
        confirmed=state.confirmed or confirm,
    )
    if not confirm:
        return after, None
    return after, {
        "start_s": state.first_seen_s,
        "temporal_observations": after.observations,
        "fill_delta": delta,
        "confirmed_at_s": o.t_s,
    }


CONFIRMATION = (
    "video_id string, frame_idx bigint, start_s double, confidence double, temporal_observations int, "
    "fill_delta double, confirmed_at_s double, y double, rows double, frame_width double, frame_height double, "
    "track_start_x double, track_end_x double, start_x double, end_x double, fill_ratio double"
)
_COPIED = ["video_id", "frame_idx", "y", "rows", "frame_width", "frame_height", "track_start_x", "track_end_x", "start_x", "end_x", "fill_ratio"]


def confirmation_row(o, found: dict) -> dict:
    return {
        **{c: getattr(o, c) for c in _COPIED},
        **found,
        "confidence": max(CONFIRMED_CONFIDENCE, o.confidence),
    }


def confirm_progress(bar_obs: DataFrame) -> DataFrame:
    """Confirms bars whose fill changes over time; one row per frame in frame order goes in.

    Frames without a valid bar, gaps, seeks and moved bars all restart the tracking, and they show
    by comparing neighbours. So a video is first cut into episodes there (in parallel blocks). An
    episode restarts where the fill has left the first one by too much; the first frame of such a
    piece whose fill differs enough confirms the bar.
    """
    order, block = ["frame_idx"], F.floor(F.col("frame_idx") / 4096)
    seen = F.struct("t_s", "y", "frame_width", "frame_height", "track_start_x", "track_end_x", "ok")
    obs = bar_obs.withColumn("ok", valid_geometry(bar_obs))
    prior = ordered.scan_before(obs, ["video_id"], order, block, [ordered.Scan("p", "last", seen)])
    p = F.col("p")

    def shift(c: str, dim: str) -> Column:
        return F.abs(p[c] / p[dim] - F.col(c) / F.col(dim)) <= POSITION_TOLERANCE

    gap = F.col("t_s") - p["t_s"]
    goes_on = (
        p["ok"] & F.col("ok") & (gap > 0) & (gap <= MAX_GAP_S)
        & F.when(
            p["ok"] & F.col("ok"),
            shift("y", "frame_height") & shift("track_start_x", "frame_width") & shift("track_end_x", "frame_width"),
        )
    )
    opens = ~F.coalesce(goes_on, F.lit(False))
    cut = ordered.islands(
        prior.withColumn("_opens", opens).drop("p"), ["video_id"], order, block, F.col("_opens"),
        F.col("frame_idx"), "episode",
    )
    plain = [F.col(c).cast("double").alias(c) for c in GEOMETRY]
    frame = settle(
        cut.filter("ok").select(
            "video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), "t_s", "fill_ratio", "confidence", "episode", *plain
        )
    )
    piece = ["video_id", "episode", "start"]
    pieces = settle(restarted(frame, ["video_id", "episode"], "frame_idx", "fill_ratio", MAX_FILL_DELTA))
    moved = pieces.filter(F.abs(F.col("fill_ratio") - F.col("base")) >= MIN_FILL_DELTA)
    first = moved.groupBy(*piece).agg(F.min("frame_idx").alias("at"))
    counted = pieces.join(first.hint("merge"), piece).filter(F.col("frame_idx") <= F.col("at"))
    counted = counted.groupBy(*piece, "at", "base").agg(F.count(F.lit(1)).cast("int").alias("temporal_observations"))
    begin = frame.select("video_id", F.col("frame_idx").alias("start"), F.col("t_s").alias("start_s"))
    found = counted.hint("merge").join(begin, ["video_id", "start"]).withColumnRenamed("at", "frame_idx")
    rows = found.drop("start").hint("merge").join(frame.drop("episode"), ["video_id", "frame_idx"])
    made = {
        "confidence": F.greatest(F.lit(CONFIRMED_CONFIDENCE), "confidence"),
        "fill_delta": F.col("fill_ratio") - F.col("base"),
        "confirmed_at_s": F.col("t_s"),
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in (f.split()[0] for f in CONFIRMATION.split(", "))])


def confirmation_evidence(confirmed: DataFrame) -> DataFrame:
    given = ["y", "rows", "frame_width", "frame_height", "track_start_x", "track_end_x", "start_x", "end_x",
             "fill_ratio", "temporal_observations", "confirmed_at_s"]
    return confirmed.select(
        "video_id",
        F.col("frame_idx").alias("ev_idx"),
        F.lit(PROGRESS_BAR).alias("source"),
        F.lit(PRESENCE).alias("kind"),
        "start_s",
        F.lit(None).cast("double").alias("end_s"),
        "confidence",
        F.lit(CONFIRMED_REASON).alias("reason"),
        raw(fill_delta=js_round(F.col("fill_delta"), 4), **{c: F.col(c) for c in given}).alias("raw"),
    )


def scan_filter(frame_obs: DataFrame) -> DataFrame:
    """Drops frames that repeat the position of the last frame kept.

    A frame is surely kept when it lies more than twice the tolerance from the frame before it, so
    the videos fall into short pieces, and only within a piece the last kept frame must be followed.
    Where positions never go back, kept frames are anchors on a timeline; other pieces restart at each
    kept frame.
    """
    order, block = ["frame_idx"], F.floor(F.col("frame_idx") / 4096)
    finite = frame_obs.filter(is_finite(F.col("t_s")))
    prior = ordered.scan_before(finite, ["video_id"], order, block, [ordered.Scan("_prior", "last", F.col("t_s"))])
    opens = F.col("_prior").isNull() | (F.abs(F.col("t_s") - F.col("_prior")) > 2 * SAME_POSITION_S)
    keys = ["video_id", "_piece"]
    cut = settle(
        ordered.islands(
            prior.withColumn("_opens", opens), ["video_id"], order, block, F.col("_opens"), F.col("frame_idx"), "_piece"
        ).select(*keys, "frame_idx", "t_s", (~F.col("_opens") & (F.col("t_s") < F.col("_prior"))).alias("back"))
    )
    back = cut.filter("back").select(*keys).distinct()
    onward = cut.join(back, keys, "left_anti")
    anchor = anchors.spaced_anchors(onward, keys, "t_s", SAME_POSITION_S).filter("anchor = t_s").select(*keys, "t_s")
    kept = onward.join(anchor, [*keys, "t_s"]).groupBy(*keys, "t_s").agg(F.min("frame_idx").alias("frame_idx"))
    walked = restarted(cut.join(back, keys, "left_semi"), keys, "frame_idx", "t_s", SAME_POSITION_S)
    both = kept.select("video_id", "frame_idx").union(walked.filter("frame_idx = start").select("video_id", "frame_idx"))
    return frame_obs.join(both, ["video_id", "frame_idx"], "left_semi")
