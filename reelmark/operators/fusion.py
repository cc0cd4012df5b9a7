"""Evidence to candidate segments.

Two tables come out: ``candidate`` (one row per segment, scalars only) and ``member`` (one
row per candidate and evidence row). Lists are never gathered into one cell, so a video or
a moment with very many evidence rows only makes more rows. Rows of a pool are joined by merge: Spark goes by the
bytes of written files, which hold many short rows, and would broadcast them through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import anchors, intervals, ordered
from ..functions.around import around
from ..functions.tables import settle
from ..functions.numbers import half_up, is_finite, js_round, plain_text
from ..sources.schemas import END, EVIDENCE_COLUMNS, PRESENCE, PROGRESS_BAR, QR_CODE, SOURCES, START, TRANSCRIPT, VISIBLE_LINK

# Fixed values (must match for right results).
DISPLAY_THRESHOLD = 0.4
PRESENCE_WINDOW_S = 20.0
COALESCE_WINDOW_S = 6.0
MAX_SEGMENT_S = 240.0
DEFAULT_DURATION_S = 120.0
CONFIDENT = 0.8
SCORE_CAP = 0.98
WEIGHTS = {PROGRESS_BAR: 0.5, QR_CODE: 0.5, VISIBLE_LINK: 0.65}
TRANSCRIPT_WEIGHTS = {START: 0.75, END: 0.2, PRESENCE: 0.45}

CHUNK_S = 600.0
CAND = ["video_id", "cand_idx"]


def is_frame(source: Column) -> Column:
    return source.isin(PROGRESS_BAR, QR_CODE, VISIBLE_LINK)


def _tag(value: Column) -> Column:
    """Trimmed lower-case text, NULL when blank."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def _near(value: Column, step: int) -> Column:
    whole = half_up(value / step) * step
    return F.when(is_finite(value), plain_text(whole.cast("double"))).otherwise(F.lit("-"))


def fingerprint(source: Column, raw: Column) -> Column:
    """What makes two frame observations the same thing on screen."""
    bar = F.concat_ws(
        ":",
        F.lit("progress"),
        _near(raw["frame_width"], 1),
        _near(raw["frame_height"], 1),
        _near(raw["track_start_x"], 4),
        _near(raw["track_end_x"], 4),
        _near(raw["y"], 4),
        _near(raw["rows"], 1),
        _near(raw["fill_ratio"], 1),
    )
    return (
        F.when(source == QR_CODE, F.concat(F.lit("qr:"), F.coalesce(_tag(raw["value"]), F.lit("detected"))))
        .when(source == PROGRESS_BAR, F.when(raw.isNull(), F.lit("progress")).otherwise(bar))
        .when(source == VISIBLE_LINK, F.concat(F.lit("link:"), F.coalesce(*[_tag(raw[n]) for n in ("text", "href", "url")], F.lit("visible"))))
        .otherwise(source)
    )


def cluster_anchors(
    positions: DataFrame, keys: list[str], gap: float = COALESCE_WINDOW_S, inclusive: bool = False
) -> DataFrame:
    """Fixed-anchor clusters over distinct positions: ``keys, start_s, anchor_s``.

    A cluster starts at the first position more than ``gap`` after the previous anchor (or at least ``gap``, if
    ``inclusive``), so anchors depend on each other along the timeline; see ``functions/anchors.py``.
    """
    return anchors.spaced_anchors(positions, keys, "start_s", gap, inclusive).withColumnRenamed("anchor", "anchor_s")


def coalesce_frames(evidence: DataFrame) -> DataFrame:
    """Merges repeated frame observations; caption rows pass through unchanged.

    Rows at one position are reduced before anything is shuffled, so the later steps grow
    with the length of the videos and not with the number of repeated observations.
    """
    keys = ["video_id", "kind", "source", "fp"]
    frame = evidence.filter(is_frame(F.col("source"))).withColumn("fp", fingerprint(F.col("source"), F.col("raw")))
    body = F.struct("end_s", "confidence", "reason", "raw")
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("start_s").alias("s"), F.col("ev_idx").alias("i"))
    at_position = settle(
        frame.groupBy(*keys, "start_s").agg(
            F.min_by(body, rank).alias("best"), F.min(rank).alias("rank"), F.min("ev_idx").alias("ev_idx")
        )
    )
    clusters = cluster_anchors(at_position.select(*keys, "start_s"), keys)
    merged = (
        at_position.join(clusters.hint("merge"), [*keys, "start_s"])
        .groupBy(*keys, "anchor_s")
        .agg(
            F.min_by("best", "rank").alias("best"),
            F.min_by("ev_idx", F.struct("start_s", "ev_idx")).alias("ev_idx"),
        )
        .select("video_id", "ev_idx", "source", "kind", F.col("anchor_s").alias("start_s"), "best.*")
    )
    passed = evidence.filter(~is_frame(F.col("source")))
    return passed.select(*EVIDENCE_COLUMNS).unionByName(merged.select(*EVIDENCE_COLUMNS))


def seeded_videos(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.col("kind") == START).select("video_id").distinct()


def seed_mode(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of videos with a start cue, and evidence of videos without one."""
    seeded = seeded_videos(evidence).hint("merge")
    return (
        evidence.join(seeded, "video_id", "left_semi"),
        evidence.join(seeded, "video_id", "left_anti"),
    )


def seeds_of(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.col("kind") == START)


def seed_presence(evidence: DataFrame) -> DataFrame:
    """Presence rows within twenty seconds of a seed: one row per seed and presence row."""
    seeds = seeds_of(evidence).select("video_id", F.col("ev_idx").alias("cand_idx"), F.col("start_s").alias("seed_s"))
    cells = F.explode(
        F.sequence(F.floor(F.col("seed_s") / PRESENCE_WINDOW_S) - 1, F.floor(F.col("seed_s") / PRESENCE_WINDOW_S) + 1)
    )
    presence = evidence.filter(F.col("kind") == PRESENCE).withColumn(
        "_cell", F.floor(F.col("start_s") / PRESENCE_WINDOW_S)
    )
    return (
        seeds.withColumn("_cell", cells)
        .join(presence, ["video_id", "_cell"])
        .filter(F.abs(F.col("start_s") - F.col("seed_s")) <= PRESENCE_WINDOW_S)
        .drop("_cell")
    )


def seed_end(evidence: DataFrame) -> DataFrame:
    """First end cue after each seed, strictly later and at most four minutes away.

    One row per distinct seed position: ``video_id, seed_s, end_at`` and the end's evidence row.
    """
    ends = evidence.filter(F.col("kind") == END)
    reach = intervals.next_after(seeds_of(evidence), ends, ["video_id"], "start_s", MAX_SEGMENT_S, "end_at")
    first = ends.groupBy("video_id", "start_s").agg(F.min_by(F.struct(*EVIDENCE_COLUMNS), "ev_idx").alias("end_row"))
    return (
        reach.filter("end_at is not null")
        .withColumnRenamed("start_s", "seed_s")
        .join(first.withColumnRenamed("start_s", "end_at").hint("merge"), ["video_id", "end_at"])
    )


def presence_chains(evidence: DataFrame) -> DataFrame:
    """Distinct presence positions with the start of their chain (gaps of at most twenty seconds).

    Found block by block, so a video with very many positions is spread over tasks.
    """
    spots = evidence.filter(F.col("kind") == PRESENCE).select("video_id", "start_s").distinct()
    block = F.floor(F.col("start_s") / CHUNK_S)
    prior = ordered.scan_before(
        spots, ["video_id"], ["start_s"], block, [ordered.Scan("prior_s", "last", F.col("start_s"))]
    )
    opens = F.col("prior_s").isNull() | (F.col("start_s") - F.col("prior_s") > PRESENCE_WINDOW_S)
    chained = ordered.islands(prior, ["video_id"], ["start_s"], block, opens, F.col("start_s"), "cluster_s")
    return chained.select("video_id", "start_s", "cluster_s")


def presence_clusters(evidence: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Presence rows with the start of their chain; rows of videos outside ``chains`` drop out."""
    presence = evidence.filter(F.col("kind") == PRESENCE)
    chains = presence_chains(evidence) if chains is None else chains
    return presence.join(chains.hint("merge"), ["video_id", "start_s"])


def _is_sponsor_frame() -> Column:
    signal = F.coalesce(_tag(F.col("raw.signal")), F.lit(""))
    return F.col("source").isin(QR_CODE, VISIBLE_LINK) & (signal == "sponsor-cta")


def _channel() -> Column:
    spoken = (F.col("source") == VISIBLE_LINK) & (F.coalesce(_tag(F.col("raw.detector")), F.lit("")) == TRANSCRIPT)
    return F.when(spoken, F.lit(TRANSCRIPT)).otherwise(F.col("source"))


def cluster_stats(cluster: DataFrame, *more: Column) -> DataFrame:
    generic = (F.col("source") == QR_CODE) & (F.coalesce(_tag(F.col("raw.signal")), F.lit("")) != "sponsor-cta")
    return cluster.groupBy("video_id", "cluster_s").agg(
        F.min_by("ev_idx", F.struct("start_s", "ev_idx")).alias("cand_idx"),
        F.count(F.lit(1)).alias("n_items"),
        F.bool_or(_is_sponsor_frame()).alias("has_sponsor_frame"),
        (F.min(_channel()) != F.max(_channel())).alias("has_two_channels"),
        F.bool_and(generic).alias("all_generic_qr"),
        *more,
    )


def eligible_clusters(cluster: DataFrame, *more: Column) -> DataFrame:
    """Clusters that may form a candidate; ``more`` adds aggregates over their rows."""
    return cluster_stats(cluster, *more).filter(
        F.col("has_sponsor_frame") | F.col("has_two_channels") | ((F.col("n_items") >= 3) & F.col("all_generic_qr"))
    )


def clustered_members(items: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Candidates of videos without a start cue with their evidence; a row belongs to one candidate at most."""
    cluster = presence_clusters(items, settle(presence_chains(seed_mode(items)[1])) if chains is None else chains)
    kept = eligible_clusters(cluster).select("video_id", "cluster_s", "cand_idx")
    return cluster.join(kept.hint("merge"), ["video_id", "cluster_s"]).select(
        "cand_idx", F.col("cluster_s").alias("cand_s"), F.lit(False).alias("seeded"), *EVIDENCE_COLUMNS
    )


def boundary_members(items: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """The members that decide a candidate's primary source: its start cue, or else the rows of its cluster.

    ``items`` is the coalesced evidence. A start cue comes before all other rows, so those need not be paired with it.
    """
    own = seeds_of(items).withColumn("cand_idx", F.col("ev_idx")).select("cand_idx", *EVIDENCE_COLUMNS)
    return own.unionByName(clustered_members(items, chains).select("cand_idx", *EVIDENCE_COLUMNS))


def candidate_members(evidence: DataFrame, coalesced: bool = False) -> DataFrame:
    """All candidates in long form: one row per candidate and related evidence row.

    The coalesced evidence is written once; every branch below then reads only its kind of
    rows and its columns from the files. Pass ``coalesced`` if the input is such a table.
    """
    items = evidence if coalesced else settle(coalesce_frames(evidence))
    seed = seeds_of(items)
    head = [F.col("ev_idx").alias("cand_idx"), F.col("start_s").alias("cand_s"), F.lit(True).alias("seeded")]
    own = seed.select(*head, *EVIDENCE_COLUMNS)
    # Joins with the seeds only reach videos that have one.
    near = seed_presence(items).select(
        "cand_idx", F.col("seed_s").alias("cand_s"), F.lit(True).alias("seeded"), *EVIDENCE_COLUMNS
    )
    ends = seed_end(items).select("video_id", F.col("seed_s").alias("start_s"), "end_row")
    closing = (
        seed.select("video_id", "start_s", *head)
        .join(ends, ["video_id", "start_s"])
        .select("cand_idx", "cand_s", "seeded", "end_row.*")
    )
    clustered = clustered_members(items)
    cols = ["video_id", "cand_idx", "cand_s", "seeded", *[c for c in EVIDENCE_COLUMNS if c != "video_id"]]
    out = own.select(*cols)
    for part in (near, closing, clustered):
        out = out.unionByName(part.select(*cols))
    return out


def evidence_weight(source: Column, kind: Column) -> Column:
    caption = F.when(kind == START, F.lit(TRANSCRIPT_WEIGHTS[START])).when(
        kind == END, F.lit(TRANSCRIPT_WEIGHTS[END])
    ).otherwise(F.lit(TRANSCRIPT_WEIGHTS[PRESENCE]))
    frame = F.when(source == PROGRESS_BAR, F.lit(WEIGHTS[PROGRESS_BAR])).when(
        source == QR_CODE, F.lit(WEIGHTS[QR_CODE])
    ).when(source == VISIBLE_LINK, F.lit(WEIGHTS[VISIBLE_LINK]))
    return F.coalesce(frame, caption)


def score_sum(confidence: Column, source: Column, kind: Column) -> Column:
    """Weighted confidence sum; decimals, so the result does not depend on the order of rows."""
    total = F.sum(_weighted(confidence, source, kind)).cast("double")
    return F.least(F.lit(SCORE_CAP), js_round(total, 3))


def score_candidates(member: DataFrame) -> DataFrame:
    """One row per candidate: score, number of evidence rows and detected end."""
    return member.groupBy(*CAND).agg(
        F.first("cand_s").alias("start_s"),
        F.first("seeded").alias("seeded"),
        score_sum(F.col("confidence"), F.col("source"), F.col("kind")).alias("confidence"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.min(F.when(F.col("seeded") & (F.col("kind") == END), F.col("start_s"))).alias("detected_end_s"),
    )


def infer_end(scored: DataFrame) -> DataFrame:
    assumed = F.when(
        F.col("seeded") & (F.col("confidence") >= CONFIDENT), F.col("start_s") + DEFAULT_DURATION_S
    )
    return scored.withColumn("end_s", F.coalesce("detected_end_s", assumed))


def candidates_of(member: DataFrame) -> DataFrame:
    return infer_end(score_candidates(member)).select(
        *CAND, "start_s", "end_s", "confidence", "n_evidence", "seeded", "detected_end_s"
    )


def edge(seed: Column, sign: int) -> Column:
    """Outermost position whose distance from the seed, as a double, is within the presence window."""
    at = seed + sign * PRESENCE_WINDOW_S
    near = [at + at * (k * 2.0**-53) for k in range(-4, 5)]
    inside = [F.when(F.abs(c - seed) <= PRESENCE_WINDOW_S, c) for c in near]
    return F.greatest(*inside) if sign > 0 else F.least(*inside)


def _weighted(confidence: Column, source: Column, kind: Column) -> Column:
    product = confidence.cast("decimal(12,6)") * evidence_weight(source, kind).cast("decimal(4,2)")
    return product.cast("decimal(20,8)")


def source_bit(source: Column) -> Column:
    """A bit for each known source, one more for all others."""
    out = F.lit(1 << len(SOURCES))
    for i, name in enumerate(SOURCES):
        out = F.when(source == name, F.lit(1 << i)).otherwise(out)
    return out


def pool_sources(pool: DataFrame) -> DataFrame:
    """One row per candidate and ``source`` of its members, from a pool with ``source_mask``; NULL stands for unknown sources."""
    named = [F.struct(F.lit(1 << i).alias("bit"), F.lit(name).alias("source")) for i, name in enumerate([*SOURCES, None])]
    held = F.filter(F.array(*named), lambda s: s["bit"].bitwiseAND(F.col("source_mask")) > 0)
    return pool.select(*CAND, F.explode(held).alias("s")).select(*CAND, "s.source")


def presence_totals(evidence: DataFrame) -> DataFrame:
    """Weighted sum, number and sources (a mask) of the presence rows around each distinct seed position.

    All windows are of one length, so no seed is paired with its presence rows, however many of them share a moment.
    """
    weight = _weighted(F.col("confidence"), F.col("source"), F.col("kind"))
    at = F.col("start_s")
    spot = (
        evidence.filter(F.col("kind") == PRESENCE)
        .groupBy("video_id", at.alias("from_t"))
        .agg(F.sum(weight).cast("decimal(28,8)").alias("w"), F.count(F.lit(1)).alias("n"), F.bit_or(source_bit(F.col("source"))).alias("m"))
        .withColumn("to_t", F.col("from_t"))
    )
    seed = seeds_of(evidence).select("video_id", at.alias("seed_s"), edge(at, -1).alias("lo"), edge(at, 1).alias("hi")).distinct()
    near = around(spot, seed, ["video_id"], "seed_s", 2 * PRESENCE_WINDOW_S, ["w", "n"], [], ("m",))
    zero = F.lit(0)
    return near.select(
        "video_id", "seed_s", F.coalesce("w", zero).alias("near_w"), F.coalesce("n", zero).alias("near_n"), F.coalesce("m", zero).alias("near_m")
    )


class PoolParts(NamedTuple):
    """What a pool and its features both need, written once: ends of seeds, and chains of videos without a start cue."""

    ends: DataFrame
    chains: DataFrame


def pool_parts(items: DataFrame) -> PoolParts:
    return PoolParts(settle(seed_end(items)), settle(presence_chains(seed_mode(items)[1])))


def candidate_pool(
    evidence: DataFrame, coalesced: bool = False, parts: PoolParts | None = None, sources: bool = False
) -> DataFrame:
    """All candidates with their scores; equal to the rows of ``candidates_of(candidate_members(..))``.

    Only sums and counts are needed here, so candidates are not paired with their evidence. With ``sources`` there is
    also ``source_mask``, for ``pool_sources``.
    """
    more = ["source_mask"] if sources else []
    items = evidence if coalesced else settle(coalesce_frames(evidence))
    ends = (parts.ends if parts else seed_end(items)).select(
        "video_id",
        "seed_s",
        F.col("end_at").alias("detected_end_s"),
        _weighted(F.col("end_row.confidence"), F.col("end_row.source"), F.col("end_row.kind")).alias("end_w"),
        source_bit(F.col("end_row.source")).alias("end_m"),
    )
    around = presence_totals(items).join(ends.hint("merge"), ["video_id", "seed_s"], "left")
    zero = F.lit(0).cast("decimal(28,8)")
    own = seeds_of(items).select(
        "video_id", F.col("ev_idx").alias("cand_idx"), F.col("start_s").alias("seed_s"),
        _weighted(F.col("confidence"), F.col("source"), F.col("kind")).alias("own_w"), source_bit(F.col("source")).alias("own_m"),
    )
    total = (F.col("own_w") + F.col("near_w") + F.coalesce("end_w", zero)).cast("double")
    seeded = own.join(around.hint("merge"), ["video_id", "seed_s"]).select(
        *CAND,
        F.col("seed_s").alias("start_s"),
        F.lit(True).alias("seeded"),
        F.least(F.lit(SCORE_CAP), js_round(total, 3)).alias("confidence"),
        (1 + F.col("near_n") + F.col("detected_end_s").isNotNull().cast("bigint")).alias("n_evidence"),
        "detected_end_s",
        F.col("own_m").bitwiseOR(F.col("near_m")).bitwiseOR(F.coalesce("end_m", F.lit(0))).alias("source_mask"),
    )
    cluster = presence_clusters(items, parts.chains if parts else settle(presence_chains(seed_mode(items)[1])))
    score = score_sum(F.col("confidence"), F.col("source"), F.col("kind"))
    mask = F.bit_or(source_bit(F.col("source")))
    clustered = eligible_clusters(cluster, score.alias("confidence"), mask.alias("source_mask")).select(
        *CAND,
        F.col("cluster_s").alias("start_s"),
        F.lit(False).alias("seeded"),
        "confidence",
        F.col("n_items").alias("n_evidence"),
        F.lit(None).cast("double").alias("detected_end_s"),
        "source_mask",
    )
    return infer_end(seeded.unionByName(clustered)).select(
        *CAND, "start_s", "end_s", "confidence", "n_evidence", "seeded", "detected_end_s", *more
    )


def seen_ends(pool: DataFrame) -> DataFrame:
    """The end rows of the candidates of a pool, with the columns of members that skipping asks for.

    A candidate has one end row at most, so the pool itself tells where it is and no other evidence is paired.
    """
    return pool.filter("detected_end_s is not null").select(*CAND, F.lit(END).alias("kind"), F.col("detected_end_s").alias("start_s"))


def heuristic_candidates(evidence: DataFrame, threshold: float = DISPLAY_THRESHOLD) -> DataFrame:
    return candidate_pool(evidence).filter(F.col("confidence") >= threshold)
