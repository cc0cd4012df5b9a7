"""Candidate features from the long candidate/evidence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import intervals, text as tx
from ..functions.numbers import is_finite, js_round
from ..functions.once import bound, computed_if
from ..sources.defaults import CALL_TO_ACTION_FEATURE_PHRASES, SPONSOR_FEATURE_PHRASES
from ..sources.schemas import END, PRESENCE, PROGRESS_BAR, QR_CODE, START, TRANSCRIPT, VISIBLE_LINK
from .fusion import CAND

# Fixed values (must match for right results): feature names in schema order.
FEATURE_NAMES = [
    "heuristicConfidence",
    "evidenceTotal",
    "transcriptStartCount",
    "transcriptPresenceCount",
    "transcriptEndCount",
    "qrCount",
    "progressBarCount",
    "visibleLinkCount",
    "qrLocationCount",
    "avgQrBoxAreaPixels",
    "avgQrBoxCenterX",
    "avgQrBoxCenterY",
    "avgProgressBarWidthPixels",
    "avgProgressBarY",
    "avgProgressBarRows",
    "maxTranscriptConfidence",
    "avgTranscriptConfidence",
    "maxQrConfidence",
    "avgQrConfidence",
    "maxProgressBarConfidence",
    "avgProgressBarConfidence",
    "maxVisibleLinkConfidence",
    "avgVisibleLinkConfidence",
    "startSeconds",
    "durationSeconds",
    "isOpenEnded",
    "normalizedVideoPosition",
    "evidenceTimeSpanSeconds",
    "hasTranscriptAndQr",
    "hasTranscriptAndVisibleLink",
    "hasTranscriptAndProgressBar",
    "hasQrAndVisibleLink",
    "isFrameOnly",
    "isTranscriptOnly",
    "matchedPhraseGroupCount",
    "sponsorPhraseHitCount",
    "callToActionPhraseHitCount",
    "nearbyEndCue",
]
NEAR_END_S = 10.0
OPEN_REACH_S = 240.0
CONTEXT_WINDOW_S = 20.0

CONTEXT_CELL_S = 120.0
_PHRASES = [tx.normalize_phrase(p) for p in (*SPONSOR_FEATURE_PHRASES, *CALL_TO_ACTION_FEATURE_PHRASES)]
MAX_PHRASE_WORDS = max(len(p.split()) for p in _PHRASES)
MAX_PHRASE_CHARS = max(map(len, _PHRASES))


def text_in_span(
    spans: DataFrame, keys: list[str], cue: DataFrame, start: Column, end: Column, name: str
) -> DataFrame:
    """Per span: the texts of the cues that overlap it, in order, white space collapsed."""
    said = cue.select("video_id", "cue_idx", F.col("start_s").alias("_cs"), (F.col("start_s") + F.col("dur_s")).alias("_ce"), F.col("text").alias("_ct"))
    return (
        intervals.overlap_join(
            spans.withColumn("_from", start).withColumn("_to", end).select(*keys, "_from", "_to"),
            said, ["video_id"], (F.col("_from"), F.col("_to")), (F.col("_cs"), F.col("_ce")), CONTEXT_CELL_S,
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("cue_idx", "_ct"))).alias("_said"))
        .select(*keys, bound(tx.collapse(F.array_join(F.transform("_said", lambda s: s["_ct"]), " ")), lambda t: F.nullif(t, F.lit(""))).alias(name))
    )


def transcript_context(candidate: DataFrame, cue: DataFrame, window_s: float = CONTEXT_WINDOW_S) -> DataFrame:
    start = F.greatest(F.lit(0.0), F.col("start_s") - window_s)
    end = F.coalesce("end_s", "start_s") + window_s
    return text_in_span(candidate, CAND, cue, start, end, "transcript_context")


def row_groups(raw: Column) -> Column:
    """Phrase groups of an evidence row: one id, an array of ids, or both."""
    own = F.concat(F.array(raw["phrase_group_id"]), F.coalesce(raw["phrase_group_ids"], F.array().cast("array<string>")))
    return F.filter(own, lambda g: F.trim(g) != "")


def _groups(raw: Column) -> Column:
    """Phrase groups of the evidence of a candidate, an aggregate."""
    return F.array_distinct(F.flatten(F.collect_set(row_groups(raw))))


def phrase_group_ids(member: DataFrame) -> DataFrame:
    """Sorted distinct phrase groups; their number is bounded by the phrase configuration."""
    return member.groupBy(*CAND).agg(
        F.array_sort(_groups(F.col("raw"))).alias("phrase_group_ids")
    )


def said() -> Column:
    """The words of an evidence row, as they count for phrase hits."""
    raw = F.col("raw")
    return F.concat_ws(" ", F.col("reason"), raw["text"], raw["phrase"], raw["value"], F.array_join(raw["links"], " "))


def _phrase_hits(member: DataFrame, context: DataFrame | None, nfkc: bool) -> DataFrame:
    """Number of distinct phrases found in the ordered text of a candidate.

    A phrase of n words lies in one part or runs over at most n - 1 more parts; each part is therefore
    searched together with the head of what follows, as far as the longest phrase of the list reaches.
    """
    parts = member.select(*CAND, F.col("start_s").alias("_o1"), F.col("ev_idx").alias("_o2"), said().alias("part"))
    if context is not None:
        first = context.select(
            *CAND, F.lit(float("-inf")).alias("_o1"), F.lit(0).cast("bigint").alias("_o2"),
            F.col("transcript_context").alias("part"),
        )
        parts = parts.unionByName(first)
    parts = computed_if(parts.withColumnRenamed("part", "_part"), "part", tx.normalize_text(F.col("_part"), nfkc), lambda t: t != "").drop("_part")
    w = Window.partitionBy(*CAND).orderBy("_o1", "_o2")
    tail = F.concat_ws(" ", *[F.lead("part", i).over(w) for i in range(1, MAX_PHRASE_WORDS)])
    parts = parts.withColumn("tail", F.substring(tail, 1, MAX_PHRASE_CHARS))
    text = F.when(F.col("tail") == "", F.col("part")).otherwise(F.concat("part", F.lit(" "), "tail"))
    parts = parts.select(*CAND, "part", text.alias("text"))

    def has(phrase: str) -> Column:
        norm = tx.normalize_phrase(phrase)
        if " " in norm:
            return F.col("text").contains(norm)
        return F.col("part").rlike(tx.java_pattern(r"\b" + norm + r"\b"))

    phrases = [("s", i, p) for i, p in enumerate(SPONSOR_FEATURE_PHRASES)]
    phrases += [("c", i, p) for i, p in enumerate(CALL_TO_ACTION_FEATURE_PHRASES)]
    flags = [F.max(has(p).cast("int")).alias(f"_{k}{i}") for k, i, p in phrases]

    def total(kind: str) -> Column:
        cols = [F.col(f"_{k}{i}") for k, i, _ in phrases if k == kind]
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out.cast("double")

    return parts.groupBy(*CAND).agg(*flags).select(
        *CAND, total("s").alias("sponsorPhraseHitCount"), total("c").alias("callToActionPhraseHitCount")
    )


_SOURCES = {TRANSCRIPT: "Transcript", QR_CODE: "Qr", PROGRESS_BAR: "ProgressBar", VISIBLE_LINK: "VisibleLink"}


def _measures() -> tuple[dict[str, Column], dict[str, Column]]:
    """What one evidence row adds to its candidate: values to sum (counts, decimals) and values to take the largest of."""
    src, kind, conf, raw = F.col("source"), F.col("kind"), F.col("confidence"), F.col("raw")
    width = F.greatest(F.lit(0.0), raw["location"]["bottom_right"]["x"] - raw["location"]["top_left"]["x"])
    height = F.greatest(F.lit(0.0), raw["location"]["bottom_right"]["y"] - raw["location"]["top_left"]["y"])
    boxed = (src == QR_CODE) & (width > 0) & (height > 0)
    for e in [raw["location"][c][a] for c in ("top_left", "bottom_right") for a in ("x", "y")]:
        boxed = boxed & is_finite(e)
    bar_width = raw["end_x"] - raw["start_x"] + 1
    barred = (src == PROGRESS_BAR) & (bar_width > 0) & (raw["rows"] > 0)
    for e in (raw["start_x"], raw["end_x"], raw["y"], raw["rows"]):
        barred = barred & is_finite(e)

    def n(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("bigint")

    def part(value: Column, condition: Column) -> Column:
        return F.when(condition, value).cast("decimal(24,6)")

    sums = {
        "evidenceTotal": F.lit(1).cast("bigint"),
        "transcriptStartCount": n((src == TRANSCRIPT) & (kind == START)),
        "transcriptPresenceCount": n((src == TRANSCRIPT) & (kind == PRESENCE)),
        "transcriptEndCount": n((src == TRANSCRIPT) & (kind == END)),
        "_transcript": n(src == TRANSCRIPT),
        "qrCount": n(src == QR_CODE),
        "progressBarCount": n(src == PROGRESS_BAR),
        "visibleLinkCount": n(src == VISIBLE_LINK),
        "qrLocationCount": n(boxed),
        "_barred": n(barred),
        "avgQrBoxAreaPixels": part(width * height, boxed),
        "avgQrBoxCenterX": part(raw["location"]["top_left"]["x"] + width / 2, boxed),
        "avgQrBoxCenterY": part(raw["location"]["top_left"]["y"] + height / 2, boxed),
        "avgProgressBarWidthPixels": part(bar_width, barred),
        "avgProgressBarY": part(raw["y"], barred),
        "avgProgressBarRows": part(raw["rows"], barred),
    }
    maxima = {"_last": F.col("start_s"), "_first": -F.col("start_s")}
    for key, name in _SOURCES.items():
        sums[f"avg{name}Confidence"] = part(conf, src == key)
        maxima[f"max{name}Confidence"] = F.when(src == key, conf)
    return sums, maxima


def _vector(per: DataFrame) -> DataFrame:
    """The feature columns from the summed measures of a candidate.

    Also needed: ``_start``, ``_end``, ``_conf``, ``_dur``, ``matchedPhraseGroupCount``, ``nearbyEndCue`` and the hit counts.
    """
    counts = {"Qr": "qrCount", "ProgressBar": "progressBarCount", "VisibleLink": "visibleLinkCount", "Transcript": "_transcript"}
    of = {f"avg{name}Confidence": c for name, c in counts.items()}
    of |= {f: "qrLocationCount" for f in ("avgQrBoxAreaPixels", "avgQrBoxCenterX", "avgQrBoxCenterY")}
    of |= {f: "_barred" for f in ("avgProgressBarWidthPixels", "avgProgressBarY", "avgProgressBarRows")}

    def mean(total: str) -> Column:
        n = F.nullif(F.col(of[total]).cast("double"), F.lit(0.0))
        return F.coalesce(js_round(F.col(total).cast("double") / n, 6), F.lit(0.0))

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    some = {k: F.col(c) > 0 for k, c in (("t", "_transcript"), ("q", "qrCount"), ("p", "progressBarCount"), ("l", "visibleLinkCount"))}
    position = js_round(F.col("_start") / F.when(F.col("_dur") > 0, F.col("_dur")), 6)
    derived = {f: mean(f) for f in of}
    derived |= {f: F.coalesce(js_round(F.col(f), 6), F.lit(0.0)) for f in (f"max{name}Confidence" for name in counts)}
    derived |= {
        "heuristicConfidence": js_round(F.col("_conf"), 6),
        "startSeconds": js_round(F.col("_start"), 6),
        "durationSeconds": F.coalesce(js_round(F.greatest(F.lit(0.0), F.col("_end") - F.col("_start")), 6), F.lit(0.0)),
        "evidenceTimeSpanSeconds": js_round(F.col("_last") + F.col("_first"), 6),
        "isOpenEnded": flag(F.col("_end").isNull()),
        "normalizedVideoPosition": F.coalesce(position, F.lit(0.0)),
        "hasTranscriptAndQr": flag(some["t"] & some["q"]),
        "hasTranscriptAndVisibleLink": flag(some["t"] & some["l"]),
        "hasTranscriptAndProgressBar": flag(some["t"] & some["p"]),
        "hasQrAndVisibleLink": flag(some["q"] & some["l"]),
        "isFrameOnly": flag(~some["t"]),
        "isTranscriptOnly": flag(some["t"] & (F.col("_transcript") == F.col("evidenceTotal"))),
        "sponsorPhraseHitCount": F.coalesce("sponsorPhraseHitCount", F.lit(0.0)),
        "callToActionPhraseHitCount": F.coalesce("callToActionPhraseHitCount", F.lit(0.0)),
    }
    return per.select(*CAND, *[derived.get(f, F.col(f)).cast("double").alias(f) for f in FEATURE_NAMES])


def _with_duration(per: DataFrame, video: DataFrame | None) -> DataFrame:
    if video is None:
        return per.withColumn("_dur", F.lit(None).cast("double"))
    return per.join(video.select("video_id", F.col("duration_s").alias("_dur")).hint("merge"), "video_id", "left")


def _span_of(candidate: DataFrame) -> DataFrame:
    return candidate.select(*CAND, F.col("start_s").alias("_start"), F.col("end_s").alias("_end"), F.col("confidence").alias("_conf"))


def candidate_features(
    candidate: DataFrame,
    member: DataFrame,
    context: DataFrame | None = None,
    video: DataFrame | None = None,
    nfkc: bool = True,
) -> DataFrame:
    """``video_id, cand_idx`` and the 38 feature columns, from given members.

    ``context``: output of ``transcript_context``; ``video``: ``video_id, duration_s``. Candidates of a pool have the same
    features by ``pool_features``, which makes no members.
    """
    sums, maxima = _measures()
    kind, raw = F.col("kind"), F.col("raw")
    near_end = (kind == END) & F.when(
        F.col("_end").isNotNull(), F.abs(F.col("start_s") - F.col("_end")) <= NEAR_END_S
    ).otherwise((F.col("start_s") >= F.col("_start")) & (F.col("start_s") <= F.col("_start") + OPEN_REACH_S))
    per = (
        member.join(_span_of(candidate).hint("merge"), CAND)
        .groupBy(*CAND, "_start", "_end", "_conf")
        .agg(
            *[F.sum(c).alias(k) for k, c in sums.items()],
            *[F.max(c).alias(k) for k, c in maxima.items()],
            F.size(_groups(raw)).alias("matchedPhraseGroupCount"),
            F.bool_or(near_end).alias("nearbyEndCue"),
        )
        .join(_phrase_hits(member, context, nfkc).hint("merge"), CAND, "left")
    )
    return _vector(_with_duration(per, video))


def feature_map(names: list[str] | None = None) -> Column:
    """The feature columns as one map, the form feedback and training rows carry."""
    pairs = [c for f in (names or FEATURE_NAMES) for c in (F.lit(f), F.col(f))]
    return F.create_map(*pairs)
