"""Caption payloads and watch pages to cues, tracks and videos."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import collapse

# Fixed values (must match for right results).
PLAYER_RESPONSE_NAME = "ytInitialPlayerResponse"
WATCH_HOST = "youtube.com"
SHORT_HOST = "youtu.be"
WATCH_PATH = "/watch"
CAPTION_FORMAT = "fmt=json3"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_number(value: Column) -> Column:
    return F.coalesce(_kind(value).rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def _number(value: Column) -> Column:
    return F.when(_is_number(value), F.try_variant_get(value, "$", "double"))


def _string(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _list(value: Column) -> Column:
    return F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def caption_events_to_cues(payload: DataFrame) -> DataFrame:
    """``video_id, payload`` (caption JSON text) to cues; list order becomes ``cue_idx``."""
    events = payload.withColumn("_events", _list(_at(F.try_parse_json("payload"), "$.events")))
    e = events.select("video_id", F.posexplode("_events").alias("cue_idx", "_e"))
    text = F.array_join(
        F.transform(_list(_at(F.col("_e"), "$.segs")), lambda s: F.coalesce(_string(_at(s, "$.utf8")), F.lit(""))), ""
    )
    start, length = _number(_at(F.col("_e"), "$.tStartMs")), _number(_at(F.col("_e"), "$.dDurationMs"))
    return e.select(
        "video_id",
        "cue_idx",
        (start / 1000).alias("start_s"),
        F.coalesce(length / 1000, F.lit(0.0)).alias("dur_s"),
        collapse(text).alias("text"),
    ).filter("start_s is not null and text <> ''")


_TOKEN = re.compile(r"""[{}]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)""", re.S)


def assigned_object(page: str | None, name: str) -> str | None:
    """First ``{...}`` after ``name`` with balanced braces; quoted text is skipped as one token."""
    found = page.find(name) if page else -1
    start = page.find("{", found) if found >= 0 else -1
    if start < 0:
        return None
    depth = 0
    for token in _TOKEN.finditer(page, start):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0:
            return page[start : token.end()]
    return None


@F.pandas_udf(T.StringType())
def _player_response(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda page: assigned_object(page, PLAYER_RESPONSE_NAME))


def pages_to_caption_tracks(page: DataFrame) -> DataFrame:
    """``video_id, html`` to caption tracks. Pages without the object never reach Python."""
    candidates = page.filter(F.col("html").contains(PLAYER_RESPONSE_NAME))
    found = candidates.withColumn("_json", _player_response("html")).withColumn("_v", F.try_parse_json("_json"))
    tracks = _list(_at(F.col("_v"), "$.captions.playerCaptionsTracklistRenderer.captionTracks"))
    t = found.select("video_id", F.posexplode(tracks).alias("track_idx", "_t"))
    at = lambda path: _at(F.col("_t"), path)
    runs = F.trim(
        F.array_join(F.transform(_list(at("$.name.runs")), lambda r: F.coalesce(_string(_at(r, "$.text")), F.lit(""))), "")
    )
    return t.select(
        "video_id",
        "track_idx",
        _string(at("$.baseUrl")).alias("base_url"),
        _string(at("$.languageCode")).alias("lang"),
        F.coalesce(_string(at("$.name.simpleText")), runs, F.lit("")).alias("name"),
        _string(at("$.kind")).alias("kind"),
    ).filter("base_url is not null and lang is not null")


def pick_caption_track(track: DataFrame) -> DataFrame:
    """One track per video: English and not automatic, else English, else the first."""
    english = F.lower("lang").startswith("en")
    rank = F.when(english & ~F.col("kind").eqNullSafe("asr"), 0).when(english, 1).otherwise(2)
    cols = [c for c in track.columns if c != "video_id"]
    return (
        track.groupBy("video_id")
        .agg(F.min_by(F.struct(*cols), F.struct(rank, F.col("track_idx"))).alias("_row"))
        .select("video_id", "_row.*")
    )


def prefer_fresh_snapshot(
    fresh_cue: DataFrame, fresh_track: DataFrame, fallback_cue: DataFrame
) -> DataFrame:
    """Cues of the fresh page where it has a track or any cue, of the fallback elsewhere."""
    usable = fresh_cue.select("video_id").unionByName(fresh_track.select("video_id")).distinct()
    return fresh_cue.unionByName(fallback_cue.join(usable, "video_id", "left_anti").select(*fresh_cue.columns))


def pages_to_videos(
    page: DataFrame,
    watch_host: str = WATCH_HOST,
    short_host: str = SHORT_HOST,
    watch_path: str = WATCH_PATH,
    id_parameter: str = "v",
) -> DataFrame:
    """Keeps watch URLs and adds ``video_id``. Host and path rules are parameters."""
    url = F.col("url")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    short_id = F.try_url_decode(F.regexp_extract(path, "^/([^/]*)", 1))
    has_parameter = F.concat(F.lit("&"), F.try_parse_url(url, F.lit("QUERY"))).rlike(f"&{id_parameter}(?:=|&|$)")
    long_id = F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(id_parameter)), F.lit("")))
    on_host = (host == watch_host) | host.endswith("." + watch_host)
    is_short = host == short_host
    watch = F.when(is_short, F.length(path) > 1).otherwise(on_host & (path == watch_path) & has_parameter)
    return page.filter(F.coalesce(watch, F.lit(False))).withColumn(
        "video_id", F.when(is_short, F.nullif(short_id, F.lit(""))).otherwise(long_id)
    )


def caption_request_url(base_url: Column) -> Column:
    """Track URL that asks for the JSON form; an older format choice is replaced."""
    fragment = F.regexp_extract(base_url, "#.*$", 0)
    bare = F.regexp_replace(base_url, "#.*$", "")
    had = bare.rlike("[?&]fmt=")
    changed = F.regexp_replace(bare, "([?&])fmt=[^&]*", "$1" + CAPTION_FORMAT)
    added = F.concat(bare, F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(CAPTION_FORMAT))
    return F.concat(F.when(had, changed).otherwise(added), fragment)
