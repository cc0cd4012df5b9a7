"""Views derived from the driver tables, written once as SQL that Spark and DuckDB both run.

The driver tables hold no captions or frame evidence; these views give every query an input
that grows with the tables. Positions are whole or half seconds, so ties are exact.
``{name}`` stands for a driver table, ``{g}`` for DuckDB's global flag in regexp_replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tables import settle, spread  # noqa: F401  (settle is re-exported for queries)
from ..sources import schemas as S

VIEWS: dict[str, tuple[list[str], str]] = {
    "d_cue": (
        ["conversations"],
        """select cast(conv_id as string) as video_id, cast(turn as int) as cue_idx,
       cast(turn * 8 as double) as start_s, 6.0e0 as dur_s, text
from {conversations}""",
    ),
    # Cues of which some deny a phrase.
    "d_cue_not": (
        ["conversations"],
        """select video_id, cue_idx, start_s, dur_s,
       case cue_idx % 3 when 1 then replace(text, ' of the ', ' not quite of the ') when 2 then replace(text, ' by ', ' not only by ')
            else replace(text, ' is ', ' never is ') end as text from (select cast(conv_id as string) as video_id, cast(turn as int) as cue_idx,
       cast(turn * 8 as double) as start_s, 6.0e0 as dur_s, text
from {conversations}) q""",
    ),
    "d_evidence": (
        ["events"],
        """select 'v' || cast(user_id as string) as video_id, event_id as ev_idx,
       case event_type when 'view' then 'frame-progress-bar' when 'click' then 'frame-visible-link'
            when 'error' then 'frame-qr-code' else 'transcript' end as source,
       case when event_type = 'signup' and user_id % 3 <> 0 then 'ad-read-start'
            when event_type = 'purchase' and value > 60 then 'ad-read-end'
            else 'ad-read-presence' end as kind,
       cast((event_id * 37) % 1800 as double) as start_s, cast(null as double) as end_s,
       0.3e0 + (event_id % 60) / 100.0e0 as confidence,
       'observed ' || event_type as reason,
       case when event_type = 'error' then 'code-' || cast(event_id % 3 as string) end as raw_value,
       case when event_type = 'click' and event_id % 6 <> 1 then 'Link ' || cast(event_id % 5 as string) end as raw_text,
       case when event_type = 'click' and event_id % 6 = 1 then 'Link ' || cast(event_id % 5 as string) end as raw_href,
       case when event_type in ('click', 'error') and event_id % 4 = 0 then 'sponsor-cta' end as raw_signal,
       case when event_type = 'click' and event_id % 3 = 0 then 'transcript' end as raw_detector,
       case when event_type in ('signup', 'purchase') then 'group-' || cast(event_id % 4 as string)
            || case when event_id % 5 = 0 then ',extra-' || cast(event_id % 3 as string) else '' end end as raw_group,
       case when event_type = 'error' and event_id % 2 = 0 then cast(event_id % 300 as double) end as box_x,
       case when event_type = 'error' and event_id % 2 = 0 then cast(event_id % 200 as double) end as box_y,
       case when event_type = 'view' then cast(180 + event_id % 5 as double) end as bar_y,
       case when event_type = 'view' then cast(100 + event_id % 3 as double) end as bar_start,
       case when event_type = 'view' then cast(300 + event_id % 200 as double) end as bar_end
from {events}""",
    ),
    "d_feedback": (
        ["events"],
        """select 'f' || cast(event_id as string) || tag as id, ts + late as received_at,
       case when user_id % 40 <> 0 then 'client-' || cast(user_id % 40 as string) end as client_id,
       case when event_id % 97 <> 0 then 'v' || cast(user_id as string) end as video_id,
       case when event_id % 89 <> 0 then 'https://video.example/watch?v=v' || cast(user_id as string) end as video_url,
       'occ-' || cast(event_id % 500 as string) as occurrence_id,
       case when event_id % 3 = 1 then 'evidence' else 'candidate' end as occurrence_type,
       case event_type when 'view' then 'frame-progress-bar' when 'click' then 'frame-visible-link'
            when 'error' then 'frame-qr-code' when 'purchase' then 'transcript' end as source,
       (event_id % 1800) + 0.5e0 as start_s,
       case when event_id % 5 <> 0 then (event_id % 1800) + 30.5e0 + (event_id % 7) end as end_s,
       'seen ' || event_type || ' ' || cast(event_id % 50 as string) as summary,
       case event_id % 4 when 0 then 'accurate' when 1 then 'false_positive' when 2 then 'wrong_timing'
            else 'missed_context' end as feedback,
       case when event_id % 13 = 0 then null when event_id % 11 = 0 then 1 else 2 end as feature_schema_version,
       (event_id % 100) / 100.0e0 as heuristic_confidence,
       case when event_id % 6 <> 0 then (event_id % 128) / 128.0e0 end as model_confidence,
       case when event_id % 17 <> 0 then (event_id % 10) / 10.0e0 end as feat_confidence,
       case when event_id % 17 <> 0 then (event_id % 4) + 0.0e0 end as feat_total
from {events}
cross join (select '' as tag, interval '0' second as late union all select '-retry', interval '1' second) r
where tag = '' or event_id % 10 = 0""",
    ),
    "d_review": (
        ["events"],
        """select id, feedback_id, label, reviewed_at,
       case when label = 'wrong_timing' then start_s + 5 + event_id % 3 end as corrected_start_s,
       case when label = 'wrong_timing' and event_id % 5 <> 0 then start_s + 36 + (event_id % 7) end as corrected_end_s
from (
  select 'r' || cast(event_id as string) as id, 'f' || cast(event_id as string) as feedback_id, event_id,
         case event_id % 7 when 0 then 'positive' when 1 then 'false_positive' when 3 then 'duplicate'
              when 4 then 'ignored' when 5 then 'needs_more_data' else 'wrong_timing' end as label,
         ts + interval '1' hour as reviewed_at, (event_id % 1800) + 0.5e0 as start_s
  from {events} where event_id % 3 <> 0
  union all
  select 'r' || cast(event_id as string) || '-again', 'f' || cast(event_id as string), event_id, 'positive',
         ts + interval '2' hour, (event_id % 1800) + 0.5e0
  from {events} where event_id % 15 = 1
) r""",
    ),
    "d_example": (
        ["documents", "labels"],
        """select 'e' || cast(d.doc_id as string) as id, 'f' || cast(d.doc_id as string) as feedback_id,
       d.source as video_id, 'occ-' || cast(d.doc_id as string) as occurrence_id,
       l.quality as label, case when d.doc_id % 19 = 0 then 1 else 2 end as feature_schema_version,
       d.doc_id as created_ord,
       d.n_chars / (d.n_chars + 4096.0e0) as f_length,
       case when d.lang = 'en' then 1.0e0 else 0.0e0 end as f_english,
       case when d.lang = 'fr' then 1.0e0 else 0.0e0 end as f_french,
       (length(d.text) - length(translate(d.text, '0123456789', ''))) / (d.n_chars + 1.0e0) as f_digits,
       (length(d.text) - length(replace(d.text, chr(10), ''))) / (d.n_chars + 1.0e0) as f_lines
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    ),
    "d_link": (
        ["pages"],
        """select 'p' || cast(page_id as string) as video_id, cast(page_id as int) as cue_idx,
       cast(page_id % 900 as double) as start_s,
       case when page_id % 5 = 0 then url || '/offer' else url end as url,
       regexp_replace(html, '<[^>]*>', ' '{g}) as plain,
       case when page_id % 3 = 0 then 'Use code SAVE' || cast(page_id % 90 as string) || ' at '
            when page_id % 3 = 1 then 'This is not sponsored by anyone, read ' else 'Read ' end
         || url || case when page_id % 5 = 0 then '/offer now' else ' for details.' end as text
from (select page_id, html, case when page_id % 5 = 1 then replace(url, '/en/', '/en/../e^n/./{{n}}/%2E%2e/') else url end as url from {pages}) p""",
    ),
    "d_tick": (
        ["events"],
        """select 's' || cast(user_id as string) as session_id, 'v' || cast(user_id as string) as video_id, ts,
       ((event_id * 37) % 1800) + 0.25e0 as pos_s, 1800.0e0 as duration_s, event_id % 7 <> 0 as is_playing
from {events}""",
    ),
    "d_status": (
        ["events"],
        """select 'v' || cast(user_id as string) as video_id, ts as updated_at,
       case event_id % 9 when 0 then 'idle' when 1 then 'starting' when 2 then 'transcript' when 3 then 'frames'
            when 4 then 'fusion' when 5 then 'done' when 6 then 'permission' when 7 then 'stopped' else 'error' end
         as phase,
       (event_id % 160) / 128.0e0 - 0.125e0 as progress, event_id % 50 - 2 as sample_count
from {events}""",
    ),
    "d_request": (
        ["events"],
        """select 'client-' || cast(user_id % 7 as string) as client_key, ts as asked_at, event_id as request_id
from {events}""",
    ),
}


def oracle_view(name: str) -> str:
    tables, body = VIEWS[name]
    return body.format(g=", 'g'", **{t: t for t in tables})


def with_views(names: list[str], body: str) -> str:
    """Oracle SQL text with the derived views in front."""
    ctes = ",\n".join(f"{n} as (\n{oracle_view(n)}\n)" for n in names)
    head = "with recursive " if "with recursive" in body.lower() else "with "
    body = body.strip()
    if body.lower().startswith("with "):
        rest = body[5:].strip()
        if rest.lower().startswith("recursive "):
            rest = rest[10:]
        return f"{head}{ctes},\n{rest}"
    return f"{head}{ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, body = VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in tables}
    return spark.sql(body.replace("{g}", ""), **frames)


EVENTS_PER_TASK = 65536


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_cue")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An event becomes an evidence row with raw fields and a fingerprint, much more than the bytes that the scan goes by.
    events = spread(table(spark, sf_dir, "events"), "event_id", rows=EVENTS_PER_TASK)
    flat = spark.sql(VIEWS["d_evidence"][1], events=events)
    box = F.when(
        F.col("box_x").isNotNull(),
        F.struct(
            F.struct(F.col("box_x").alias("x"), F.col("box_y").alias("y")).alias("top_left"),
            F.struct((F.col("box_x") + 80).alias("x"), (F.col("box_y") + 60).alias("y")).alias("bottom_right"),
        ),
    )
    bar = F.col("bar_y").isNotNull()
    groups = F.split("raw_group", ",")
    raw = S.raw(
        value=F.col("raw_value"),
        text=F.col("raw_text"),
        signal=F.col("raw_signal"),
        detector=F.col("raw_detector"),
        href=F.when(F.col("ev_idx") % 12 == 1, F.col("raw_href")),
        url=F.when(F.col("ev_idx") % 12 != 1, F.col("raw_href")),
        phrase_group_id=F.get(groups, F.lit(0)),
        phrase_group_ids=F.when(F.size(groups) > 1, F.slice(groups, 2, 9)),
        location=box,
        y=F.col("bar_y"),
        start_x=F.col("bar_start"),
        end_x=F.col("bar_end"),
        rows=F.when(bar, F.lit(3.0)),
        frame_width=F.when(bar, F.lit(960.0)),
        frame_height=F.when(bar, F.lit(540.0)),
        track_start_x=F.col("bar_start"),
        track_end_x=F.when(bar, F.lit(800.0)),
        fill_ratio=F.when(bar, (F.col("bar_end") - F.col("bar_start") + 1) / (801 - F.col("bar_start"))),
    )
    return flat.withColumn("raw", raw).select(*S.EVIDENCE_COLUMNS)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, "d_feedback")
    given = {
        "received_at": F.col("received_at").cast("timestamp"),
        "created_at": F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "candidate_features": F.when(
            F.col("feat_total").isNotNull(),
            F.create_map(
                F.lit("heuristicConfidence"), F.col("feat_confidence"), F.lit("evidenceTotal"), F.col("feat_total")
            ),
        ),
        "evidence_snapshot": F.when(
            F.col("feature_schema_version").isNotNull(),
            F.array(
                _shot("frame-qr-code", S.PRESENCE, F.col("start_s") + 1),
                _shot("transcript", S.START, F.col("start_s") + 4),
            ),
        ),
    }
    fields = S.struct_of(S.FEEDBACK)
    return flat.select(
        *[
            (given[f.name] if f.name in given else F.col(f.name) if f.name in flat.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in fields
        ]
    )


def _shot(source: str, kind: str, start):
    return F.struct(
        F.lit(source).alias("source"),
        F.lit(kind).alias("kind"),
        start.alias("start_s"),
        F.lit(None).cast("double").alias("end_s"),
        F.lit(0.5).alias("confidence"),
        F.lit("seen").alias("reason"),
        F.lit(None).cast("string").alias("detail"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, "d_review")
    return flat.select(
        "id",
        "feedback_id",
        "label",
        F.lit(None).cast("string").alias("notes"),
        F.when(
            F.col("corrected_start_s").isNotNull(),
            F.struct(F.col("corrected_start_s").alias("start_s"), F.col("corrected_end_s").alias("end_s")),
        ).alias("boundary_correction"),
        F.col("reviewed_at").cast("timestamp").alias("reviewed_at"),
    )


EXAMPLE_FEATURES = ["f_length", "f_english", "f_french", "f_digits", "f_lines"]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, "d_example")
    pairs = [c for f in EXAMPLE_FEATURES for c in (F.lit(f), F.col(f))]
    return flat.select(
        "id", "feedback_id", "video_id", "occurrence_id", "label", "feature_schema_version",
        F.create_map(*pairs).alias("features"), F.timestamp_seconds("created_ord").alias("created_at"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_link")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "d_tick").withColumn("ts", F.col("ts").cast("timestamp"))
