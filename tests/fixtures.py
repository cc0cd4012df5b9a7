"""Golden inputs as plain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmark.sources import schemas as S


def raw_row(**given):
    return tuple(given.get(name) for name in S.RAW_FIELDS)


def evidence_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    data = []
    for i, row in enumerate(rows):
        detail = row.get("raw")
        data.append(
            (
                row.get("video_id", "v"),
                row.get("ev_idx", i),
                row.get("source", "transcript"),
                row.get("kind", "ad-read-start"),
                float(row.get("start_s", 0)),
                row.get("end_s"),
                float(row.get("confidence", 0.8)),
                row.get("reason", "test"),
                None if detail is None else raw_row(**detail),
            )
        )
    return spark.createDataFrame(data, S.EVIDENCE)


def cue_df(spark: SparkSession, rows: list[tuple], video_id: str = "v") -> DataFrame:
    """rows: (start, text) or (video, start, text), durations 4 s."""
    data, seen = [], {}
    for row in rows:
        video, start, text = row if len(row) == 3 else (video_id, *row)
        idx = seen.get(video, 0)
        seen[video] = idx + 1
        data.append((video, idx, float(start), 4.0, text))
    return spark.createDataFrame(data, S.CUE)


def bar(start, fill):
    return {
        "source": S.PROGRESS_BAR, "kind": S.PRESENCE, "start_s": start, "confidence": 0.78,
        "reason": "Confirmed a changing horizontal progress bar across consecutive video frames.",
        "raw": {
            "frame_width": 960.0, "frame_height": 540.0, "track_start_x": 120.0, "track_end_x": 840.0,
            "start_x": 120.0, "end_x": float(120 + round(720 * fill)), "y": 180.0, "rows": 3.0, "fill_ratio": fill,
            "temporal_observations": 2, "fill_delta": 0.12,
        },
    }


# case id, duration, cues, supporting evidence, expected segments
CORPUS = [
    ("explicit-preroll-sponsor", 600,
     [(0, "Today we are comparing two approaches."),
      (24, "Before we begin, today's sponsor is Acme Vault."),
      (32, "Use code SAMPLE at checkout for a discount."),
      (80, "Now back to the video and our first comparison.")], [], [(24, 80)]),
    ("split-caption-midroll", 900,
     [(294, "There is one more constraint to consider."),
      (300, "This episode is made possible"),
      (303, "by Acme Cloud, which keeps the sample project online."),
      (312, "Click the link in the description to start a free trial."),
      (365, "With that out of the way, let us inspect the result.")], [], [(300, 365)]),
    ("progress-corroborated-midroll", 720,
     [(150, "A quick word from Acme Mobile before the next section."),
      (212, "Now let's get back into the walkthrough.")],
     [bar(156, 0.24), bar(162, 0.48), bar(168, 0.72)], [(150, 212)]),
    ("two-distinct-ad-breaks", 1200,
     [(60, "This video is brought to you by Acme Audio."),
      (68, "Go to acme dot example slash audio to learn more."),
      (110, "Back to the video and the microphone test."),
      (420, "Thanks to our sponsor Beta Desk for supporting this episode."),
      (428, "Use code SAMPLE for the limited time offer."),
      (480, "Anyway, here is the final desk setup.")], [], [(60, 110), (420, 480)]),
    ("semantic-qr-only", 480, [],
     [{"source": S.QR_CODE, "kind": S.PRESENCE, "start_s": 250, "confidence": 0.85, "reason": "qr",
       "raw": {"value": "https://sponsor.example/offer", "signal": "sponsor-cta", "payload_type": "url"}}],
     [(250, 310)]),
    ("negative-not-sponsored", 420,
     [(90, "This video is not sponsored by Acme; it is an independent comparison."),
      (98, "No coupon, promotion, or paid placement was involved.")], [], []),
    ("negative-ordinary-navigation", 540,
     [(120, "Visit the settings page and enable the advanced option."),
      (130, "Check out the chart to confirm the new value."),
      (140, "The next section explains why that value changes.")], [], []),
    ("negative-generic-transcript-links", 480,
     [(70, "Visit docs.example/guide for the configuration steps."),
      (80, "Check out source.example/project to inspect the implementation.")], [], []),
    ("negative-generic-frame-link", 420, [],
     [{"source": S.VISIBLE_LINK, "kind": S.PRESENCE, "start_s": 90, "confidence": 0.24, "reason": "link",
       "raw": {"links": ["https://docs.example/guide"], "text": "Documentation: docs.example/guide",
               "signal": "low-signal", "detector": "TextDetector"}}], []),
    ("negative-return-transition", 360, [(44, "Anyway, let us get back to the earlier question.")], [], []),
    ("negative-progress-control", 300, [], [bar(40, 0.2), bar(46, 0.45), bar(52, 0.7)], []),
    ("negative-sponsorship-discussion", 660,
     [(220, "The report compares sponsorship disclosure rules across formats.")], [], []),
]


def corpus_frames(spark: SparkSession):
    cases = spark.createDataFrame([(c[0], float(c[1])) for c in CORPUS], "case_id string, duration_s double")
    cue = cue_df(spark, [(c[0], t, text) for c in CORPUS for t, text in c[2]])
    given = evidence_df(spark, [{**e, "video_id": c[0]} for c in CORPUS for e in c[3]])
    expected = spark.createDataFrame(
        [(c[0], i, float(s), float(e)) for c in CORPUS for i, (s, e) in enumerate(c[4])],
        "case_id string, exp_idx int, start_s double, end_s double",
    )
    return cases, expected, cue, given
