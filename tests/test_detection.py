"""Phrases, links, fusion and the golden corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import corpus_frames, cue_df, evidence_df
from reelmark.functions import text as tx
from reelmark.operators import evaluation, fusion, links, transcript
from reelmark.sources import schemas as S
from reelmark.sources.defaults import DEFAULT_PHRASE_GROUPS


def analyse(spark, cues, groups=DEFAULT_PHRASE_GROUPS):
    out = transcript.transcript_evidence(cue_df(spark, cues), transcript.phrase_array(groups))
    return out.orderBy("start_s").collect()


def test_corpus_meets_the_gates(spark):
    cases, expected, cue, given = corpus_frames(spark)
    run = evaluation.run_benchmark(cases, expected, cue, given, transcript.phrase_array(DEFAULT_PHRASE_GROUPS))
    outcome = {r.case_id: r for r in run["outcomes"].collect()}
    assert {k for k, r in outcome.items() if r.misses or r.false_positives} == set()
    metrics = run["metrics"].first()
    assert (metrics.cases, metrics.expected_segments, metrics.matched_segments) == (12, 6, 6)
    assert metrics.boundary_mae_s == 0 and metrics.closed_boundary_rate == 0.8333
    assert evaluation.benchmark_gates(run["metrics"]).count() == 0
    lines = evaluation.benchmark_report(run["metrics"], run["outcomes"]).collect()
    assert len(lines) == 17 and sum(r.line.startswith("PASS") for r in lines) == 12


@pytest.mark.parametrize(
    "cues, kinds, reason",
    [
        ([(12, "Before we continue, today's sponsor is Acme VPN.")], [S.START], "today's sponsor"),
        ([(18, "This episode is made possible by Acme VPN.")], [S.START], "made possible by"),
        ([(18, "This episode is made possible"), (20, "by Acme VPN.")], [S.START], "made possible by"),
        ([(28, "Use code sample at checkout for a limited time.")], [S.PRESENCE], "use code"),
        ([(91, "Now back to the video and the thing we're building.")], [S.END], "now back to"),
        ([(44, "THANKS TO our sponsor for supporting this episode.")], [S.START], "thanks to our sponsor"),
        ([(44, "Not only sponsored by Acme, but also built with its API.")], [S.START], "sponsored by"),
        ([(44, "Not sponsored by Acme."), (48, "The follow-up isn't sponsored by anyone either.")], [], None),
        ([(4, "ＳＰＯＮＳＯＲＥＤ by Acme")], [S.START], "sponsored by"),
        ([(4, "the é" + "visit is not a word edge problem")], [S.PRESENCE], "visit"),
    ],
)
def test_phrases(spark, cues, kinds, reason):
    rows = analyse(spark, cues)
    assert [r.kind for r in rows] == kinds
    if reason:
        assert f'"{reason}"' in rows[0].reason


def test_phrase_stays_with_its_cue(spark):
    rows = analyse(spark, [(14, "First, let us finish the setup."), (18, "This episode is made possible by Acme.")])
    assert [r.start_s for r in rows] == [18.0]
    rows = analyse(spark, [(12, "This episode is brought to you by Acme."), (16, "Today's sponsor is Beta.")])
    assert [r.start_s for r in rows] == [12.0, 16.0] and "brought to you by" in rows[0].reason


def test_custom_and_empty_groups(spark):
    custom = [{"id": "c", "kind": S.START, "confidence": 0.8, "reason_label": "custom", "phrases": ["creator break starts here"]}]
    rows = analyse(spark, [(64, "Creator break starts here before the main topic.")], custom)
    assert rows[0].confidence == 0.8 and rows[0].start_s == 64
    assert analyse(spark, [(12, "today's sponsor is Acme")], []) == []
    off = [{**custom[0], "enabled": False}]
    assert analyse(spark, [(64, "Creator break starts here")], off) == []


def test_cue_windows_cross_blocks(spark):
    cue = cue_df(spark, [(i, f"w{i}") for i in range(11)])
    small = transcript.cue_windows(cue, 3, block=2).orderBy("cue_idx").collect()
    assert [r.window_text for r in small][:2] == ["w0 w1 w2", "w1 w2 w3"]
    assert small[-1].window_text == "w10" and small[-2].window_text == "w9 w10"


def test_hits_list_every_occurrence(spark):
    cue = cue_df(spark, [(0, "visit and visit, do not visit")])
    hits = transcript.phrase_hits(transcript.cue_windows(cue), transcript.phrase_array(DEFAULT_PHRASE_GROUPS))
    assert sorted(r.position for r in hits.collect()) == [0, 10, 24]
    assert sorted(r.position for r in transcript.drop_negated(hits).collect()) == [0, 10]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Visit https://sponsor.example/deal, then http://foo.test/path?x=1. Also https://sponsor.example/deal",
         ["https://sponsor.example/deal", "http://foo.test/path?x=1"]),
        ("Visit sponsor.example/deal or www.brand . com / creator. Try offer dot co slash start!",
         ["https://sponsor.example/deal", "https://www.brand.com/creator", "https://offer.co/start"]),
        ("Try brand.technology/offer, deals.cloud?trial=1, or xn--bcher-kva.example/promo.",
         ["https://brand.technology/offer", "https://deals.cloud/?trial=1", "https://xn--bcher-kva.example/promo"]),
        ("mail me@brand.example today", []),
        ("follow me on social", []),
    ],
)
def test_extract_links(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.extract_links(F.col("t"))).first()[0] == expected


def test_promotional_wording(spark):
    cases = {
        "Use code SAMPLE when you check out.": "promo code",
        "Get 25% off this week.": "percentage discount",
        "Visit the settings and check out the graph.": None,
        "Save 20 files before closing the editor.": None,
        "This is not sponsored by Acme.": None,
        "This is not only sponsored by Acme, it was also designed with them.": "sponsor disclosure",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, e string")
    assert df.filter(~tx.promo_text_semantic(F.col("t")).eqNullSafe(F.col("e"))).count() == 0
    urls = {
        "https://brand.example/creator-offer": "offer",
        "brand.example/path?coupon=SAMPLE": "coupon",
        "https://docs.example/guide": None,
        "https://sponsorblock.example/docs": None,
        "javascript:alert(1)": None,
    }
    df = spark.createDataFrame(list(urls.items()), "t string, e string")
    assert df.filter(~tx.promo_url_semantic(F.col("t")).eqNullSafe(F.col("e"))).count() == 0


def test_link_evidence(spark):
    cue = cue_df(spark, [
        (30, "Visit sponsor dot com slash creator to learn more."),
        (34, "Thanks for watching."),
        (38, "Visit docs.example/guide to configure the project."),
        (42, "Use code SAMPLE at https://brand.example/creator"),
        (46, "This is not sponsored by https://brand.example/creator"),
    ])
    rows = links.transcript_link_evidence(cue).orderBy("start_s").collect()
    assert [(r.start_s, r.confidence, r.raw.matched_semantic) for r in rows] == [
        (30.0, 0.58, "sponsor"), (38.0, 0.18, None), (42.0, 0.58, "promo code"), (46.0, 0.18, None),
    ]
    screen = spark.createDataFrame(
        [("v", 0, 42.0, ["Use https://brand.example/offer", "now"]), ("v", 1, 50.0, ["", None])],
        "video_id string, obs_idx int, t_s double, parts array<string>",
    )
    rows = links.screen_text_evidence(screen).collect()
    assert [(r.confidence, r.raw.text, r.raw.matched_semantic) for r in rows] == [
        (0.72, "Use https://brand.example/offer now", "offer")
    ]


def test_payloads(spark):
    cases = {
        "https://sponsor.example/offer": ("sponsor-cta", "url"),
        "sponsor.example/deal": ("sponsor-cta", "url"),
        "https://www.wikipedia.org/wiki/QR_code": ("low-signal", "url"),
        "https://x.co/y": ("low-signal", "url"),
        "USE CODE SAMPLE20": ("sponsor-cta", "promo-code"),
        "hello from the video": ("low-signal", "plain-text"),
        "HELLO": ("low-signal", "plain-text"),
        "https://sponsorblock.example/docs": ("low-signal", "url"),
    }
    data = [("v", i, float(i), v, "region-upscaled", ((10.0, 20.0), (30.0, 41.0)), 2.0, 5.0, 1.0) for i, v in enumerate(cases)]
    df = spark.createDataFrame(
        data,
        f"video_id string, obs_idx int, t_s double, value string, detector string, location {S.LOCATION}, "
        "scale double, offset_x double, offset_y double",
    )
    rows = links.qr_payload_evidence(df).orderBy("ev_idx").collect()
    assert {r.raw.value: (r.raw.signal, r.raw.payload_type) for r in rows} == cases
    assert rows[0].confidence == 0.82 and rows[2].confidence == 0.32
    assert rows[0].raw.location.top_left.x == 10.0 and rows[0].raw.location.bottom_right.y == 21.5


def qr(start, confidence=0.85, **raw):
    return {"source": S.QR_CODE, "kind": S.PRESENCE, "start_s": start, "confidence": confidence, "raw": raw or None}


def simple_bar(start, confidence=0.65, **raw):
    return {"source": S.PROGRESS_BAR, "kind": S.PRESENCE, "start_s": start, "confidence": confidence, "raw": raw or None}


def link(start, confidence, **raw):
    return {"source": S.VISIBLE_LINK, "kind": S.PRESENCE, "start_s": start, "confidence": confidence, "raw": raw or None}


def cue(kind, start, confidence):
    return {"kind": kind, "start_s": start, "confidence": confidence}


SPONSOR = {"value": "https://sponsor.example/offer", "signal": "sponsor-cta"}
GENERIC = {"value": "https://www.wikipedia.org/wiki/QR_code", "signal": "low-signal", "payload_type": "url"}
BAR_A = dict(frame_width=960.0, frame_height=540.0, track_start_x=10.0, track_end_x=800.0, y=120.0, rows=2.0, fill_ratio=0.25)
BAR_B = {**BAR_A, "y": 121.0, "fill_ratio": 0.26}


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([cue(S.START, 15, 0.85), cue(S.END, 75, 0.7)], [(15, 75, 0.778, 2)]),
        ([cue(S.START, 15, 0.65), qr(22)], [(15, 135, 0.913, 2)]),
        ([simple_bar(40)], []),
        ([cue(S.PRESENCE, 40, 0.5), cue(S.PRESENCE, 52, 0.5)], []),
        ([cue(S.PRESENCE, 40, 0.5), simple_bar(44, 0.78)], [(40, None, 0.615, 2)]),
        ([qr(40, **SPONSOR)], [(40, None, 0.425, 1)]),
        ([qr(40, **GENERIC)], []),
        ([qr(t, 0.32, **GENERIC) for t in (40, 48, 56)], [(40, None, 0.48, 3)]),
        ([qr(40, **SPONSOR), qr(44, 0.9, **SPONSOR)], [(40, None, 0.45, 1)]),
        ([simple_bar(40, **BAR_A), simple_bar(43, **BAR_B)], []),
        ([link(55, 0.72, signal="sponsor-cta", links=["https://brand.example/offer"])], [(55, None, 0.468, 1)]),
        ([link(55, 0.24, signal="low-signal")], []),
        ([cue(S.PRESENCE, 55, 0.5), link(55, 0.18, signal="low-signal", detector="transcript")], []),
        ([cue(S.START, 10, 0.9), qr(16, 0.9)], [(10, 130, 0.98, 2)]),
        ([simple_bar(40, **BAR_A), simple_bar(42, 0.62, **BAR_B), qr(45, **SPONSOR)], [(40, None, 0.75, 2)]),
        ([simple_bar(40), simple_bar(95)], []),
        ([cue(S.START, 20, 0.82), cue(S.START, 300, 0.78), simple_bar(24, 0.62)],
         [(20, 140, 0.925, 2), (300, None, 0.585, 1)]),
    ],
)
def test_fusion(spark, rows, expected):
    out = fusion.heuristic_candidates(evidence_df(spark, rows)).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.confidence, r.n_evidence) for r in out] == expected


def test_weak_candidates_stay_in_the_pool(spark):
    df = evidence_df(spark, [cue(S.START, 40, 0.2)])
    assert fusion.heuristic_candidates(df).count() == 0
    assert [(r.start_s, r.confidence) for r in fusion.candidate_pool(df).collect()] == [(40.0, 0.15)]


def greedy(times, gap=6.0):
    anchor, out = None, {}
    for t in sorted(set(times)):
        if anchor is None or t - anchor > gap:
            anchor = t
        out[t] = anchor
    return out


def test_anchor_walk_equals_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(fusion, "CHUNK_S", 20.0)
    data, want = [], {}
    for key in range(12):
        times = [round(rng.random() * 300, rng.choice([0, 1, 2])) for _ in range(rng.choice([1, 5, 60, 200]))]
        data += [(str(key), t) for t in set(times)]
        want[str(key)] = greedy(times)
    df = spark.createDataFrame(data, "k string, start_s double")
    got = fusion.cluster_anchors(df, ["k"]).collect()
    assert len(got) == len(data)
    assert all(want[r.k][r.start_s] == r.anchor_s for r in got)


def test_matching(spark):
    exp = spark.createDataFrame([("c", 0, 10.0, 60.0)], "case_id string, exp_idx int, start_s double, end_s double")
    det = spark.createDataFrame(
        [("c", 1, 10.0, 60.0), ("c", 2, 12.0, 62.0)], "case_id string, cand_idx bigint, start_s double, end_s double"
    )
    cases = spark.createDataFrame([("c", 600.0)], "case_id string, duration_s double")
    matches = evaluation.match_segments(evaluation.pair_segments(exp, det))
    metrics = evaluation.benchmark_metrics(evaluation.case_outcomes(cases, exp, det, matches), matches).first()
    assert (metrics.precision, metrics.recall, metrics.false_positives) == (0.5, 1.0, 1)
    open_det = spark.createDataFrame([("c", 1, 12.0, None)], det.schema)
    matches = evaluation.match_segments(evaluation.pair_segments(exp, open_det))
    m = evaluation.benchmark_metrics(evaluation.case_outcomes(cases, exp, open_det, matches), matches)
    row = m.first()
    assert row.closed_boundary_rate == 0 and row.boundary_mae_s is None and row.start_mae_s == 2.0
    assert "unavailable" in evaluation.benchmark_gates(m).filter("metric = 'boundary_mae_s'").first().failure


def test_matching_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    exp, det = [], []
    for c in range(6):
        for i in range(15):
            s = rng.randrange(0, 900)
            exp.append((f"c{c}", i, float(s), float(s + rng.randrange(10, 200))))
            s = rng.randrange(0, 900)
            det.append((f"c{c}", i, float(s), None if i % 5 == 0 else float(s + rng.randrange(10, 200))))
    want = set()
    for c in {r[0] for r in exp}:
        pairs = []
        for _, ei, es, ee in (r for r in exp if r[0] == c):
            for _, di, ds, de in (r for r in det if r[0] == c):
                err = abs(ds - es)
                if de is None:
                    if err <= 12:
                        pairs.append((-0.1 * (1 - err / 12), err, float("inf"), ei, ds, di))
                else:
                    iou = max(0, min(ee, de) - max(es, ds)) / (max(ee, de) - min(es, ds))
                    if iou >= 0.3:
                        pairs.append((-iou, err, abs(de - ee), ei, ds, di))
        used_e, used_d = set(), set()
        for p in sorted(pairs):
            if p[3] not in used_e and p[5] not in used_d:
                used_e.add(p[3])
                used_d.add(p[5])
                want.add((c, p[3], p[5]))
    e = spark.createDataFrame(exp, "case_id string, exp_idx int, start_s double, end_s double")
    d = spark.createDataFrame(det, "case_id string, cand_idx bigint, start_s double, end_s double")
    got = {(r.case_id, r.exp_idx, r.cand_idx) for r in evaluation.match_segments(evaluation.pair_segments(e, d)).collect()}
    assert got == want and len(want) > 20


def test_source_quality(spark):
    s = "case_id string, source string"
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], s)
    d = spark.createDataFrame([("a", "x"), ("c", "x"), ("a", "x"), ("z", "w")], s)
    rows = {r.source: r for r in evaluation.source_detection_quality(e, d).collect()}
    assert (rows["x"].recall, rows["x"].precision, rows["x"].n_missed) == (0.5, 0.5, 1)
    assert (rows["y"].recall, rows["y"].precision) == (0.0, 1.0)
    assert (rows["w"].recall, rows["w"].precision) == (1.0, 0.0)


def test_pool_equals_members(spark):
    import random

    rng = random.Random(4)
    kinds = [S.START, S.END, S.PRESENCE, S.PRESENCE, S.PRESENCE]
    rows = [
        {"video_id": f"v{rng.randrange(4)}", "ev_idx": i, "kind": rng.choice(kinds), "start_s": round(rng.random() * 300, rng.choice([0, 1, 3])), "confidence": rng.randrange(100) / 100}
        for i in range(300)
    ]
    rows += [{**qr(rng.randrange(80) / 4, 0.5, **SPONSOR), "video_id": "lone", "ev_idx": 400 + i} for i in range(30)]
    df = evidence_df(spark, rows)
    cols = ["video_id", "cand_idx", "start_s", "end_s", "confidence", "n_evidence", "seeded", "detected_end_s"]
    long_form = fusion.candidates_of(fusion.candidate_members(df)).select(*cols).collect()
    direct = fusion.candidate_pool(df).select(*cols).collect()
    assert sorted(map(str, direct)) == sorted(map(str, long_form)) and len(direct) > 40


def test_links_are_written_as_a_url_parser_writes_them(spark):
    from reelmark.functions.text import _canonical_url

    cases = {
        "https://a.example/x/../y/{id}": "https://a.example/y/%7Bid%7D",
        "HTTPS://A.Example:443": "https://a.example/",
        "http://a.example:80/./b/..": "http://a.example/",
        "https://a.example/a/b/..//c/.": "https://a.example/a//c/",
        "https://a.example/%2E%2e/q?x={y}'#`z": "https://a.example/q?x={y}%27#%60z",
        "https://a.example?q=../x": "https://a.example/?q=../x",
        "https://a.example/é^|b\\c": "https://a.example/%C3%A9%5E|b/c",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", _canonical_url(df.u).alias("c")).collect()} == cases
