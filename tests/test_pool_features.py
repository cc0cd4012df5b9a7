"""Features of a pool by windows, compared with those of its members."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fixtures import evidence_df
from reelmark.functions.around import around
from reelmark.functions.tables import settle
from reelmark.operators import features as ft, fusion, pool_features as pf
from reelmark.sources import schemas as S

WORDS = ["use", "code", "made possible", "by", "thanks to our", "sponsor", "", "x" * 70 + " use"]


def random_rows(seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for i in range(420):
        kind = rng.choice([S.START, S.END, *[S.PRESENCE] * 7])
        source = S.TRANSCRIPT if kind != S.PRESENCE or rng.random() < 0.5 else rng.choice([S.QR_CODE, S.PROGRESS_BAR, S.VISIBLE_LINK])
        raw = {"text": " ".join(rng.sample(WORDS, rng.choice([0, 1, 1, 1])))}
        if rng.random() < 0.5:
            raw["phrase_group_id"] = rng.choice(["a", "b", "c", " "])
        if source == S.QR_CODE:
            raw |= {"value": rng.choice(["u", "v"]), "location": ((1.0, 2.0), (rng.choice([0.0, 9.5]), 8.0))}
        if source == S.PROGRESS_BAR:
            raw |= {"start_x": 2.0, "end_x": rng.choice([1.0, 90.0]), "y": rng.random() * 9, "rows": 3.0}
        rows.append({
            "video_id": f"v{rng.randrange(4)}", "ev_idx": i, "kind": kind, "source": source, "raw": raw, "reason": "",
            "start_s": float(round(rng.random() * 260, rng.choice([0, 0, 1, 3]))), "confidence": rng.randrange(100) / 100,
        })
    rows += [
        {"video_id": "lone", "ev_idx": 500 + i, "kind": S.PRESENCE, "source": S.QR_CODE, "start_s": float(i // 2), "confidence": 0.5, "reason": "", "raw": {"value": str(i), "signal": "sponsor-cta"}}
        for i in range(9)
    ]
    return rows


def test_pool_features_equal_those_of_members(spark):
    items = settle(fusion.coalesce_frames(evidence_df(spark, random_rows(3))))
    pool = settle(fusion.candidate_pool(items, coalesced=True))
    member = settle(fusion.candidate_members(items, coalesced=True))
    want = {tuple(r[:2]): r.asDict() for r in ft.candidate_features(pool, member, None, None).collect()}
    got = {tuple(r[:2]): r.asDict() for r in pf.pool_features(items, pool).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    wrong = [(k, f, got[k][f], want[k][f]) for k in want for f in want[k] if got[k][f] != want[k][f]]
    assert wrong == []
    assert len({r["callToActionPhraseHitCount"] for r in want.values()}) > 1 and len({r["sponsorPhraseHitCount"] for r in want.values()}) > 1
    primary = {tuple(r[:2]): r.primary_source for r in _primary(pool, member)}
    assert {tuple(r[:2]): r.primary_source for r in _primary(pool, fusion.boundary_members(items))} == primary


def _primary(pool, member):
    from reelmark.operators import scoring

    return scoring.primary_source(pool, member).select(*fusion.CAND, "primary_source").collect()


def test_windows_of_one_length(spark):
    rng = random.Random(1)
    spots = [("k", float(rng.randrange(-50, 300)), rng.randrange(9)) for _ in range(200)]
    asked = [("k", t, t - 20.0, t + 20.0) for t in {float(rng.randrange(-60, 320)) for _ in range(60)}]
    s = spark.createDataFrame(spots, "k string, from_t double, v long").withColumn("to_t", F.col("from_t")).withColumn("m", F.col("v"))
    a = spark.createDataFrame(asked, "k string, at double, lo double, hi double")
    got = {r["at"]: (r.v, r.m) for r in around(s, a, ["k"], "at", 40.0, ["v"], ["m"]).collect()}
    for _, t, lo, hi in asked:
        near = [v for _, x, v in spots if lo <= x <= hi]
        assert got[t] == ((sum(near), max(near)) if near else (None, None))


def test_many_seeds_and_rows_of_one_moment(spark):
    """20,000 start cues with 20,000 presence rows around them: 4 x 10^8 pairs, were they made."""
    base = spark.range(40_000).select(
        F.lit("v").alias("video_id"), F.col("id").alias("ev_idx"), F.lit(S.TRANSCRIPT).alias("source"),
        F.when(F.col("id") % 2 == 0, S.START).otherwise(S.PRESENCE).alias("kind"), (F.lit(100.0) + F.col("id") % 4).alias("start_s"),
        F.lit(None).cast("double").alias("end_s"), F.lit(0.5).alias("confidence"), F.lit("use code").alias("reason"), F.lit(None).cast(S.RAW).alias("raw"),
    )
    items = settle(base)
    out = pf.pool_features(items, settle(fusion.candidate_pool(items, coalesced=True)), nfkc=False)
    row = out.agg(F.count("*").alias("n"), F.min("evidenceTotal").alias("a"), F.max("evidenceTotal").alias("b"), F.min("callToActionPhraseHitCount").alias("c")).first()
    assert (row.n, row.a, row.b, row.c) == (20_000, 20_001.0, 20_001.0, 1.0)
