"""Evidence from links in captions and on screen, and from decoded codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.numbers import js_round
from ..functions.once import computed_if
from ..sources.schemas import PRESENCE, QR_CODE, VISIBLE_LINK, raw

# Fixed values (must match for right results).
FRAME_LINK_CONFIDENCE = {"sponsor-cta": 0.72, "low-signal": 0.24}
CAPTION_LINK_CONFIDENCE = {"sponsor-cta": 0.58, "low-signal": 0.18}
QR_CONFIDENCE = {"native": 0.9, "direct": 0.85, "upscaled": 0.82, "low-signal": 0.32}
LINK_REASONS = {
    "sponsor-cta": "Detected sponsor-like link in video text.",
    "low-signal": "Detected URL in video text, but it has no promotional semantics.",
}
QR_REASONS = {
    "sponsor-cta": "Detected sponsor-like QR code in sampled video frame.",
    "low-signal": "Detected QR code in sampled video frame, but decoded payload is low-signal.",
}
PROMO_PAYLOAD_WORD = r"\b(?:USE\s+)?(?:CODE|COUPON|PROMO|DISCOUNT|SAVE)\b"
PROMO_PAYLOAD_TOKEN = r"\b[A-Z0-9]{4,16}\b"
PROMO_PAYLOAD_HINT = r"(?:%|\$|OFF|SAVE|DEAL|GIFT|FREE)"
MAX_PROMO_PAYLOAD = 80


def classify_link_context(text: Column, links: Column, nfkc: bool = True) -> Column:
    """Struct ``signal, matched_semantic, reason``: URL tokens first, then the wording around them."""
    found = F.filter(F.transform(links, tx.promo_url_semantic), lambda s: s.isNotNull())
    from_url = F.try_element_at(found, F.lit(1))
    from_text = tx.promo_text_semantic(text, nfkc)
    semantic = F.coalesce(from_url, from_text)
    return F.struct(
        F.when(semantic.isNotNull(), F.lit("sponsor-cta")).otherwise(F.lit("low-signal")).alias("signal"),
        semantic.alias("matched_semantic"),
        F.when(from_url.isNotNull(), F.concat(F.lit('URL contains promotional semantic "'), from_url, F.lit('"')))
        .when(
            from_text.isNotNull(),
            F.concat(F.lit('surrounding text contains promotional semantic "'), from_text, F.lit('"')),
        )
        .otherwise(F.lit("URL and surrounding text contain no promotional semantics"))
        .alias("reason"),
    )


def _link_evidence(df: DataFrame, confidence: dict[str, float], detector: str, nfkc: bool) -> DataFrame:
    linked = computed_if(df, "links", tx.extract_links(F.col("text")), lambda found: F.size(found) > 0)
    scored = linked.withColumn("c", classify_link_context(F.col("text"), F.col("links"), nfkc))
    sponsor = F.col("c.signal") == "sponsor-cta"

    def choose(options: dict) -> Column:
        return F.when(sponsor, F.lit(options["sponsor-cta"])).otherwise(F.lit(options["low-signal"]))

    return scored.select(
        "video_id",
        "ev_idx",
        F.lit(VISIBLE_LINK).alias("source"),
        F.lit(PRESENCE).alias("kind"),
        "start_s",
        F.lit(None).cast("double").alias("end_s"),
        choose(confidence).alias("confidence"),
        choose(LINK_REASONS).alias("reason"),
        raw(
            links=F.col("links"),
            text=F.col("text"),
            signal=F.col("c.signal"),
            matched_semantic=F.col("c.matched_semantic"),
            classification_reason=F.col("c.reason"),
            detector=F.lit(detector),
        ).alias("raw"),
    )


def transcript_link_evidence(cue: DataFrame, nfkc: bool = True) -> DataFrame:
    rows = cue.withColumn("ev_idx", F.col("cue_idx").cast("bigint"))
    return _link_evidence(rows, CAPTION_LINK_CONFIDENCE, "transcript", nfkc)


def screen_text_evidence(observed: DataFrame, nfkc: bool = True) -> DataFrame:
    """``observed``: ``video_id, obs_idx, t_s, parts`` with the recognised strings of a frame."""
    rows = observed.select(
        "video_id",
        F.col("obs_idx").cast("bigint").alias("ev_idx"),
        F.col("t_s").alias("start_s"),
        F.array_join(F.filter("parts", lambda p: p.isNotNull() & (p != "")), " ").alias("text"),
    )
    return _link_evidence(rows, FRAME_LINK_CONFIDENCE, "TextDetector", nfkc)


def classify_payload(value: Column) -> Column:
    """Struct ``signal, payload_type, reason`` of a decoded code."""
    norm = F.trim(value)
    upper = F.upper(norm)
    url = tx.is_url_like(norm)
    token = tx.promo_url_semantic(norm)
    promo = (
        (norm != "")
        & (F.length(norm) <= MAX_PROMO_PAYLOAD)
        & (
            upper.rlike(tx.java_pattern(PROMO_PAYLOAD_WORD))
            | (upper.rlike(tx.java_pattern(PROMO_PAYLOAD_TOKEN)) & upper.rlike(PROMO_PAYLOAD_HINT))
        )
    )
    sponsor = F.when(url, token.isNotNull()).otherwise(promo)
    return F.struct(
        F.when(sponsor, F.lit("sponsor-cta")).otherwise(F.lit("low-signal")).alias("signal"),
        F.when(url, F.lit("url")).when(promo, F.lit("promo-code")).otherwise(F.lit("plain-text")).alias("payload_type"),
        F.when(
            url & token.isNotNull(), F.concat(F.lit("decoded URL contains sponsor CTA semantics ("), token, F.lit(")"))
        )
        .when(url, F.lit("decoded payload is a generic URL without sponsor CTA semantics"))
        .when(promo, F.lit("decoded payload looks like a promo code or coupon CTA"))
        .otherwise(F.lit("decoded payload is plain text without a URL or promo CTA"))
        .alias("reason"),
    )


def _placed(point: Column) -> Column:
    scale = F.coalesce(F.col("scale"), F.lit(1.0))
    return F.struct(
        js_round(point["x"] / scale + F.coalesce(F.col("offset_x"), F.lit(0.0)), 2).alias("x"),
        js_round(point["y"] / scale + F.coalesce(F.col("offset_y"), F.lit(0.0)), 2).alias("y"),
    )


def qr_payload_evidence(observed: DataFrame) -> DataFrame:
    """``observed``: ``video_id, obs_idx, t_s, value, detector, location, scale, offset_x, offset_y``.

    ``detector`` is ``native``, ``direct``, ``region``, ``upscaled`` or ``region-upscaled``.
    """
    c = observed.filter(F.coalesce("value", F.lit("")) != "").withColumn("c", classify_payload(F.col("value")))
    confidence = (
        F.when(F.col("c.signal") != "sponsor-cta", F.lit(QR_CONFIDENCE["low-signal"]))
        .when(F.col("detector") == "native", F.lit(QR_CONFIDENCE["native"]))
        .when(F.col("detector").contains("upscaled"), F.lit(QR_CONFIDENCE["upscaled"]))
        .otherwise(F.lit(QR_CONFIDENCE["direct"]))
    )
    place = F.when(
        F.col("location").isNotNull() & (F.col("detector") != "native"),
        F.struct(
            _placed(F.col("location.top_left")).alias("top_left"),
            _placed(F.col("location.bottom_right")).alias("bottom_right"),
        ),
    )
    return c.select(
        "video_id",
        F.col("obs_idx").cast("bigint").alias("ev_idx"),
        F.lit(QR_CODE).alias("source"),
        F.lit(PRESENCE).alias("kind"),
        F.col("t_s").alias("start_s"),
        F.lit(None).cast("double").alias("end_s"),
        confidence.alias("confidence"),
        F.when(F.col("c.signal") == "sponsor-cta", F.lit(QR_REASONS["sponsor-cta"]))
        .otherwise(F.lit(QR_REASONS["low-signal"]))
        .alias("reason"),
        raw(
            value=F.col("value"),
            detector=F.col("detector"),
            signal=F.col("c.signal"),
            payload_type=F.col("c.payload_type"),
            classification_reason=F.col("c.reason"),
            location=place,
        ).alias("raw"),
    )


def combine_evidence(*parts: DataFrame) -> DataFrame:
    """Appends evidence lists; the order of the parts decides between equal start positions."""
    out = None
    for i, part in enumerate(parts):
        shifted = part.withColumn("ev_idx", F.col("ev_idx") + F.lit(i * (1 << 40)))
        out = shifted if out is None else out.unionByName(shifted)
    return out
