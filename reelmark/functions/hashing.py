"""FNV-1a (32 bit) as a column expression, used for leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 32-bit FNV-1a offset basis and prime.
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def fnv1a(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.lit(FNV_BASIS).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(0xFFFFFFFF).cast("bigint")
        ),
    )


def group_key(video_id: Column, feedback_id: Column) -> Column:
    """Rows of one video always share a key; rows without a video stand alone."""
    has_video = video_id.isNotNull() & (video_id != "")
    return F.when(has_video, F.concat(F.lit("video:"), video_id)).otherwise(
        F.concat(F.lit("feedback:"), feedback_id)
    )


def is_holdout(key: Column) -> Column:
    return fnv1a(key) % 5 == 0
