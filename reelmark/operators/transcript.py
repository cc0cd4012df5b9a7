"""Evidence from caption text: configured phrase groups searched in cue windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordered, text as tx
from ..sources.schemas import TRANSCRIPT, raw

PHRASE_ARRAY = (
    "array<struct<group_ord:int,phrase_ord:int,group_id:string,kind:string,confidence:double,"
    "reason_label:string,phrase:string,norm:string>>"
)
CUE_BLOCK = 4096


def phrase_array(groups: list[dict]) -> Column:
    """Literal phrase list in configuration order; disabled groups are left out."""
    rows = [
        (g, p, group["id"], group["kind"], float(group["confidence"]), group["reason_label"], phrase)
        for g, group in enumerate(groups)
        if group.get("enabled") is not False
        for p, phrase in enumerate(group["phrases"])
    ]
    if not rows:
        return F.array().cast(PHRASE_ARRAY)
    names = ["group_ord", "phrase_ord", "group_id", "kind", "confidence", "reason_label", "phrase"]
    items = []
    for row in rows:
        fields = [F.lit(v).alias(n) for n, v in zip(names, row)]
        items.append(F.struct(*fields, F.lit(tx.normalize_phrase(row[-1])).alias("norm")))
    return F.array(*items).cast(PHRASE_ARRAY)


def phrase_table_to_arrays(phrase: DataFrame) -> DataFrame:
    """One row per configuration with its phrase list (the size of one configuration document)."""
    item = F.struct(
        "group_ord", "phrase_ord", "group_id", "kind", "confidence", "reason_label", "phrase",
        tx.normalize_text(F.col("phrase")).alias("norm"),
    )
    return (
        phrase.filter(F.coalesce("enabled", F.lit(True)))
        .groupBy("config_id")
        .agg(F.array_sort(F.collect_list(item)).cast(PHRASE_ARRAY).alias("phrases"))
    )


def cue_windows(cue: DataFrame, n: int = 2, nfkc: bool = True, block: int = CUE_BLOCK) -> DataFrame:
    """Each cue with the normalized text of itself and the next ``n - 1`` cues."""
    df = cue.withColumn("window_text", F.col("text"))
    for _ in range(max(1, int(n)) - 1):
        df = ordered.next_in_order(
            df, ["video_id"], "cue_idx", F.floor(F.col("cue_idx") / block), F.col("window_text"), "_following"
        )
        df = df.withColumn("window_text", F.concat_ws(" ", "text", "_following")).drop("_following")
    return df.withColumn("window_text", tx.normalize_text(F.col("window_text"), nfkc)).withColumn(
        "cur_len", F.length(tx.normalize_text(F.col("text"), nfkc))
    )


def _positions(window_text: Column, norm: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of a phrase."""
    quoted = F.concat(F.lit(r"\Q"), norm, F.lit(r"\E"))
    edge = F.lit(tx.WORD_EDGE)
    pattern = F.when(norm.contains(" "), quoted).otherwise(F.concat(edge, quoted, edge))
    parts = F.split(window_text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    walked = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        start,
        lambda acc, part: F.struct(
            (acc["at"] + F.length(part) + F.length(norm)).alias("at"),
            F.array_append(acc["seen"], acc["at"] + F.length(part)).alias("seen"),
        ),
    )
    return walked["seen"]


def _kept_positions(window_text: Column, cur_len: Column, norm: Column) -> Column:
    return F.filter(_positions(window_text, norm), lambda at: (at < cur_len) & ~tx.is_negated(window_text, at))


def phrase_hits(windows: DataFrame, phrases: Column | str = "phrases") -> DataFrame:
    """One row per occurrence of a phrase that starts inside the current cue (negated ones included)."""
    phrases = F.col(phrases) if isinstance(phrases, str) else phrases
    text = F.col("window_text")
    near = windows.withColumn("p", F.explode(F.filter(phrases, lambda p: (p["norm"] != "") & text.contains(p["norm"]))))
    hit = near.withColumn("position", F.explode(_positions(text, F.col("p.norm"))))
    return hit.filter("position < cur_len").select("*", "p.*").drop("p")


def drop_negated(hit: DataFrame) -> DataFrame:
    return hit.filter(~tx.is_negated(F.col("window_text"), F.col("position")))


def transcript_evidence(
    cue: DataFrame, phrases: Column | DataFrame, n: int = 2, nfkc: bool = True
) -> DataFrame:
    """At most one evidence row per cue: the first phrase in configuration order with a surviving hit.

    ``phrases`` is a literal list (one configuration for all cues) or a table with one list per
    ``config_id``, which the cues then carry as well. Nothing is shuffled besides the cue windows.
    """
    windows = cue_windows(cue, n, nfkc)
    if isinstance(phrases, DataFrame):
        windows = windows.join(phrases, "config_id")
        phrases = F.col("phrases")
    text, length = F.col("window_text"), F.col("cur_len")
    present = F.filter(phrases, lambda p: (p["norm"] != "") & text.contains(p["norm"]))
    surviving = F.filter(present, lambda p: F.size(_kept_positions(text, length, p["norm"])) > 0)
    # A generator is evaluated once per cue; a plain column would be repeated for each of its uses.
    hit = windows.withColumn("m", F.explode(F.slice(surviving, 1, 1)))
    return hit.select(
        "video_id",
        F.col("cue_idx").cast("bigint").alias("ev_idx"),
        F.lit(TRANSCRIPT).alias("source"),
        F.col("m.kind").alias("kind"),
        "start_s",
        (F.col("start_s") + F.col("dur_s")).alias("end_s"),
        F.col("m.confidence").alias("confidence"),
        F.concat("m.reason_label", F.lit(': "'), "m.phrase", F.lit('".')).alias("reason"),
        raw(
            text=F.col("text"),
            phrase=F.col("m.phrase"),
            phrase_group_id=F.col("m.group_id"),
            context_text=F.col("window_text"),
        ).alias("raw"),
    )
