"""The features of a whole candidate pool, without a row for each candidate and evidence row.

A seeded candidate is its start cue, all presence rows within twenty seconds and at most one end cue. All windows are of
one length, so what their presence rows add up to comes from ``functions/around.py``; only the two cues are looked at
per candidate. Phrases count in the text of a candidate in order, so they may also run over rows:

* found in one row: a bit of the row's mask, and the window takes the union of the masks;
* running over presence rows: a row for each such run, counted by window like the rest, less the runs that a cue of
  the candidate falls into;
* at a cue: searched in the cue's text with its nearest presence rows, as many as the longest phrase can reach.

Candidates of videos without a start cue share no rows; they are summed up from their members.

All joins are merge joins: a candidate adds few bytes to a file, and Spark, which goes by these, would broadcast millions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.around import around, cell_of
from ..functions.tables import settle
from ..sources.defaults import CALL_TO_ACTION_FEATURE_PHRASES, SPONSOR_FEATURE_PHRASES
from ..sources.schemas import PRESENCE
from . import features as ft, fusion
from .fusion import CAND

WIDTH_S = 2 * fusion.PRESENCE_WINDOW_S
REACH = ft.MAX_PHRASE_WORDS - 1
PHRASES = [("s", tx.normalize_phrase(p)) for p in SPONSOR_FEATURE_PHRASES] + [
    ("c", tx.normalize_phrase(p)) for p in CALL_TO_ACTION_FEATURE_PHRASES
]
OF_KIND = {k: sum(1 << i for i, (of, _) in enumerate(PHRASES) if of == k) for k in "sc"}
_AT = ["video_id", "seed_s"]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def _mask(text: Column, words: bool = True) -> Column:
    """The phrases that lie within the one text, a bit each; ``words`` also takes those of one word."""
    out = F.lit(0).cast("bigint")
    for i, (_, p) in enumerate(PHRASES):
        if " " in p or words:
            hit = text.contains(p) if " " in p else text.rlike(tx.java_pattern(r"\b" + p + r"\b"))
            out = out + F.when(hit, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return out


def _brief(text: Column) -> Column:
    """A text of bounded length in which a phrase that reaches over its start or end is still found."""
    n = ft.MAX_PHRASE_CHARS
    cut = F.concat(F.substring(text, 1, n), F.lit("\n"), text.substr(F.length(text) - n + 1, F.lit(n)))
    return F.when(F.length(text) > 2 * n, cut).otherwise(text)


def _place(at: str = "start_s", idx: str = "ev_idx") -> Column:
    return F.struct(F.col(at).alias("s"), F.col(idx).alias("i"))


def _presence_line(presence: DataFrame) -> DataFrame:
    """Presence rows with a text, per cell, with the last rows of the cell before and the first of the cell after.

    ``ahead``: the row and those after it; ``behind``: those before it and the row, each with the runs that start there
    (``p``: phrase, ``till``: place of the last row). As many rows as the longest phrase can reach.
    """
    rows = presence.filter("part <> ''").select(
        "video_id", cell_of(F.col("start_s"), WIDTH_S).alias("cell"), _place().alias("o"), _brief(F.col("part")).alias("x")
    )
    in_cell = Window.partitionBy("video_id", "cell")
    first = rows.withColumn("_r", F.row_number().over(in_cell.orderBy("o"))).filter(F.col("_r") <= REACH)
    last = rows.withColumn("_r", F.row_number().over(in_cell.orderBy(F.col("o").desc()))).filter(F.col("_r") <= REACH)
    line = rows.withColumn("own", F.lit(True))
    for part, step in ((first, -1), (last, 1)):
        line = line.unionByName(part.select("video_id", (F.col("cell") + step).alias("cell"), "o", "x", F.lit(False).alias("own")))
    w = in_cell.orderBy("o")
    item = F.struct("o", "x")
    ahead = [F.lead(item, j).over(w) if j else item for j in range(REACH + 1)]
    line = line.withColumn("ahead", F.filter(F.array(*ahead), lambda e: e.isNotNull()))
    line = line.withColumn("_x", F.transform("ahead", lambda e: e["x"]))
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("t")) for i, (_, p) in enumerate(PHRASES) if " " in p])

    def till(p: Column) -> Column:
        """How many rows on the phrase ends, 0 if in the row itself; NULL if it is not there or needs no text of the row."""
        out = F.lit(None).cast("int")
        for j in range(REACH, 0, -1):
            reached = F.array_join(F.slice("_x", 1, j + 1), " ").contains(p["t"])
            without = F.array_join(F.slice("_x", 2, j), " ").contains(p["t"])
            out = F.when(reached, F.when(~without, F.lit(j))).otherwise(out)
        return F.when(F.col("x").contains(p["t"]), F.lit(0)).otherwise(out)

    # Most rows start no run: one look at the whole reach for each phrase tells.
    reach = F.array_join("_x", " ")
    near = F.filter(known, lambda p: reach.contains(p["t"]))
    runs = F.filter(F.transform(near, lambda p: F.struct(p["id"].alias("p"), till(p).alias("j"))), lambda r: r["j"] > 0)
    line = line.withColumn(
        "runs",
        F.transform(runs, lambda r: F.struct(r["p"].alias("p"), F.col("o").alias("since"), F.get("ahead", r["j"])["o"].alias("till"))),
    )
    full = F.struct("o", "x", "runs")
    behind = [F.lag(full, j).over(w) if j else full for j in range(REACH, -1, -1)]
    return line.select(
        "video_id", "cell", "o", "own", "runs", "ahead", F.filter(F.array(*behind), lambda e: e.isNotNull()).alias("behind")
    )


def _neighbours(line: DataFrame, cues: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """For each cue (keys, ``place``): the presence rows next to it on both sides, as far as a phrase can reach."""
    both = line.select("video_id", "cell", "o", "ahead", "behind", *[F.lit(None).cast(cues.schema[k].dataType).alias(k) for k in keys if k != "video_id"], F.lit(False).alias("asks"))
    types = {f.name: f.dataType for f in both.schema.fields}
    asks = cues.select(
        "video_id", cell_of(F.col("place.s"), WIDTH_S).alias("cell"), F.col("place").alias("o"),
        *[F.lit(None).cast(types[c]).alias(c) for c in ("ahead", "behind")], *[k for k in keys if k != "video_id"], F.lit(True).alias("asks"),
    )
    w = Window.partitionBy("video_id", "cell").orderBy("o")
    back = F.last("behind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # A running value down the order instead of a look ahead, which would start again at every row.
    down = Window.partitionBy("video_id", "cell").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, -1)
    fore = F.last("ahead", ignorenulls=True).over(down)
    out = both.unionByName(asks).select(*keys, "asks", back.alias(before), fore.alias(after)).filter("asks").drop("asks")
    return (
        out.withColumn(before, F.coalesce(before, F.array().cast(types["behind"])))
        .withColumn(before, F.slice(before, F.greatest(F.lit(1), F.size(before) - REACH + 1), F.lit(REACH)))
        .withColumn(after, F.slice(F.coalesce(after, F.array().cast(types["ahead"])), 1, REACH))
    )


def _runs_around(line: DataFrame, asked: DataFrame) -> DataFrame:
    """Per window: phrases that run over its presence rows, with the number of runs, as a map."""
    run = settle(
        line.filter("own and size(runs) > 0").select("video_id", "cell", F.explode("runs").alias("r")).select(
            "video_id", "cell", F.col("r.p").alias("p"), F.col("r.since.s").alias("from_t"), F.col("r.till.s").alias("to_t"), F.lit(1).cast("bigint").alias("n")
        )
    )
    ends = asked.withColumn("cell", cell_of(F.col("lo"), WIDTH_S))
    inside = cell_of(F.col("to_t"), WIDTH_S) == F.col("cell")
    within = run.filter(inside)
    # A window only asks for phrases that run in one of its two cells.
    there = within.select("video_id", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), "p").distinct()
    asks = ends.join(there.hint("merge"), ["video_id", "cell"]).select(*_AT, "p", "lo", "hi")
    spots = within.groupBy("video_id", "p", "from_t", "to_t").agg(F.sum("n").alias("n"))
    counted = around(spots, asks, ["video_id", "p"], "seed_s", WIDTH_S, ["n"], []).filter("n > 0").select(*_AT, "p", "n")
    # Over the border of two cells go the runs of the last few rows of a cell only.
    over = run.filter(~inside).join(ends.hint("merge"), ["video_id", "cell"]).filter("from_t >= lo and to_t <= hi").select(*_AT, "p", "n")
    return (
        counted.unionByName(over).groupBy(*_AT, "p").agg(F.sum("n").alias("n"))
        .groupBy(*_AT).agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("runs_of"))
    )


def _groups_around(presence: DataFrame, asked: DataFrame) -> DataFrame:
    """Per window: the phrase groups of its presence rows. Groups come from a configuration, so they are few."""
    seen = (
        presence.select("video_id", cell_of(F.col("start_s"), WIDTH_S).alias("cell"), "start_s", F.explode(F.array_distinct("groups")).alias("g"))
        .groupBy("video_id", "cell", "g").agg(F.min("start_s").alias("since"), F.max("start_s").alias("till"))
    )
    low = asked.withColumn("cell", cell_of(F.col("lo"), WIDTH_S)).join(seen.hint("merge"), ["video_id", "cell"]).filter("till >= lo")
    high = asked.withColumn("cell", cell_of(F.col("hi"), WIDTH_S)).join(seen.hint("merge"), ["video_id", "cell"]).filter("since <= hi")
    both = low.select(*_AT, "g").unionByName(high.select(*_AT, "g"))
    return both.groupBy(*_AT).agg(F.collect_set("g").alias("groups_near"))


def _texts(own: Column, end: Column) -> tuple[Column, Column]:
    """The texts around the start cue and around the end cue of a candidate; one text where they lie close."""
    words = lambda a: F.array_join(F.transform(a, lambda e: e["x"]), " ")

    def said(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda t: t != ""), " ")

    b1, a1, b2, a2 = (F.col(c) for c in ("b1", "a1", "b2", "a2"))
    has_end = F.col("end_x") != ""
    meets = has_end & (F.size(a1) < REACH)
    first = F.when(own == "", "").when(meets, said(words(b1), own, words(a1), end, words(a2))).otherwise(said(words(b1), own, words(a1)))
    apart = has_end & ((own == "") | ~meets)
    second = F.when(apart, said(words(b2), end, words(a2))).otherwise(F.lit(""))
    return first, second


def _seeded_features(items: DataFrame, pool: DataFrame, ends: DataFrame, video: DataFrame | None, nfkc: bool) -> DataFrame:
    sums, maxima = ft._measures()
    part = tx.normalize_text(ft.said(), nfkc)
    measured = ["video_id", "ev_idx", "start_s", *[c.alias(k) for k, c in (sums | maxima).items()]]
    texts = [part.alias("part"), ft.row_groups(F.col("raw")).alias("groups")]
    masked = lambda df: df.withColumn("mask", _mask(F.col("part")))
    seeds = fusion.seeds_of(items).select(
        *measured, *texts, fusion.edge(F.col("start_s"), -1).alias("lo"), fusion.edge(F.col("start_s"), 1).alias("hi")
    )
    seed = settle(masked(seeds))
    asked = seed.select("video_id", F.col("start_s").alias("seed_s"), "lo", "hi").distinct()
    of_seeds = items.filter(F.col("kind") == PRESENCE).join(seed.select("video_id").distinct().hint("merge"), "video_id", "left_semi")
    presence = settle(masked(of_seeds.select(*measured, *texts)))
    spots = presence.groupBy("video_id", F.col("start_s").alias("from_t"), F.col("start_s").alias("to_t")).agg(
        *[F.sum(k).cast("decimal(28,6)" if k.startswith("avg") else "bigint").alias(k) for k in sums],
        *[F.max(k).alias(k) for k in maxima],
        F.bit_or("mask").alias("mask"),
    )
    near = around(spots, asked, ["video_id"], "seed_s", WIDTH_S, list(sums), list(maxima), ("mask",))
    line = settle(_presence_line(presence))

    end = masked(ends.select("video_id", "seed_s", "end_row").select("seed_s", "end_row.*").select(*measured, "seed_s", *texts))
    end = end.select(
        *_AT, _place().alias("end_o"), F.col("part").alias("end_part"), F.col("groups").alias("end_groups"),
        *[F.col(k).alias(f"e_{k}") for k in (*sums, *maxima, "mask")],
    )
    closing = settle(end.join(asked.hint("merge"), _AT))
    latest = F.struct(F.col("hi").alias("s"), F.lit(2**63 - 1).alias("i"))
    end_side = _neighbours(line, closing.filter("end_part <> ''").select(*_AT, F.least("end_o", latest).alias("place")), _AT, "b2", "a2")
    own = seed.withColumnsRenamed({"ev_idx": "cand_idx", "start_s": "seed_s"})
    own_side = _neighbours(
        line, seed.filter("part <> ''").select("video_id", F.col("ev_idx").alias("cand_idx"), _place().alias("place")), CAND, "b1", "a1"
    )
    spans = pool.select(*CAND, F.col("end_s").alias("_end"), F.col("confidence").alias("_conf"))
    near = near.select(*_AT, *[F.col(k).alias(f"n_{k}") for k in (*sums, *maxima, "mask")])
    # By candidate first, then by place, so that rows change their order once.
    per = own.join(spans.hint("merge"), CAND).join(own_side.hint("merge"), CAND, "left")
    for part in (near, closing.drop("lo", "hi"), end_side, _runs_around(line, asked), _groups_around(presence, asked)):
        per = per.join(part.hint("merge"), _AT, "left")

    # Neighbours that belong to the candidate.
    own_o = F.struct(F.col("seed_s").alias("s"), F.col("cand_idx").alias("i"))
    end_o, lo, hi = F.col("end_o"), F.col("lo"), F.col("hi")
    spoken = F.coalesce(F.col("end_part") != "", F.lit(False))
    opens = F.col("part") != ""

    def kept(name: str, *more) -> Column:
        empty = F.array().cast(per.schema[name].dataType)
        held = lambda e: (e["o"]["s"] >= lo) & (e["o"]["s"] <= hi)
        return F.filter(F.coalesce(name, empty), lambda e: held(e) & more[0](e) if more else held(e))

    per = per.withColumns({
        "b1": kept("b1"),
        "a1": kept("a1", lambda e: ~spoken | (e["o"] < end_o)),
        "b2": kept("b2"),
        "a2": kept("a2"),
        "end_x": F.coalesce(_brief(F.col("end_part")), F.lit("")),
    })
    # Runs that a cue falls into are none.
    def broken(name: str, cue: Column) -> Column:
        return F.filter(F.flatten(F.transform(name, lambda e: e["runs"])), lambda r: (r["till"] > cue) & (r["till"]["s"] <= hi))

    per = per.withColumn("broken", F.array_union(broken("b1", own_o), broken("b2", end_o)))
    per = per.withColumn("b2", F.filter("b2", lambda e: ~opens | (e["o"] > own_o)))
    first, second = _texts(_brief(F.col("part")), F.col("end_x"))
    per = per.withColumn("_t1", first).withColumn("_t2", second)

    # A phrase runs over presence rows if more runs of it lie in the window than the cues break.
    running = F.filter(
        F.map_entries("runs_of"), lambda e: e["value"] > F.size(F.filter("broken", lambda r: r["p"] == e["key"]))
    )
    masks = [F.col("mask"), *[F.coalesce(f"{t}_mask", F.lit(0).cast("bigint")) for t in "ne"]]
    masks += [_mask(F.concat("_t1", F.lit("\n"), "_t2"), words=False)]
    masks += [F.coalesce(F.aggregate(running, F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(_bit(e["key"]))), F.lit(0).cast("bigint"))]
    found = masks[0]
    for m in masks[1:]:
        found = found.bitwiseOR(m)
    per = per.withColumn("found", found)

    def hits(kind: str) -> Column:
        return F.bit_count(F.col("found").bitwiseAND(F.lit(OF_KIND[kind]).cast("bigint"))).cast("double")

    none = F.array().cast("array<string>")
    groups = F.array_distinct(F.concat("groups", *[F.coalesce(g, none) for g in ("groups_near", "end_groups")]))
    merged = [sum((F.coalesce(F.col(f"{t}_{k}"), F.lit(0)) for t in "ne"), F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums]
    merged += [F.greatest(k, f"n_{k}", f"e_{k}").alias(k) for k in maxima]
    per = per.select(
        *CAND, F.col("seed_s").alias("_start"), "_end", "_conf", *merged,
        F.size(groups).alias("matchedPhraseGroupCount"), end_o.isNotNull().alias("nearbyEndCue"),
        hits("s").alias("sponsorPhraseHitCount"), hits("c").alias("callToActionPhraseHitCount"),
    )
    return ft._vector(ft._with_duration(per, video))


def pool_features(
    items: DataFrame,
    pool: DataFrame,
    video: DataFrame | None = None,
    nfkc: bool = True,
    parts: fusion.PoolParts | None = None,
) -> DataFrame:
    """``video_id, cand_idx`` and the 38 feature columns of each candidate of ``fusion.candidate_pool``.

    ``items`` is the coalesced evidence that the pool was made of, as a written table, and ``parts`` its ``pool_parts``.
    The rows are those that ``candidate_features`` gives from the pool's members.
    """
    parts = parts or fusion.pool_parts(items)
    clustered = fusion.clustered_members(items, parts.chains)
    rest = ft.candidate_features(pool.filter("not seeded"), clustered, None, video, nfkc)
    return _seeded_features(items, pool.filter("seeded"), parts.ends, video, nfkc).unionByName(rest)
