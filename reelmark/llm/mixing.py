"""Mixing sources to target weights by entropy balancing.

Each document gets the rate at which the mix takes it. Among all rates that meet the token targets of
the groups, the wanted ones are closest to the base rates in relative entropy over tokens, at most
``cap`` times a document. Their convex dual has one variable for each group; a document's rate is
``min(cap, exp(sum of its groups' variables))``. Newton steps solve the dual: each step sums the tokens
and the slope of every group over the cells of the corpus (one row for each combination of groups and
document size), which are counted once. Rates then become whole copies:
a cell's copies follow the running sum of rates, the words still missing or left over in a group are made
up from its shortest documents, and a cell's copies are dealt evenly to its documents in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import settle
from .texts import n_words, nested

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words (0 for null) and ``tie``, a hash that orders equal documents."""
    return docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("tie"),
    )


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target``: repeating weights by code point of the source, null last.

    Targets add up to ``share`` of all words. A target above ``cap`` times its source stops there, and the
    excess goes to the others by weight: each target is the smaller of its limit and one common level
    times the weight. The level follows from running sums over the sources in the order in which they reach
    their limits. One row for each source; its count, not that of documents, bounds the ordered steps.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))
    weighted = weighted.withColumn("limit", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source")
    all_rows = Window.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(all_rows)
        - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = weighted.withColumn("level", level)
    # Up to the first source whose limit the level does not reach, sources stop at their limits.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(all_rows)
    common = F.coalesce(free["level"], F.lit(math.inf))
    return levels.select("source", "source_size", F.least("limit", common * F.col("weight")).alias("target"))


def dual_rates(cells: DataFrame, targets: dict[str, DataFrame], cap: float = CAP, rounds: int = 40) -> DataFrame:
    """``cells`` with ``rate``: the solution of the dual for one or more kinds of groups.

    ``cells`` has the group columns, ``size`` and ``n`` documents. ``targets`` gives for each group column a
    table of that column and its ``target`` in words; the groups of a kind part the corpus. Kinds take turns;
    within a kind the variables do not touch each other, so a Newton step divides by the slope alone.
    The driver sees one number for each step: the largest relative error.
    """
    kinds = list(targets)
    duals = {k: settle(targets[k].select(F.col(k).alias("g"), "target", F.lit(0.0).alias("dual"))) for k in kinds}
    # Rates depend on the groups only, so steps sum over combinations of groups.
    sums = settle(cells.groupBy(*kinds).agg(F.sum(F.col("n") * F.col("size")).alias("words")))

    def rated(rows: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for k in kinds:
            d = duals[k].select(F.col("g").alias(f"g_{k}"), F.col("dual").alias(f"dual_{k}"))
            rows = rows.join(d, F.col(k).eqNullSafe(F.col(f"g_{k}")), "left").drop(f"g_{k}")
            total = total + F.coalesce(f"dual_{k}", F.lit(0.0))
        rows = rows.withColumn("log_rate", total).withColumn("rate", F.least(F.lit(cap), F.exp("log_rate")))
        return rows.drop(*[f"dual_{k}" for k in kinds])

    for _ in range(rounds):
        worst = 0.0
        for k in kinds:
            # Where all of a group is beyond the cap, its variable first goes back to where the cap begins.
            back = F.greatest(F.min("log_rate").over(Window.partitionBy(k)) - math.log(cap), F.lit(0.0))
            words = F.col("words") * F.col("rate")
            group = rated(sums).withColumn("back", back).groupBy(F.col(k).alias("sg")).agg(
                F.max("back").alias("back"), F.sum(words).alias("taken"),
                F.sum(F.when(F.col("log_rate") - F.col("back") <= math.log(cap) + 1e-12, words)).alias("slope"),
            )
            gap = F.col("target") - F.col("taken")
            step = F.when(F.col("slope") > 0, F.least(F.lit(1.0), gap / F.col("slope")) - F.col("back"))
            moved = duals[k].join(group, F.col("g").eqNullSafe(F.col("sg")), "left").select(
                "g", "target", (F.col("dual") + F.coalesce(step, F.lit(0.0))).alias("dual"),
                F.coalesce(F.abs(gap) / F.greatest("target", F.lit(1.0)), F.lit(0.0)).alias("error"),
            )
            done = settle(moved)
            duals[k] = done.drop("error")
            worst = max(worst, done.agg(F.max("error")).first()[0] or 0.0)
        if worst < 1e-9:
            break
    return rated(cells).drop("log_rate")


def cell_copies(rated: DataFrame, group: str, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``rated`` cells with ``copies``: whole copies of a cell's documents, near ``target`` for each group.

    Ordered steps run over the distinct sizes of a group, never over its documents.
    """
    order = [c for c in rated.columns if c not in ("n", "rate", "size")]
    down = Window.partitionBy(group).orderBy(F.desc("size"), *order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.col("n") * F.col("rate")
    upto = F.sum(wanted).over(down)
    first = rated.withColumn("copies", (F.floor(upto + 0.5) - F.floor(upto - wanted + 0.5)).cast("long"))
    t = targets.select(F.col(group).alias("tg"), "target")
    first = first.join(t, F.col(group).eqNullSafe(F.col("tg")), "left").drop("tg")
    whole = Window.partitionBy(group)
    gap = F.coalesce("target", F.lit(0.0)) - F.sum(F.col("copies") * F.col("size")).over(whole)
    spare = F.when(F.col("gap") > 0, F.floor(F.col("n") * F.lit(cap)).cast("long") - F.col("copies")).otherwise(F.col("copies"))
    up = Window.partitionBy(group).orderBy("size", *order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("spare") * F.col("size")).over(up), F.lit(0))
    room = F.floor((F.abs("gap") - before) / F.col("size")).cast("long")
    more = F.greatest(F.lit(0), F.least("spare", room)) * F.signum("gap").cast("long")
    adjusted = first.withColumn("gap", gap).withColumn("spare", spare)
    return adjusted.withColumn("copies", F.col("copies") + F.when(F.col("size") > 0, more).otherwise(0)).drop("gap", "spare", "target")


def deal(docs: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with ``copies``: the copies of a cell, spread evenly over its documents in hash order.

    A cell may hold most of the corpus, so ranks come in two levels: hash blocks of the cell, and rows of a block.
    """
    block = F.pmod(F.col("tie"), F.lit(256))
    rows = docs.withColumn("_block", block)
    place = Window.partitionBy(*keys, "_block").orderBy("tie", "doc_id")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_in"))
    c = cells.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "n", "rate", F.col("copies").alias("_copies"))
    same_cell = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    starts = counts.withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0))).join(c, same_cell)
    s = starts.select(*[F.col(f"_c_{k}") for k in keys], F.col("_block").alias("_c_block"), "_start", "n", "rate", "_copies")
    rows = rows.withColumn("_rank", F.row_number().over(place))
    out = rows.join(s, [*same_cell, F.col("_block") == F.col("_c_block")], "left")
    rank = F.col("_start") + F.col("_rank")
    share = lambda r: F.expr(f"({r}) * _copies div n")
    out = out.withColumn("_upto", rank)
    out = out.withColumn("copies", F.coalesce(share("_upto") - share("_upto - 1"), F.lit(0)).cast("long"))
    return out.drop("_block", "_rank", "_start", "_upto", "_copies", "n", "_c_block", *[f"_c_{k}" for k in keys])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows of ``docs`` (``doc_id, source, size, tie`` and any others) with ``source_size, target, rate, copies``.

    Empty and null texts have size 0 and are never taken. A null source is a source of its own. Ties and
    repeated rows are ordered by hash and may get different copies; the same input gives the same copies.
    An empty table gives an empty result. Column names ``n``, ``rate``, ``copies`` and those starting with an
    underscore are used here; put clashing ones into a struct.
    """
    cells = settle(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = settle(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap))
    rated = dual_rates(cells.filter("size > 0"), {"source": targets}, cap)
    copies = settle(cell_copies(rated, "source", targets, cap))
    out = deal(docs, copies, ["source", "size"])
    t = targets.select(F.col("source").alias("_t_source"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("_t_source")), "left").drop("_t_source")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = settle(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def with_copies(docs: DataFrame, taken: DataFrame, name: str = "copies") -> DataFrame:
    """The rows of ``docs`` in ``taken`` (``doc_id, tie, copies``) with ``name``; equal rows become one.

    ``taken`` has one row for each id and text, with the copies of all its rows together.
    """
    name = name if name not in docs.columns else f"{name}_taken"
    rows = nested(docs).withColumn("tie", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    t = taken.select(F.col("doc_id").alias("t_doc"), F.col("tie").alias("t_tie"), F.col("copies").alias("t_copies"))
    joined = rows.join(t, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("tie") == F.col("t_tie")))
    one = joined.dropDuplicates(["doc_id", "tie"])
    return one.select(*[F.col(f"doc.`{c}`") for c in docs.columns], F.col("t_copies").alias(name))
