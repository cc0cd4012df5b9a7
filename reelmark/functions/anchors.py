"""Anchors at least a gap apart on a timeline, found without walking it.

From an anchor the next one is the first position beyond the gap. Positions and these successors form a graph, and the
anchors are what can be reached from sure anchors. The timeline is cut into cells a little wider than the gap (so that
rounding does no harm): the first position after an empty cell is a sure anchor, so only runs of neighbouring cells with
positions have edges, and an edge leads no further than two cells. Marks spread along the edges in doubled steps, one, two, four and so on, so rounds grow with the
logarithm of the longest run. All joins are by position or by cell, so one long key is spread over tasks; they are merge joins,
as positions compress well and Spark, which goes by the bytes of files, would send millions of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import settle

WIDER = 1 + 1e-9


def _reach(at: Column, gap: float, inclusive: bool) -> Column:
    """From ``at``: the first double at least the gap away, or the last one not more than the gap away."""
    # The doubles around the sum: half a unit in the last place per step.
    near = [(at + gap) + (at + gap) * (k * 2.0**-53) for k in range(-4, 5)]
    if inclusive:
        return F.least(*[F.when(t - at >= gap, t) for t in near])
    return F.greatest(*[F.when(t - at <= gap, t) for t in near])


def reached(starts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The ``spot`` of each start and of all that edges ``spot, next`` lead to from there, each once.

    A spot has one edge at most, and no two starts lead to one spot. A round goes one, two and three edges on from all
    that is marked, then puts four edges together into one.
    """

    def gone(spots: DataFrame) -> DataFrame:
        return spots.join(edges.hint("merge"), [*keys, "spot"]).select(*keys, F.col("next").alias("spot"))

    def doubled(edges: DataFrame) -> DataFrame:
        second = edges.select(*keys, F.col("spot").alias("next"), F.col("next").alias("far"))
        return edges.join(second.hint("merge"), [*keys, "next"]).select(*keys, "spot", F.col("far").alias("next"))

    spots = starts
    while not edges.isEmpty():
        one = gone(spots)
        two = gone(one)
        spots = spots.unionByName(settle(one.unionByName(two).unionByName(gone(two))))
        edges = settle(doubled(doubled(edges)))
    return spots


def spaced_anchors(positions: DataFrame, keys: list[str], at: str, gap: float, inclusive: bool = False) -> DataFrame:
    """``keys, at, anchor`` for each distinct position.

    The first position of a key is an anchor, and so is each first position more than ``gap`` (``inclusive``: at least
    ``gap``) after an anchor; others belong to the last anchor before them.
    """
    place = [*keys, "cell"]

    def cell(t: str) -> Column:
        return F.floor(F.col(t) / (gap * WIDER))

    spot = settle(positions.select(*keys, F.col(at).alias("t")).distinct().withColumn("cell", cell("t")))
    cells = spot.groupBy(*place).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    after = cells.select(*keys, (F.col("cell") + 1).alias("cell"), F.lit(True).alias("follows"))
    cells = settle(cells.join(after.hint("merge"), place, "left"))
    heads = cells.filter("follows is null").select(*keys, F.col("first").alias("spot"))

    asked = spot.select(*keys, F.col("t").alias("spot"), F.col("cell").alias("own"), _reach(F.col("t"), gap, inclusive).alias("t"))
    asked = asked.withColumn("cell", cell("t"))
    # As cells are wider than the gap, the reach may end in the own cell: often beyond all that it holds.
    short = asked.filter("cell = own").join(cells.select(*place, "last").hint("merge"), place)
    short = short.withColumn("cell", F.when(F.col("t") <= F.col("last"), F.col("cell")).otherwise(F.col("cell") + 1)).drop("last")
    met = asked.filter("cell > own").unionByName(short).join(cells.select(*place, "follows").hint("merge"), place)
    # What follows in a cell after an empty one, but for the own cell, is a sure anchor and needs no edge.
    asked = settle(met.filter("follows or own = cell").select(*place, "t", "spot"))
    held = spot.join(asked.select(*place).distinct().hint("merge"), place, "left_semi")
    # Downwards; a position counts for a question at the same place only if the gap itself is enough.
    line = held.select(*place, "t", F.lit(1).alias("side"), F.lit(None).cast("double").alias("spot"), F.col("t").alias("hit")).unionByName(
        asked.select(*place, "t", F.lit(2 if inclusive else 0).alias("side"), "spot", F.lit(None).cast("double").alias("hit"))
    )
    down = Window.partitionBy(*place).orderBy(F.col("t").desc(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = line.withColumn("here", F.last("hit", ignorenulls=True).over(down)).filter("spot is not null")
    there = cells.select(*keys, (F.col("cell") - 1).alias("cell"), F.col("first").alias("there"))
    following = here.join(there.hint("merge"), place, "left").select(*keys, "spot", F.coalesce("here", "there").alias("next"))
    edges = settle(following.filter("next is not null"))

    anchor = reached(heads, edges, keys).select(*keys, F.col("spot").alias("anchor"))
    # The anchor of a position is not further than the gap: in its own cell or the one before (or, rounded, one more).
    near = anchor.select(*keys, "anchor", F.explode(F.sequence(cell("anchor"), cell("anchor") + 2)).alias("cell"))
    met = spot.join(near.hint("merge"), place).filter("anchor <= t")
    return met.groupBy(*keys, F.col("t").alias(at)).agg(F.max("anchor").alias("anchor"))
