"""Ordered computations per key that stay parallel when one key is hot.

A plain window over a key puts all rows of the key into one task. Here the key is cut
into blocks of the ordering column: each block is scanned in its own task, one row per
block is carried forward, and the two results are joined on (key, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import settle


@dataclass(frozen=True)
class Scan:
    """One exclusive prefix value: ``kind`` is ``last``, ``max`` or ``sum``."""

    name: str
    kind: str
    value: Column


def scan_before(
    df: DataFrame, keys: list[str], order: list[str], block: Column, scans: list[Scan]
) -> DataFrame:
    """Adds, for every row, each scan over the rows of its key that come before it.

    ``block`` must not decrease along ``order``.
    """
    values = {s.name: f"_v_{s.name}" for s in scans}
    df = df.withColumn("_blk", block)
    for s in scans:
        df = df.withColumn(values[s.name], s.value)

    def reduce_block(s: Scan) -> Column:
        v = F.col(values[s.name])
        if s.kind == "last":
            rank = F.when(v.isNotNull(), F.struct(*order))
            return F.max_by(v, rank).alias(s.name)
        return (F.max(v) if s.kind == "max" else F.sum(v)).alias(s.name)

    def over(s: Scan, v: Column, window) -> Column:
        if s.kind == "last":
            return F.last(v, ignorenulls=True).over(window)
        return (F.max(v) if s.kind == "max" else F.sum(v)).over(window)

    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(*before)
    outer = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(*before)
    totals = df.groupBy(*keys, "_blk").agg(*[reduce_block(s) for s in scans])
    carried = totals.select(
        *keys, "_blk", *[over(s, F.col(s.name), outer).alias(f"_c_{s.name}") for s in scans]
    )
    scanned = df.select("*", *[over(s, F.col(values[s.name]), inner).alias(f"_i_{s.name}") for s in scans])
    # Blocks are as many as the data has: kept from being broadcast.
    joined = scanned.join(carried.hint("merge"), [*keys, "_blk"], "left")
    for s in scans:
        here, there = F.col(f"_i_{s.name}"), F.col(f"_c_{s.name}")
        if s.kind == "last":
            merged = F.coalesce(here, there)
        elif s.kind == "max":
            merged = F.greatest(here, there)
        else:
            merged = F.when(here.isNull() & there.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
            )
        joined = joined.withColumn(s.name, merged)
    return joined.drop("_blk", *values.values(), *[f"_{p}_{s.name}" for p in "ic" for s in scans])


def next_in_order(
    df: DataFrame, keys: list[str], order: str, block: Column, value: Column, name: str
) -> DataFrame:
    """Adds the value of the following row of the key (NULL at the end)."""
    df = df.withColumn("_blk", block).withColumn("_val", F.struct(value.alias("x")))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    outer = Window.partitionBy(*keys).orderBy("_blk")
    heads = (
        df.groupBy(*keys, "_blk")
        .agg(F.min_by("_val", order).alias("_head"))
        .select(*keys, "_blk", F.lead("_head").over(outer).alias("_next_head"))
    )
    return (
        df.withColumn("_next", F.lead("_val").over(inner))
        .join(heads, [*keys, "_blk"], "left")
        .withColumn(name, F.coalesce("_next", "_next_head")["x"])
        .drop("_blk", "_val", "_next", "_next_head")
    )


def islands(
    df: DataFrame, keys: list[str], order: list[str], block: Column, starts: Column, label: Column, name: str
) -> DataFrame:
    """Labels each row with ``label`` of the latest row up to it for which ``starts`` holds.

    The scan reads its input twice, and that input mostly comes from another scan, so it is
    written once first.
    """
    own = F.when(starts, F.struct(label.alias("x")))
    marked = settle(df.withColumn("_own", own))
    out = scan_before(marked, keys, order, block, [Scan("_open", "last", F.col("_own"))])
    return out.withColumn(name, F.coalesce("_own", "_open")["x"]).drop("_own", "_open")
