"""Aggregates over windows of one fixed length, without pairing the windows with their rows.

Time is cut into cells as long as the window. A window that starts in a cell then ends in the next one, so it is the
rest of its first cell and the head of its second: two running aggregates, one down and one up the cell, give it
whatever the number of rows and windows, for maxima as well as for sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cell_of(at: Column, width: float) -> Column:
    """Number of the cell that holds a position; the division alone may round up to the next one."""
    near = F.floor(at / width)
    return F.when(near * F.lit(width) > at, near - 1).otherwise(near)


def around(
    spots: DataFrame,
    asked: DataFrame,
    keys: list[str],
    name: str,
    width: float,
    sums: list[str],
    maxima: list[str],
    masks: tuple[str, ...] = (),
) -> DataFrame:
    """Sums, maxima and unions (of bit masks) of the spots that lie within each asked window.

    ``spots``: keys, ``from_t``, ``to_t`` (in one cell; equal for a point) and the value columns. ``asked``: keys, ``name``
    (which tells windows apart), ``lo`` and ``hi``, both inclusive and ``width`` apart up to rounding. One row per asked
    window; values are NULL where nothing lies in it.
    """
    values = [*sums, *maxima, *masks]
    down, up = F.struct(F.lit(0).alias("half"), (-F.col("from_t")).alias("o")), F.struct(F.lit(1).alias("half"), F.col("to_t").alias("o"))
    ends = F.struct(F.lit(0).alias("half"), (-F.col("lo")).alias("o"), cell_of(F.col("lo"), width).alias("cell")), F.struct(
        F.lit(1).alias("half"), F.col("hi").alias("o"), cell_of(F.col("hi"), width).alias("cell")
    )
    placed = spots.select(
        *keys, cell_of(F.col("from_t"), width).alias("_cell"), F.explode(F.array(down, up)).alias("_at"), *values
    ).select(*keys, "_cell", "_at.half", "_at.o", F.lit(0).alias("_side"), F.lit(None).cast(asked.schema[name].dataType).alias(name), *values)
    types = {f.name: f.dataType for f in placed.schema.fields}
    asks = asked.select(*keys, name, F.explode(F.array(*ends)).alias("_at")).select(
        *keys, F.col("_at.cell").alias("_cell"), "_at.half", "_at.o", F.lit(1).alias("_side"), name,
        *[F.lit(None).cast(types[v]).alias(v) for v in values],
    )
    # At one position spots come first: both ends of a window are inclusive.
    run = (
        Window.partitionBy(*keys, "_cell", "half").orderBy("o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = {v: F.sum if v in sums else F.max if v in maxima else F.bit_or for v in values}
    return (
        placed.unionByName(asks)
        .select(*keys, name, "_side", *[f(v).over(run).alias(v) for v, f in total.items()])
        .filter("_side = 1")
        .groupBy(*keys, name)
        .agg(*[f(v).alias(v) for v, f in total.items()])
    )
