"""Interval joins on an equality key plus a time cell.

Both sides are cut into cells of ``width`` seconds; a pair is produced only in the cell
that holds the start of its overlap, so every overlapping pair appears exactly once and
no pair is produced that does not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _cells(df: DataFrame, start: Column, end: Column, width: float, tag: str) -> DataFrame:
    first = F.floor(start / width)
    return (
        df.withColumn(f"_{tag}s", start)
        .withColumn(f"_{tag}e", end)
        .filter(F.col(f"_{tag}e") >= F.col(f"_{tag}s"))
        .withColumn("_cell", F.explode(F.sequence(first, F.floor(end / width))))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    width: float,
) -> DataFrame:
    """Inner join of closed intervals that share at least one point."""
    ls = _cells(left, *left_span, width, "l")
    rs = _cells(right, *right_span, width, "r")
    return (
        ls.join(rs, [*keys, "_cell"])
        .filter((F.col("_ls") <= F.col("_re")) & (F.col("_le") >= F.col("_rs")))
        .filter(F.col("_cell") == F.floor(F.greatest("_ls", "_rs") / width))
        .drop("_cell", "_ls", "_le", "_rs", "_re")
    )


def next_after(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, limit: float, name: str
) -> DataFrame:
    """For each distinct position on the left: the first right position strictly later,
    at most ``limit`` away (NULL if none). No pairs are formed: one running window per
    time block, plus the first right position of the following block.
    """
    block = F.floor(F.col(at) / limit)
    l = left.select(*keys, at).distinct()
    r = right.select(*keys, at).distinct()
    both = l.select(*keys, at, F.lit(None).cast("double").alias("_hit"), F.lit(0).alias("_side")).unionByName(
        r.select(*keys, at, F.col(at).alias("_hit"), F.lit(1).alias("_side"))
    ).withColumn("_blk", block)
    from pyspark.sql import Window

    # Descending, left rows first on equal positions: a right row at the same place is not later.
    down = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(F.col(at).desc(), "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = both.withColumn("_in", F.last("_hit", ignorenulls=True).over(down)).filter("_side = 0")
    heads = (
        r.groupBy(*keys, (block - 1).alias("_blk")).agg(F.min(at).alias("_head"))
    )
    near = F.when(F.col("_head") <= F.col(at) + limit, F.col("_head"))
    return (
        inside.join(heads.hint("merge"), [*keys, "_blk"], "left")
        .withColumn(name, F.coalesce("_in", near))
        .select(*keys, at, name)
    )
