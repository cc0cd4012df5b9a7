"""Costly expressions that must be computed once per row.

The optimizer copies a column into each place that uses it when it moves filters below
projections. A generator stops that, and keeps plans with many uses of one value small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_if(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Adds a costly column and keeps the rows where ``keep`` of it holds.

    A filter over a plain column would be pushed below it and compute it twice; a generator is not.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), keep)))


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and joins see as plain fields."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_row", F.explode(F.array(row))).select(
        *[c for c in df.columns if c not in columns], *[F.col(f"_row.{n}").alias(n) for n in columns]
    )


def only(row: Column) -> Column:
    """Aggregate: the one row of a table, null without any; more than one is an error."""
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row where one is allowed"))).otherwise(F.first(row))
