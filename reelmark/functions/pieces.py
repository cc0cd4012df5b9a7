"""Pieces of ordered rows that restart where a value has left its piece's first value by more than a bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .tables import settle


def restarted(df: DataFrame, keys: list[str], order: str, value: str, bound: float) -> DataFrame:
    """``keys, order, value`` with ``start`` (the ``order`` of the piece's first row) and ``base`` (its value).

    A row opens a new piece if its value differs from the base by more than ``bound``. A round takes the open piece of
    every key: its base and its first row beyond the bound are aggregates, reduced before the shuffle, and only rows
    from there on go into the next round. So rounds grow with the pieces of a key, and nothing with its rows.
    Keys are many and short rows compress well, so joins by key are kept from being broadcast through the driver.
    """
    left = settle(df.select(*keys, order, value))
    parts: list[DataFrame] = []
    while not parts or not left.isEmpty():
        first = left.groupBy(*keys).agg(F.min(order).alias("start"), F.min_by(value, order).alias("base"))
        seen = left.join(first.hint("merge"), keys)
        cut = seen.filter(F.abs(F.col(value) - F.col("base")) > bound).groupBy(*keys).agg(F.min(order).alias("cut"))
        seen = settle(seen.join(cut.hint("merge"), keys, "left"))
        parts.append(seen.filter(F.col("cut").isNull() | (F.col(order) < F.col("cut"))).drop("cut"))
        left = seen.filter(F.col(order) >= F.col("cut")).select(*keys, order, value)
    return reduce(DataFrame.unionByName, parts)
