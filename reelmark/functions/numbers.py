"""Rounding and number text shared by every operator (and by the oracle SQL)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def js_round(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled value; the oracle uses the same formula."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + F.lit(0.0)


def half_up(value: Column) -> Column:
    """Nearest whole number, ties towards plus infinity (negative ties round up)."""
    return F.floor(value + 0.5)


def fixed_text(value: Column, digits: int) -> Column:
    """Number with exactly ``digits`` decimals."""
    if digits == 0:
        return js_round(value, 0).cast("bigint").cast("string")
    return js_round(value, digits).cast(f"decimal(28,{digits})").cast("string")


def plain_text(value: Column, digits: int = 3) -> Column:
    """Shortest decimal text of a value that has at most ``digits`` decimals."""
    return F.regexp_replace(fixed_text(value, digits), r"\.?0+$", "")


def metric_text(value: Column) -> Column:
    """Three decimals, or the word used for an absent metric."""
    return F.coalesce(fixed_text(value, 3), F.lit("missing"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clock_text(seconds: Column) -> Column:
    """``m:ss`` with the minutes unbounded."""
    whole = F.greatest(F.lit(0), half_up(seconds))
    return F.concat(
        F.floor(whole / 60).cast("string"),
        F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
    )


def ratio(numerator: Column, denominator: Column, empty: float) -> Column:
    return F.when(denominator == 0, F.lit(empty)).otherwise(
        numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    )
