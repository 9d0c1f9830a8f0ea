"""Rounding and numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 8) -> Column:
    """Round half up after settling the value at 12 decimals.

    Sums of doubles differ in their last bits with the order of the partial sums. Settling first
    gives every partitioning the same rounded result, also for exact midpoints.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def mean_of(value: Column | str, digits: int = 8) -> Column:
    return rounded(F.avg(value), digits)


def ratio(numerator: Column, denominator: Column, digits: int = 8) -> Column:
    """Quotient, NULL for a zero denominator."""
    return rounded(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def count_true(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def mean_where(value: Column, condition: Column, digits: int = 8) -> Column:
    """Mean over the rows that meet a condition, NULL when there are none."""
    return rounded(F.avg(F.when(condition, value)), digits)


def settled_double(value: Column) -> Column:
    """Value at 12 decimals, so that comparisons do not hang on the order of a summation."""
    return value.cast("decimal(38,12)").cast("double")
