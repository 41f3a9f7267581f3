"""Number functions with the null rules the metrics need."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_number(text: Column) -> Column:
    """Whole number from count text such as ``12.0``; halves go to the even side."""
    value = nan_to_null(text.try_cast("double"))
    return F.bround(value, 0).try_cast("bigint")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale``; null where the denominator is 0 or null."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if scale == 1.0 else quotient * F.lit(float(scale))


def log10_positive(value: Column) -> Column:
    """Base-10 logarithm; null for values that are not positive."""
    return F.when(value > 0, F.log10(value))
