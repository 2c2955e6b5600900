"""Rounded ratios, means and day counts with the agreed result types."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HUNDRED = Decimal("100.0")


def rounded(value: Column, digits: int) -> Column:
    """Half-away-from-zero rounding, delivered as double."""
    return F.round(value, digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100.0 * part / whole`` in decimal arithmetic, so halves round exactly."""
    return rounded(F.lit(HUNDRED) * part / whole, digits)


def mean_of(total: Column, count: Column, digits: int) -> Column:
    """Mean from a pre-aggregated sum and count."""
    return rounded(total / count, digits)


def count_when(condition: Column) -> Column:
    """Rows where the condition holds; NULL counts as not holding."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour periods between two timestamps, truncated toward zero."""
    return F.extract(F.lit("DAY"), later - earlier)


def year_month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")
