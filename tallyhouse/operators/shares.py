"""Shares of a group total and of the grand total."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.numeric import percent


def share_of_group(rows: DataFrame, group: str, amount: str, name: str) -> DataFrame:
    """Add ``name``: percentage of ``amount`` in the total of its group.

    For groups of any size: totals are aggregated and joined back (one row per group), so
    no task ever holds a whole group.
    """
    totals = rows.groupBy(group).agg(F.sum(amount).alias("_total"))
    joined = rows.join(totals.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, percent(F.col(amount), F.col("_total"))).drop("_group", "_total")


def share_of_small_group(group: str, amount: str) -> Column:
    """Window form, for groups bounded by a short domain (payment types of one category)."""
    total = F.sum(amount).over(Window.partitionBy(group))
    return F.round(F.col(amount) * F.lit(Decimal("100.0")) / total, 2).cast("double")


def share_of_all(rows: DataFrame, amount: str) -> Column:
    """Percentage of ``amount`` in the total over all rows, by scalar subquery."""
    grand_total = rows.agg(F.sum(amount).alias("_total")).scalar()
    return percent(F.col(amount), grand_total)
