"""Top-k, first row per key, most frequent value per key, capped reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows in the given order (each task keeps only ``k``)."""
    return rows.orderBy(*order).limit(k)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    Spark limits the window group before the exchange, so a key shared by a third of the
    table sends one row per input partition, not its whole group.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def most_frequent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-NULL ``value`` per key, the smallest one on a tie.

    Counting (key, value) first keeps every aggregation buffer at one row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rank = F.struct(-F.col("_n"), F.col(value))
    return counted.groupBy(*keys).agg(F.min_by(value, rank).alias(value))


def capped(rows: DataFrame, cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows plus ``truncated``: 1 when there were more.

    One row beyond the cap is fetched to tell the two cases apart. This is the row-limit
    feature of an interactive query, so at most ``cap + 1`` rows ever reach the window.
    """
    fetched = rows.orderBy(*order).limit(cap + 1)
    place = F.row_number().over(Window.orderBy(*order))
    fetched_rows = F.count("*").over(Window.partitionBy())
    return (
        fetched.withColumn("_place", place)
        .withColumn("truncated", (fetched_rows > cap).cast("int"))
        .where(F.col("_place") <= cap)
        .drop("_place")
    )
