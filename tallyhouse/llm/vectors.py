"""Helpers for tables of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors with finite components only, not all zero; false for null and empty ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_key(vector: Column) -> Column:
    """Equal for equal vectors. Components print exactly, so unequal vectors differ."""
    return F.md5(vector.cast("string"))
