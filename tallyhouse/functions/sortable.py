"""Texts whose byte order is the order of the values they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond this size a whole number in a double no longer fits a long.
LONG_RANGE = 2.0**62
_DIGITS, _NINES = "0123456789", "9876543210"


def sortable_whole(number: Column) -> Column:
    """For doubles without fraction, all of them: ``number`` orders as the results do.

    A letter for the range, then 16 hexadecimal digits, or for numbers beyond longs the exponent
    and the digits, in nines' complement below zero. NaN comes last.
    """
    # Shifted by half the range of longs, so that none is negative and all have 16 digits.
    shifted = number.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    near = F.concat(F.lit("m"), F.lpad(F.hex(shifted), 16, "0"))
    spelled = F.format_string("%.16e", F.abs(number))
    far = F.concat(F.lpad(F.substring_index(spelled, "e+", -1), 3, "0"), F.replace(F.substring_index(spelled, "e+", 1), F.lit("."), F.lit("")))
    return (
        F.when(F.isnan(number), "z")
        .when(F.abs(number) < LONG_RANGE, near)
        .when(number == float("inf"), "y")
        .when(number == float("-inf"), "a")
        .when(number > 0, F.concat(F.lit("p"), far))
        .otherwise(F.concat(F.lit("b"), F.translate(far, _DIGITS, _NINES)))
    )


def sortable_text(text: Column) -> Column:
    """The text with an end that sorts before any longer text's next sign."""
    return F.concat(F.replace(text, F.lit("\x00"), F.lit("\x00\x01")), F.lit("\x00\x00"))
