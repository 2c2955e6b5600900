"""Equality of result sets: order-, alias- and rounding-insensitive.

A result set is a frame ``(case_id, cells)``, one row per result row; ``cells`` is an array of
``struct(kind, num, txt)``. Column names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.sortable import sortable_text, sortable_whole
from tallyhouse.operators.ordered import ROWS_PER_BLOCK, ordered_runs
from tallyhouse.sources.tables import stored

# Sort rank of a cell kind, relative tolerance, digits of the sort key.
NUMBER, MISSING, TEXT = 0, 1, 2
TOLERANCE = 0.01
SMALLEST_SCALE = 1e-9
SORT_DIGITS = 6


def number_cell(value: Column) -> Column:
    value = value.cast("double")
    return F.struct(
        F.when(value.isNull(), MISSING).otherwise(NUMBER).alias("kind"),
        value.alias("num"),
        F.lit(None).cast("string").alias("txt"),
    )


def text_cell(value: Column) -> Column:
    value = value.cast("string")
    return F.struct(
        F.when(value.isNull(), MISSING).otherwise(TEXT).alias("kind"),
        F.lit(None).cast("double").alias("num"),
        value.alias("txt"),
    )


def cells_of(rows: DataFrame, columns: list[str]) -> Column:
    """Cells of the named columns, typed by the frame's schema."""
    kinds = dict(rows.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return F.array(
        *[number_cell(F.col(c)) if kinds[c].startswith(numeric) else text_cell(F.col(c)) for c in columns]
    )


def same_value(a: Column, b: Column) -> Column:
    """Numbers within 1 % of the larger, NULL with NULL, text exactly."""
    scale = F.greatest(F.abs(a["num"]), F.abs(b["num"]), F.lit(SMALLEST_SCALE))
    close = ((a["num"] == b["num"]) & ~F.isnan(a["num"])) | (F.abs(a["num"] - b["num"]) / scale <= TOLERANCE)
    return (a["kind"] == b["kind"]) & (
        F.when(a["kind"] == NUMBER, close).when(a["kind"] == TEXT, a["txt"] == b["txt"]).otherwise(True)
    )


def rough(number: Column) -> Column:
    """The number in whole millionths: near-equal numbers become one, and order is kept."""
    return F.rint(number * F.lit(10.0**SORT_DIGITS))


def row_key(cells: Column) -> Column:
    """A text whose byte order is that of the rows: cell by cell by kind, then by rough number or text.

    Rows that differ by less than roughness shows have one key.
    """
    def cell_key(cell: Column) -> Column:
        value = F.when(cell["kind"] == NUMBER, sortable_whole(rough(cell["num"]))).when(cell["kind"] == TEXT, sortable_text(cell["txt"]))
        return F.concat(cell["kind"].cast("string"), F.coalesce(value, F.lit("")))

    return F.array_join(F.transform(cells, cell_key), "")


SIDES = ["gold", "predicted"]


def _distinct_rows(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each distinct row of a case once, with its number of copies on either side."""
    sides = [side.select("case_id", "cells", *[F.lit(int(side is own)).alias(n) for n, own in zip(SIDES, (gold, predicted))])
             for side in (gold, predicted)]
    return sides[0].unionByName(sides[1]).groupBy("case_id", "cells").agg(*[F.sum(n).alias(n) for n in SIDES])


def _first_difference(distinct: DataFrame, rows_per_block: int) -> DataFrame:
    """First row and column whose values differ once both sides are sorted.

    The copies of a row form one run of positions per side. A row that takes the same positions
    on both sides needs no look. Other runs are cut at multiples of ``rows_per_block``, so the
    runs of both sides meet in stretches of bounded length.
    """
    starts = [f"{side}_start" for side in SIDES]
    runs = ordered_runs(distinct, ["case_id"], F.col("_key"), dict(zip(SIDES, starts)), rows_per_block, [F.col("cells")])
    apart = runs.where(F.col("_apart") | (F.col(starts[0]) != F.col(starts[1])))
    by_side = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(start).alias("start"), F.col(side).alias("n")) for side, start in zip(SIDES, starts)
    ])
    width = F.lit(rows_per_block)
    first = F.floor(F.col("run.start") / width)
    last = F.floor((F.col("run.start") + F.col("run.n") - 1) / width)
    pieces = (
        apart.select("case_id", "cells", F.explode(F.filter(by_side, lambda r: r["n"] > 0)).alias("run"))
        .withColumn("_stretch", F.explode(F.sequence(first, last)))
        .select("case_id", "cells", "_stretch", "run.side", F.greatest("run.start", F.col("_stretch") * width).alias("at"))
    )
    so_far = (
        Window.partitionBy("case_id", "_stretch")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def running(side: str) -> Column:
        cells = F.when(F.col("side") == side, F.col("cells"))
        return F.last(cells, ignorenulls=True).over(so_far).alias(side)

    aligned = pieces.select("case_id", "at", *[running(side) for side in SIDES])
    common = F.least(F.size("gold"), F.size("predicted"))
    same = F.zip_with(F.slice("gold", F.lit(1), common), F.slice("predicted", F.lit(1), common), same_value)
    return (
        aligned.withColumn("_col", F.array_position(same, F.lit(False)) - 1)
        .where(F.col("_col") >= 0)
        .groupBy("case_id")
        .agg(F.min(F.struct("at", "_col")).alias("_first"))
    )


def compare_results(
    cases: DataFrame,
    gold: DataFrame,
    predicted: DataFrame,
    trim: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Verdict and first reason per case of ``cases(case_id)``.

    Checks in order: number of rows, number of columns, values. ``trim`` accepts extra
    trailing columns on either side. A case without rows is an empty result set.
    """
    # A number that is none does not equal itself.
    odd_number = F.coalesce(F.exists("cells", lambda c: F.isnan(c["num"])), F.lit(False))
    flags = {"_width": F.size("cells"), "_apart": (F.col("gold") != F.col("predicted")) | odd_number}
    distinct = stored(_distinct_rows(gold, predicted).withColumns(flags), "distinct-rows")
    shape = distinct.groupBy("case_id").agg(
        *[F.sum(side).alias(f"{side}_rows") for side in SIDES],
        *[F.max(F.when(F.col(side) > 0, F.col("_width"))).alias(f"{side}_cols") for side in SIDES],
        F.bool_or("_apart").alias("_differs"),
    )
    shape = stored(shape, "result-shapes")
    # Values are looked at only where the shapes agree and some row's copies do not.
    alike = (F.col("gold_rows") == F.col("predicted_rows")) & (F.lit(trim) | (F.col("gold_cols") == F.col("predicted_cols")))
    in_doubt = distinct.join(shape.where(alike & F.col("_differs")).select("case_id"), "case_id", "left_semi")
    keyed = in_doubt.drop("_width").withColumn("_key", row_key(F.col("cells")))
    shaped = (
        cases.select("case_id")
        .join(shape, "case_id", "left")
        .join(_first_difference(keyed, rows_per_block), "case_id", "left")
        .fillna(0, ["gold_rows", "predicted_rows", "gold_cols", "predicted_cols"])
    )
    kind = (
        F.when(F.col("gold_rows") != F.col("predicted_rows"), "row count")
        .when((F.col("gold_cols") != F.col("predicted_cols")) & F.lit(not trim), "col count")
        .when(F.col("_first").isNotNull(), "value")
        .when(F.col("gold_rows") == 0, "both empty")
        .otherwise("equal")
    )
    differs_at = F.col("reason") == "value"
    return shaped.withColumn("reason", kind).select(
        "case_id",
        F.col("reason").isin("equal", "both empty").cast("int").alias("is_equal"),
        "reason",
        "gold_rows",
        "predicted_rows",
        F.when(differs_at, F.col("_first.at"))
        .when(F.col("reason") == "col count", F.lit(0))
        .otherwise(-1)
        .cast("long")
        .alias("row_no"),
        F.when(differs_at, F.col("_first._col")).otherwise(-1).cast("long").alias("col_no"),
    )


def exact_difference(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Bag difference both ways: rows found on one side only, counted per case.

    One aggregation nets the copies of each distinct row, so none is written out again.
    """
    netted = (
        _distinct_rows(gold, predicted)
        .withColumn("_extra", F.col("gold") - F.col("predicted"))
        .where(F.col("_extra") != 0)
    )
    return netted.groupBy("case_id").agg(
        F.sum(F.greatest(F.col("_extra"), F.lit(0))).alias("gold_only"),
        F.sum(F.greatest(-F.col("_extra"), F.lit(0))).alias("predicted_only"),
    )
