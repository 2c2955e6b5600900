"""Records of CSV files whose quoted cells span lines, with many tasks to a file.

Lines are read in byte ranges, as any text. What a line does to the state of the reader, which is
either inside a quoted cell or not, can be told from the line alone: a map from the state before
it to the state after it. Maps compose, so each range gets one, ranges are put together per file,
and every line learns the state it begins with. A line that begins outside of a cell begins a record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.sources.tables import stored

# A line's cells: quoted up to the quote that ends it, what follows counted to the cell; or plain.
_INSIDE = r'(?:[^"]++|"")*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_LEAVES_OPEN = rf'^{_CELLS}"{_INSIDE}$'
_STAYS_OPEN = rf'^{_INSIDE}$|^{_INSIDE}"[^,]*+,{_CELLS}"{_INSIDE}$'

RANGE = ["_file", "_range"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their place (path, range, number in the order of the range) and their map.

    ``_from_0`` is the state after the line if it begins outside of a cell, ``_from_1`` that if
    it begins inside; 1 is inside.
    """
    value = F.col("value")
    quoted = F.contains(value, F.lit('"'))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
        F.when(quoted & value.rlike(_LEAVES_OPEN), 1).otherwise(0).alias("_from_0"),
        F.when(quoted & ~value.rlike(_STAYS_OPEN), 0).otherwise(1).alias("_from_1"),
    )


def _states(rows: DataFrame, keys: list[str], order: str, then_0: str, then_1: str, names: dict[str, int]) -> DataFrame:
    """Adds, for each ``name: first`` of ``names``, the state a row begins with if its group begins with ``first``.

    A row's map keeps the state, swaps it, or sets it. The state is the one last set, or the
    first, swapped as often as rows have swapped it since.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps, sets = F.col(then_0) > F.col(then_1), F.col(then_0) == F.col(then_1)
    swapped = F.coalesce(F.sum(F.when(swaps, 1).otherwise(0)).over(before), F.lit(0))
    # What was set, with the swaps before it taken out.
    base = F.last(F.when(sets, (F.col(then_0) + F.col("_swapped")) % 2), ignorenulls=True).over(before)
    rows = rows.withColumn("_swapped", swapped).withColumn("_base", base)
    states = {name: (F.coalesce("_base", F.lit(first)) + F.col("_swapped")) % 2 for name, first in names.items()}
    return rows.withColumns(states).drop("_swapped", "_base")


def _spanning(lines: DataFrame) -> DataFrame:
    """Records of files in which some line leaves a cell open: (_file, _range, _line, record).

    Lines move and are sorted once: each gets its state, and the line that begins its record, for
    both states its range may begin with. Which one holds is told by the ranges, which are few.
    """
    lines = _states(lines, RANGE, "_line", "_from_0", "_from_1", {"_state_0": 0, "_state_1": 1})
    so_far = Window.partitionBy(*RANGE).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = []
    for i in (0, 1):
        outside = F.col(f"_state_{i}") == 0
        measured += [
            F.when(outside, F.col("_from_0")).otherwise(F.col("_from_1")).alias(f"_end_{i}"),
            F.last(F.when(outside, F.col("_line")), ignorenulls=True).over(so_far).alias(f"_begun_{i}"),
            (outside & (F.col("_from_0") == 0)).alias(f"_whole_{i}"),
        ]
    lines = stored(lines.select(*RANGE, "_line", "value", *measured), "csv-lines")
    ranges = lines.groupBy(*RANGE).agg(
        *[F.max_by(f"_end_{i}", "_line").alias(f"_end_{i}") for i in (0, 1)],
        *[F.max(f"_begun_{i}").alias(f"_last_{i}") for i in (0, 1)],
    )
    # A row per range of a file: few, whatever the file's size.
    ranges = _states(ranges, ["_file"], "_range", "_end_0", "_end_1", {"_begins": 0})

    def held(name: str) -> Column:
        return F.when(F.col("_begins") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))

    earlier = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.when(held("_last").isNotNull(), F.struct("_range", held("_last").alias("_line")))
    carried = F.last(begin, ignorenulls=True).over(earlier)
    ranges = stored(ranges.select(*RANGE, "_begins", carried.alias("_carried")), "csv-ranges")
    begun = F.when(held("_begun").isNotNull(), F.struct("_range", held("_begun").alias("_line")))
    placed = lines.join(ranges, RANGE).select(
        *RANGE, "_line", "value", F.coalesce(begun, F.col("_carried")).alias("_record"), held("_whole").alias("_whole")
    )
    whole = placed.where("_whole").select(*RANGE, "_line", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("_range", "_line", "value")))
    joined = (
        placed.where("not _whole").groupBy("_file", "_record")
        .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
        .select("_file", "_record._range", "_record._line", "record")
    )
    return whole.unionByName(joined)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records after each file's header, as text with their place: (_file, _range, _line, record).

    ``_file`` is the file's number in the order of names. Files without an open cell at any line's
    end, which one scan tells, need no exchange: their lines are the records. In others a range's
    lines meet in one task. Lines end with a line feed, with or without a carriage return, and
    count as ended by a line feed alone inside cells; a cell that is never closed goes on to the
    file's end, less a line break there. Blank lines are no records.
    """
    lines = _lines(spark, path)
    blank = F.col("value").isin("", "\r")
    files = lines.groupBy("_path").agg(
        F.bool_or(F.col("_from_0") == 1).alias("_spans"), F.min(F.when((F.col("_range") == 0) & ~blank, F.col("_line"))).alias("_header")
    )
    # A row per file. Lines carry the number instead of the name.
    files = stored(files.withColumn("_file", F.row_number().over(Window.orderBy("_path"))), "csv-files")
    lines = lines.join(files.select("_path", "_file", "_spans"), "_path").drop("_path")
    readers = {False: lambda plain: plain.select(*RANGE, "_line", F.col("value").alias("record")), True: _spanning}
    # A kind of file that is absent is not looked for in the lines again.
    kinds = [r["_spans"] for r in files.select("_spans").distinct().collect()] or [False]
    read = [readers[kind](lines.where(F.col("_spans") == kind).drop("_spans")) for kind in kinds]
    ended = F.replace("record", F.lit("\r\n"), F.lit("\n"))
    ended = F.when(ended.endswith("\r"), F.left(ended, F.length(ended) - 1)).otherwise(ended)
    return (
        reduce(DataFrame.unionByName, read).join(files.select("_file", "_header"), "_file")
        .where((F.col("_range") != 0) | (F.col("_line") != F.col("_header"))).drop("_header")
        .withColumn("record", ended).where("record <> ''")
    )
