"""CSV ingest: text scan, then lenient typing by the declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.picking import first_per_key
from tallyhouse.schema import TABLE_COLUMNS, TABLE_KEYS, ddl
from tallyhouse.sources.csv_records import read_records
from tallyhouse.sources.tables import full_refresh

# Accepted timestamp forms, first match wins. One letter takes one or two digits.
TIMESTAMP_FORMS = ("yyyy-M-d H:m:s", "yyyy-M-d")


# How cells are quoted, the same for reading and writing; a line's length is no limit for a cell.
CELL_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def scan_csv(spark: SparkSession, path: str | list[str], also: Sequence[str] = ()) -> DataFrame:
    """Header CSV in UTF-8 as text columns; a byte-order mark is dropped and ``""`` reads as a quote.

    Quoted cells may span lines in every table. A large file is read by many tasks; ``also`` may
    name a record's place in order: ``_file`` by number, ``_range`` of the file, ``_line`` of the range.
    Column names are those of the first file, and every file begins with a header.
    """
    names = spark.read.options(header=True, encoding="UTF-8", **CELL_OPTIONS).csv(path).columns
    cells = F.from_csv("record", ddl({n.replace("`", "``"): "string" for n in names}), CELL_OPTIONS)
    return read_records(spark, path).select(cells.alias("cells"), *also).select("cells.*", *also)


def as_it_is(writer: DataFrameWriter) -> DataFrameWriter:
    """Switches off the trimming of cells that CSV writing does by default."""
    return writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def write_csv(rows: DataFrame, path: str) -> str:
    """Header CSV in the form ``scan_csv`` reads; blanks and line breaks at a cell's ends stay."""
    as_it_is(rows.write.option("header", True).option("quote", '"').option("escape", '"')).csv(path)
    return path


def filled(cell: Column) -> Column:
    return F.nullif(cell, F.lit(""))


# What reads as a number: no type suffix (``12d``), but single underscores between digits.
NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def number_text(cell: Column) -> Column:
    """The cell if it is a number, without underscores; NULL otherwise."""
    return F.when(cell.rlike(NUMBER), F.btrim(F.replace(cell, F.lit("_"), F.lit("")), F.lit(" \t\r\n\f\x0b")))


def lenient_int(cell: Column) -> Column:
    """``"12.9"`` gives 12; text that is no number gives NULL."""
    return number_text(cell).try_cast("double").try_cast("int")


def lenient_timestamp(cell: Column) -> Column:
    attempts = [F.try_to_timestamp(filled(cell), F.lit(form)) for form in TIMESTAMP_FORMS]
    return F.coalesce(*attempts).cast("timestamp_ntz")


def lenient(cell: Column, kind: str) -> Column:
    if kind == "int":
        return lenient_int(cell)
    if kind.startswith("timestamp"):
        return lenient_timestamp(cell)
    if kind == "string":
        return filled(cell)
    return number_text(cell).try_cast(kind)


def typed(cells: DataFrame, table: str, also: Sequence[str] = ()) -> DataFrame:
    """Declared columns present in the file, cast leniently, matched by header name."""
    declared = TABLE_COLUMNS[table]
    return cells.select(*[lenient(F.col(c), declared[c]).alias(c) for c in cells.columns if c in declared], *also)


def read_table(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """The typed rows of a table's files."""
    return typed(scan_csv(spark, path), table)


def load_table(spark: SparkSession, path: str | list[str], table: str, target: str) -> DataFrame:
    """Parse, type, keep the first row of each key in file order, and replace the stored table.

    Files count in the order of their names. Raw geolocation has no key and keeps all rows.
    """
    place = ["_file", "_range", "_line"]
    rows = typed(scan_csv(spark, path, place), table, place)
    if keys := TABLE_KEYS.get(table):
        rows = first_per_key(rows, keys, [F.asc(p) for p in place])
    return full_refresh(rows.drop(*place), target)
