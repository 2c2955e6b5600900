"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import scratch_dir, tune

# Places in a shuffled order are longs in [0, 2^62); a bucket is a place's leading bits.
PLACE_BITS = 62
BUCKET_ROWS = 32_768


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to the folder all executors share and read back.

    What is read back no longer depends on how a lost task would run again.
    """
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Words, that is runs of anything but ASCII white space; 0 for null."""
    return texts.map(lambda t: 0 if t is None else len(t.encode().split())).astype("int64")


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session has these settings for what runs inside the block, and what it had before afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def discard(frame: DataFrame) -> None:
    """Deletes the folders a frame reads, once what was made from them is written; for ``stored`` frames only."""
    spark = frame.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/tallyhouse/" in folder:
            path.getFileSystem(conf).delete(path, True)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def besides(frame: DataFrame, added: Sequence[str]) -> list[str]:
    """Columns of the frame that no added column replaces; names that differ in case only are alike."""
    taken = {name.lower() for name in added}
    return [name for name in frame.columns if name.lower() not in taken]


def packed(frame: DataFrame, added: Sequence[str], **own: Column) -> tuple[DataFrame, list[Column]]:
    """The frame's columns in one column ``row`` beside those an operator works with, and their selection back.

    Inside ``row`` no name of the input can clash with one of the operator's. Columns that an added
    one replaces are left out.
    """
    kept = besides(frame, added)
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    work = frame.select(row.alias("row"), *[column.alias(name) for name, column in own.items()])
    return work, [F.col(f"row.{quoted(c)}") for c in kept]


def place(seed: int, *columns: Column) -> Column:
    """A pseudo-random place in [0, 2^62) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - PLACE_BITS)


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Leading bits that cut so many rows into buckets of about ``bucket_rows``."""
    return max(0, math.ceil(math.log2(max(1, rows) / bucket_rows)))


def running_sums(
    frame: DataFrame, group: Sequence[str], at: str, ties: Sequence[str], value: Column, out: str, bits: int
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows before this one, by (at, ties).

    A group is cut into buckets by the leading bits of ``at``. Bucket totals are summed first,
    so the only rows that meet in one task are those of one bucket, however large the group.
    ``group`` columns must not be null. ``frame`` is read twice, so it should be stored.
    """
    bucket, total, base = f"_{out}_bucket", f"_{out}_total", f"_{out}_base"
    keyed = frame.withColumn(bucket, F.shiftright(F.col(at), PLACE_BITS - bits).cast("long"))
    keys = [*group, bucket]
    by_group = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy(*keys).agg(F.sum(value).alias(total)).select(
        *keys, F.coalesce(F.sum(total).over(by_group), F.lit(0)).cast("long").alias(base)
    )
    inside = Window.partitionBy(*keys).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(bases, keys)
        .withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
        .drop(bucket, base)
    )
