"""Positions in a sorted order, per group, without sorting any group in one task.

``ordered_runs`` gives every distinct key of a group the number of rows before it: numbering and
the alignment of two result sets are built on it. Percentiles need no order, only selection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.tables import stored

# Distinct keys one task sorts comfortably. A group with more is cut into blocks of about
# this size; a smaller group is mostly one block.
ROWS_PER_BLOCK = 1_000_000
# Blocks are found in two steps: among about this many coarse ones, then among about as many
# fine ones inside. That carries a group of rows_per_block * FANOUT ** 2 keys, 10 ** 12 as set;
# a larger group takes one more step of the same kind.
FANOUT = 1_000
BLOCK = ["_coarse", "_fine"]


def _splits(chosen: DataFrame, group: Sequence[str], key: Column, name: str) -> DataFrame:
    """Chosen keys per group. Written, so that their true size decides how they are joined."""
    return stored(chosen.groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias(name)), "splitters")


def _passed(splits: str, key: Column) -> Column:
    return F.when(F.col(splits).isNull(), 0).otherwise(F.size(F.filter(splits, lambda split: split <= key)))


def _blocked(distinct: DataFrame, group: list[str], key: Column, rows_per_block: int, fanout: int) -> DataFrame:
    """Adds the block's numbers, in key order, and puts each block on a task.

    Keys chosen by hash cut the group; the choice depends on the data alone, so a task that runs
    again agrees with its first run. A row meets the coarse keys of its group, then the fine keys of
    its coarse block: neither array grows with the group.
    """
    drawn = F.xxhash64(*group, key)
    coarse = _splits(distinct.where(F.pmod(drawn, F.lit(rows_per_block * fanout)) == 0), group, key, "_splits")
    placed = distinct.join(coarse, group, "left").withColumn("_coarse", _passed("_splits", key)).drop("_splits")
    inside = [*group, "_coarse"]
    fine = _splits(placed.where(F.pmod(drawn, F.lit(rows_per_block)) == 0), inside, key, "_splits")
    return (
        placed.join(fine, inside, "left").withColumn("_fine", _passed("_splits", key)).drop("_splits")
        # By block, not only by group: the blocks of a large group belong on different tasks.
        .repartition(*group, *BLOCK)
    )


def ordered_runs(
    distinct: DataFrame,
    group: Sequence[str],
    key: Column,
    starts: Mapping[str, str],
    rows_per_block: int = ROWS_PER_BLOCK,
    ties: Sequence[Column] = (),
    fanout: int = FANOUT,
) -> DataFrame:
    """Adds, for every ``weight: name`` of ``starts``, the summed weight of smaller keys in the group.

    ``distinct`` holds each (group, key, ties) once; it is read several times, so it should be
    stored. ``ties`` order rows of one key, which stay in one block. Groups of up to
    ``rows_per_block`` rows are sorted whole; larger ones are cut into blocks, which are summed
    first and then sorted. Group columns hold no NULL.
    """
    group = list(group)
    large = stored(distinct.groupBy(*group).count().where(F.col("count") > rows_per_block).select(*group), "large-groups")
    if not large.head(1):
        return _summed_inside(distinct, group, key, starts, ties)
    # Read from storage, so their true number decides how they are joined.
    whole = _summed_inside(distinct.join(large, group, "left_anti"), group, key, starts, ties)
    blocked = _blocked(distinct.join(large, group, "left_semi"), group, key, rows_per_block, fanout)
    block, weights = [*group, *BLOCK], list(starts)
    before = Window.partitionBy(*group).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*block)
        .agg(*[F.sum(w).alias(f"_size_{w}") for w in weights])
        .select(*block, *[F.coalesce(F.sum(f"_size_{w}").over(before), F.lit(0)).alias(f"_offset_{w}") for w in weights])
    )
    placed = _summed_inside(blocked, block, key, starts, ties).join(offsets, block)
    placed = placed.withColumns({name: F.col(name) + F.col(f"_offset_{w}") for w, name in starts.items()})
    return whole.unionByName(placed.drop(*BLOCK, *[f"_offset_{w}" for w in weights]))


def _summed_inside(rows: DataFrame, keys: list[str], key: Column, starts: Mapping[str, str], ties: Sequence[Column]) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w, name in starts.items()})


def numbered(
    rows: DataFrame,
    group: Sequence[str],
    key: str,
    name: str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the rows of each group 1, 2, ... by a key unique in its group."""
    kept = stored(rows.withColumn("_one", F.lit(1)), "numbered-rows")
    runs = ordered_runs(kept, group, F.col(key), {"_one": "_start"}, rows_per_block)
    return runs.withColumn(name, F.col("_start") + 1).drop("_one", "_start")


# Rows in a stretch of values that are looked at one by one; a histogram narrows longer ones.
ROWS_AT_ONCE = 100_000
BINS = 4096


def _log_bin(value: Column) -> Column:
    """A whole number that never falls as the value grows; a bin spans about 1.6 % of its values."""
    size = F.floor(F.ln(F.abs(value)) * 64)
    # Logarithms of doubles lie between -745 and 710. Infinities and NaN, which comes last, have bins of their own.
    return (
        F.when(F.isnan(value), 200_000).when(value == float("inf"), 150_000).when(value == float("-inf"), -150_000)
        .when(value > 0, 60_000 + size).when(value < 0, -60_000 - size).otherwise(0)
    )


def _even_bin(value: Column) -> Column:
    """The bin among ``BINS`` of equal width from the stretch's least value to its greatest."""
    return F.floor((value - F.col("_of.least")) / (F.col("_of.most") - F.col("_of.least")) * BINS)


def percentiles(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Exact percentiles of doubles per group, linear between neighbours; one column per fraction.

    By selection: a histogram per group tells in which stretches of values the wanted places lie.
    Rows of these alone are counted again, in finer bins from a stretch's least value to its
    greatest, until few are left in each or all are equal. Only bins and the values left are
    sorted; rows of the table are never.
    """
    group = list(group)
    found = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_value"))
    wanted_places = [
        f(F.col("_total"), fraction) for fraction in fractions.values() for f in (_low, _high)
    ]
    measures = [F.count("*").alias("_rows"), F.min("_value").alias("_least"), F.max("_value").alias("_most")]
    columns = [*group, "_least", "_most", "_rows", "_before", "_total"]

    def wanted(stretches: DataFrame) -> DataFrame:
        held = [(F.col("_before") <= p) & (p < F.col("_before") + F.col("_rows")) for p in wanted_places]
        return stretches.where(reduce(lambda a, b: a | b, held)).select(*columns)

    def within(stretches: DataFrame) -> DataFrame:
        """Rows in the stretches; a group has no more of these than there are wanted places."""
        spans = stretches.groupBy(*group).agg(
            F.collect_list(F.struct(*[F.col(f"_{c}").alias(c) for c in ("least", "most", "before", "total")])).alias("_spans")
        )
        of = F.get(F.filter("_spans", lambda s: F.col("_value").between(s["least"], s["most"])), F.lit(0))
        return found.join(spans, group).withColumn("_of", of).drop("_spans").where(F.col("_of").isNotNull())

    smaller = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = found.groupBy(*group, _log_bin(F.col("_value")).alias("_bin")).agg(*measures)
    stretches = bins.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(smaller), F.lit(0)), "_total": F.sum("_rows").over(Window.partitionBy(*group))}
    )
    known = stored(wanted(stretches), "percentile-stretches")
    long = (F.col("_least") < F.col("_most")) & (F.col("_rows") > rows_at_once)
    while known.where(long).head(1):
        smaller = Window.partitionBy(*group, "_of").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        finer = within(known.where(long)).groupBy(*group, "_of", _even_bin(F.col("_value")).alias("_bin")).agg(*measures)
        finer = finer.withColumns(
            {"_before": F.col("_of.before") + F.coalesce(F.sum("_rows").over(smaller), F.lit(0)), "_total": F.col("_of.total")}
        )
        known = stored(known.where(~long).unionByName(wanted(finer)), "percentile-stretches")

    left = within(known.where("_least < _most")).groupBy(*group, "_of", "_value").agg(F.count("*").alias("_rows"))
    smaller = Window.partitionBy(*group, "_of").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    runs = left.select(
        *group, "_value", "_rows", F.col("_of.total").alias("_total"),
        (F.col("_of.before") + F.coalesce(F.sum("_rows").over(smaller), F.lit(0))).alias("_before"),
    ).unionByName(known.where("_least = _most").select(*group, F.col("_least").alias("_value"), "_rows", "_total", "_before"))

    def value_at(place: Column) -> Column:
        covers = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_rows"))
        return F.max(F.when(covers, F.col("_value")))

    total, values, results = F.col("_total"), [F.max("_total").alias("_total")], []
    for name, fraction in fractions.items():
        values += [value_at(f(total, fraction)).alias(f"_{f.__name__}_{name}") for f in (_low, _high)]
        part = (total - 1) * F.lit(fraction) - _low(total, fraction)
        results.append((F.col(f"__low_{name}") * (1 - part) + F.col(f"__high_{name}") * part).alias(name))
    return runs.groupBy(*group).agg(*values).select(*group, *results)


def _low(total: Column, fraction: float) -> Column:
    """The place, from 0, at or before which the percentile lies; ``_high`` is the one after it."""
    return F.floor((total - 1) * F.lit(fraction))


def _high(total: Column, fraction: float) -> Column:
    return F.least(_low(total, fraction) + 1, total - 1)
