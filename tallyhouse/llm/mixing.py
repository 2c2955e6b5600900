"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, up to ``repeats`` times over. A document
finishes at (words its source has sent, its own included) / (the source's target). All
documents of all sources are ranged by that finish time and the line is cut where the words
reach the total budget, so every source has sent its target to within a document or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import bucket_bits, packed, place, quoted, running_sums, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2


def _key(source: Column) -> Column:
    """Sorts by code point with null last; never null."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sources: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """``sources`` (key, words), one row per source -> key, words, target.

    Weights go round by the order of the keys. A source takes at most ``repeats`` times its
    words; what it can't take goes to the others by weight, until no target is above its cap.
    """
    order = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    known = stored(
        sources.select("key", "words", weight.alias("weight"), (F.lit(repeats) * F.col("words")).alias("cap")), "mix-sources"
    )
    level, full = None, F.lit(False)
    while True:
        left, open_weight = known.agg(
            F.sum("words") * share - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        if left is None or not open_weight:
            break
        raised = left / open_weight
        if level is not None and raised <= level:
            break
        level = raised
        full = F.col("weight") * level > F.col("cap")
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level or 0)))
    return stored(known.select("key", "words", target.alias("target")), "mix-targets")


def mix(
    frame: DataFrame,
    id_col: str,
    source_col: str,
    size_col: str,
    weights=WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = 7,
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` (a multiple of the size) to every row.

    The shuffled order depends on the id and the size alone, so reruns agree. Rows alike in id,
    source and size are interchangeable. Documents of size 0 (null counts as 0) take no part:
    taken 0. A null source is a source of its own. Input columns named like the added ones, in any
    case, are replaced. ``share`` must not be above ``repeats``.
    """
    work, kept = packed(
        frame, ("source_size", "target", "taken"), _key=_key(F.col(quoted(source_col)).cast("string")),
        _size=F.coalesce(F.col(quoted(size_col)), F.lit(0)).cast("bigint"), _id=F.col(quoted(id_col)),
    )
    rows = stored(work.withColumn("_place", place(seed, F.col("_id"), F.col("_size"))), "mix-rows")
    sources = rows.groupBy(F.col("_key").alias("key")).agg(F.sum("_size").alias("words"))
    targets = source_targets(sources, weights, share, repeats)
    total = rows.count()
    bits = bucket_bits(total)
    queued = running_sums(rows, ["_key"], "_place", ["_id"], F.col("_size"), "_sent", bits)
    finish = [
        (F.col("source_size") * e + F.col("_sent") + F.col("_size")) / F.col("target") for e in range(repeats)
    ]
    line = stored(
        # Hints nothing: one row per source, so Spark broadcasts it if its size allows.
        queued.join(targets.select(F.col("key").alias("_key"), F.col("words").alias("source_size"), "target"), "_key")
        .withColumn(
            "_finish",
            F.when(F.col("_size") > 0, F.array(*finish)).otherwise(F.array().cast("array<double>")),
        )
        .drop("_sent"),
        "mix-line",
    )
    entries = line.select("_key", "_place", "_size", F.explode("_finish").alias("_at"))
    # Finish times run from 0 to no fixed end; t / (1 + t) ranges them over [0, 1).
    def span(at: Column) -> Column:
        return F.floor(at / (1 + at) * (1 << bits)).cast("bigint")

    ranged = entries.withColumn("_span", span(F.col("_at")))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    spans = ranged.groupBy("_span").agg(F.sum("_size").alias("words"))
    last = (
        spans.withColumn("upto", F.sum("words").over(Window.orderBy("_span")))
        .filter(F.col("upto") > F.lit(budget))
        .orderBy("_span")
        .select("_span", F.col("upto") - F.col("words"))
        .first()
    )
    taken = F.size("_finish")
    if last is not None:
        edge, before = last
        order = ["_at", "_key", "_place"]
        ahead = Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        cut = (
            ranged.filter(F.col("_span") == edge)
            .withColumn("_upto", F.sum("_size").over(ahead) + F.lit(before))
            .filter(F.col("_upto") <= F.lit(budget))
            .orderBy(*[F.col(c).desc() for c in order])
            .select(*order)
            .first()
        )

        def in_time(at: Column) -> Column:
            if cut is None:
                return span(at) < edge
            upto_cut = F.struct(at, F.col("_key"), F.col("_place")) <= F.struct(*[F.lit(v) for v in cut])
            return (span(at) < edge) | ((span(at) == edge) & upto_cut)

        taken = F.size(F.filter("_finish", in_time))
    sent = line.select("row", "source_size", "target", (F.col("_size") * taken).cast("bigint").alias("taken"))
    return sent.select(*kept, "source_size", "target", "taken")
