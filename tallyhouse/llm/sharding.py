"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

1. Rows keep the physical partition they are read from, cut into blocks of bounded size.
2. How many rows each block sends to each shard is drawn exactly: the matrix of a uniform
   permutation with these row and column totals is multivariate hypergeometric. It is drawn
   top down over a tree of blocks (64 children a node), so it needs log64(blocks) small steps.
3. Each block permutes its rows and deals them out by its row of the matrix.
4. After the exchange each shard permutes its rows again, which gives the slots.

Only DataFrame functions are used. Blocks, tree nodes and slot buckets are all bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import bucket_bits, packed, place, running_sums, stored

BLOCK_ROWS = 65_536
FANOUT_BITS = 6
ROW, BLOCK = "_row", "_block"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(reach: Column) -> Column:
    return F.when(reach < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), reach))


def _ratios(d: Column, i: Column) -> tuple[Column, Column]:
    """p(mode+i) / p(mode+i-1) and p(mode-i) / p(mode-i+1), 0 outside the range."""
    up, down, rest = d["mode"] + i, d["mode"] - i, d["all"] - d["good"] - d["drawn"]
    rise = F.when(up > d["hi"], F.lit(0.0)).otherwise(
        (d["good"] - up + 1).cast("double") * (d["drawn"] - up + 1) / (up.cast("double") * (rest + up))
    )
    fall = F.when(down < d["lo"], F.lit(0.0)).otherwise(
        (down + 1).cast("double") * (rest + down + 1) / ((d["good"] - down).cast("double") * (d["drawn"] - down))
    )
    return rise, fall


def hypergeometric(population: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` rows out of ``population`` are among the ``good`` ones.

    Inverts the distribution outwards from its mode. Weights are relative to the mode's and
    divided by their own sum, so no factorials enter. Twelve deviations each side cover all
    that doubles can tell from 0.
    """

    def prepared(d: Column) -> Column:
        n, k, m = d["all"], d["good"], d["drawn"]
        lo, hi = F.greatest(F.lit(0).cast("bigint"), m - (n - k)), F.least(m, k)
        mode = F.floor((m + 1).cast("double") * (k + 1) / (n + 2)).cast("bigint")
        share = F.when(n > 0, k / n).otherwise(F.lit(0.0))
        spread = F.sqrt(m * share * (1 - share))
        return F.struct(
            n.alias("all"), k.alias("good"), m.alias("drawn"), d["u"].alias("u"), lo.alias("lo"), hi.alias("hi"),
            F.greatest(lo, F.least(hi, mode)).alias("mode"), (12 * spread + 32).cast("bigint").alias("wide"),
        )

    def bounded(d: Column) -> Column:
        reach = F.least(F.greatest(d["hi"] - d["mode"], d["mode"] - d["lo"]), d["wide"])
        return F.struct(*[d[c].alias(c) for c in ("all", "good", "drawn", "u", "lo", "hi", "mode")], reach.alias("reach"))

    def weighed(d: Column) -> Column:
        one = F.lit(1.0)

        def step(a: Column, i: Column) -> Column:
            rise, fall = _ratios(d, i)
            up, down = a["up"] * rise, a["down"] * fall
            return F.struct(up.alias("up"), down.alias("down"), (a["sum"] + up + down).alias("sum"))

        start = F.struct(one.alias("up"), one.alias("down"), one.alias("sum"))
        return F.aggregate(_steps(d["reach"]), start, step, lambda a: a["sum"])

    def found(d: Column, total: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            rise, fall = _ratios(d, i)
            up, down = a["up"] * rise, a["down"] * fall
            at = (
                F.when(a["left"] < 0, a["at"])
                .when(a["left"] < up, d["mode"] + i)
                .when(a["left"] < up + down, d["mode"] - i)
                .otherwise(a["at"])
            )
            left = F.when(a["left"] < 0, a["left"]).when(a["left"] < up + down, F.lit(-1.0)).otherwise(a["left"] - up - down)
            return F.struct(up.alias("up"), down.alias("down"), left.alias("left"), at.alias("at"))

        start = F.struct(
            F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), (d["u"] * total - 1).alias("left"), d["mode"].alias("at")
        )
        return F.aggregate(_steps(d["reach"]), start, step, lambda a: a["at"])

    given = F.struct(
        population.cast("bigint").alias("all"), good.cast("bigint").alias("good"), drawn.cast("bigint").alias("drawn"),
        uniform.alias("u"),
    )
    return _let(
        given,
        lambda d: _let(prepared(d), lambda e: _let(bounded(e), lambda f: _let(weighed(f), lambda total: found(f, total)))),
    )


def _uniform(seed: int, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def _dealt(left: Column, children: Column, level: int, seed: int) -> Column:
    """Shares of the shards for each child in turn: array of (node, counts)."""
    none = F.array().cast("array<bigint>")

    def per_child(acc: Column, child: Column) -> Column:
        def per_shard(a: Column, j: Column) -> Column:
            here = F.element_at(acc["left"], j)
            draw = hypergeometric(a["pool"], here, a["want"], _uniform(seed, F.lit(level), child["node"], j))
            return _let(
                draw,
                lambda x: F.struct(
                    (a["pool"] - here).alias("pool"), (a["want"] - x).alias("want"),
                    F.concat(a["counts"], F.array(x)).alias("counts"),
                ),
            )

        pool = F.aggregate(acc["left"], F.lit(0).cast("bigint"), lambda s, x: s + x)
        start = F.struct(pool.alias("pool"), child["n"].alias("want"), none.alias("counts"))
        counts = F.aggregate(F.sequence(F.lit(1), F.size(acc["left"])), start, per_shard, lambda a: a["counts"])
        return _let(
            counts,
            lambda c: F.struct(
                F.zip_with(acc["left"], c, lambda x, y: x - y).alias("left"),
                F.concat(acc["out"], F.array(F.struct(child["node"].alias("node"), c.alias("counts")))).alias("out"),
            ),
        )

    out = F.array().cast("array<struct<node:bigint,counts:array<bigint>>>")
    return F.aggregate(children, F.struct(left.alias("left"), out.alias("out")), per_child, lambda a: a["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int, blocks: int) -> DataFrame:
    """``sizes`` (node, n), nodes below ``blocks`` -> (node, counts): rows of each node per shard."""
    levels = 1
    while blocks > 1 << (FANOUT_BITS * levels):
        levels += 1
    total = F.sum("n")
    known = sizes.agg(total.alias("n")).select(
        F.lit(0).cast("bigint").alias("node"),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")),
            lambda j: F.floor(F.col("n") / shards).cast("bigint") + F.when(j < F.col("n") % shards, 1).otherwise(0),
        ).alias("counts"),
    )
    for level in range(levels - 1, -1, -1):
        here = sizes.groupBy(F.shiftright("node", FANOUT_BITS * level).alias("node")).agg(total.alias("n"))
        families = here.groupBy(F.shiftright("node", FANOUT_BITS).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "n"))).alias("children")
        )
        drawn = families.join(known.withColumnRenamed("node", "parent"), "parent").select(
            F.explode(_dealt(F.col("counts"), F.col("children"), level, seed)).alias("d")
        )
        known = stored(drawn.select("d.node", "d.counts"), "shard-matrix")
    return known


def shard_rows(frame: DataFrame, shards: int, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``shard`` (0 to shards-1) and ``slot`` (0, 1, 2, ... in each shard) to every row.

    The order is a uniform random permutation for the seed and the frame's partitions; shard
    sizes differ by one row at most. Rows are counted, never compared: nulls, repeated rows
    and empty texts are dealt like any other. Input columns named ``shard`` or ``slot``, in any
    case, are replaced. An empty frame gives an empty one.
    """
    work, kept = packed(frame, ("shard", "slot"), **{ROW: F.monotonically_increasing_id()})
    rows = stored(work, "shard-rows")
    part, piece = F.shiftright(ROW, 33), F.floor(F.col(ROW).bitwiseAND((1 << 33) - 1) / block_rows).cast("bigint")
    total, parts, wide = rows.agg(F.count("*"), F.max(part), F.max(piece)).first()
    if not total:
        return rows.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    blocked = rows.withColumn(BLOCK, part * (wide + 1) + piece)
    sizes = stored(blocked.groupBy(F.col(BLOCK).alias("node")).agg(F.count("*").alias("n")), "shard-sizes")
    matrix = communication_matrix(sizes, shards, seed, (parts + 1) * (wide + 1))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda j: F.aggregate(F.slice("counts", 1, j), F.lit(0).cast("bigint"), lambda s, x: s + x),
    )
    first = Window.partitionBy(BLOCK).orderBy(place(seed + 1, F.col(ROW)), ROW)
    dealt = (
        blocked.withColumn("_rank", F.row_number().over(first) - 1)
        .join(matrix.select(F.col("node").alias(BLOCK), ends.alias("_ends")), BLOCK)
        .select(
            "row", ROW, place(seed + 2, F.col(ROW)).alias("_place"),
            F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"),
        )
    )
    return running_sums(
        stored(dealt, "shard-dealt"), ["shard"], "_place", [ROW], F.lit(1), "slot", bucket_bits(total // shards)
    ).select(*kept, "shard", "slot")
