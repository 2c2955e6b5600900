"""Positions, numbers and percentiles against brute force, with blocks far smaller than groups."""

import random
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse.operators.ordered import numbered, ordered_runs, percentiles


def skewed(seed, n=400):
    """A third of all rows share one value, most rows one group."""
    rng = random.Random(seed)
    return [
        (rng.choice(["big"] * 5 + ["mid", "tiny"]), 7.0 if rng.random() < 0.34 else round(rng.random() * 90, 1))
        for _ in range(n)
    ]


@pytest.mark.parametrize("block", [2, 5, 40, 100_000])
def test_runs_start_after_all_smaller_rows(spark, block):
    rows = skewed(block)
    frame = spark.createDataFrame(rows, "g string, v double")
    counted = frame.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r.g, r.v): (r.start, r.n) for r in ordered_runs(counted, ["g"], F.col("v"), {"n": "start"}, block).collect()}
    counts = Counter(rows)
    assert got == {
        (g, v): (sum(c for (g2, v2), c in counts.items() if g2 == g and v2 < v), n) for (g, v), n in counts.items()
    }


@pytest.mark.parametrize("block", [3, 100_000])
def test_numbers_follow_the_key(spark, block):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 300)
    rows = [(rng.choice("ab"), k) for k in keys]
    got = {(r.g, r.k): r.no for r in numbered(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", "no", block).collect()}
    expected = {}
    for g in "ab":
        for i, k in enumerate(sorted(k for g2, k in rows if g2 == g)):
            expected[g, k] = i + 1
    assert got == expected


def interpolated(values, share):
    values = sorted(values)
    place = (len(values) - 1) * share
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("block", [1, 20, 100_000])
def test_percentiles_interpolate(spark, block):
    rng = random.Random(block)
    # Values of every size and sign, many of them equal, and groups that one bin holds.
    wide = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(300)]
    close = [("close", 5 + rng.randrange(1000) * 1e-12) for _ in range(300)]
    ends = [("ends", v) for v in [float("-inf"), -1.0, -0.0, 0.0, 0.0, 5e-324, 1.0, float("inf")]]
    rows = skewed(9) + wide + close + ends + [("one", 3.5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in percentiles(frame, ["g"], "v", {"p50": 0.5, "p95": 0.95}, block).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == pytest.approx(median(values))
        assert got[g][1] == pytest.approx(interpolated(values, 0.95))


def test_no_array_grows_with_the_group(spark):
    """Thousands of blocks in one group: right answers, and splitters in arrays of bounded length."""
    from tallyhouse.operators import ordered

    keys = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_011).alias("k"), F.lit(1).alias("n"))
    runs = ordered_runs(keys, ["g"], F.col("k"), {"n": "start"}, rows_per_block=4, fanout=40)
    wrong = runs.join(runs.select("k").withColumn("r", F.row_number().over(Window.orderBy("k")) - 1), "k").where("r <> start")
    assert wrong.count() == 0
    blocks = ordered._blocked(keys, ["g"], F.col("k"), 4, 40)
    assert blocks.select("_coarse", "_fine").distinct().count() > 3_000
    coarse, fine = blocks.agg(F.max("_coarse"), F.max("_fine")).first()
    # About 125 coarse keys and 40 fine ones inside each; far below the 5 000 there are.
    assert coarse < 250 and fine < 500
