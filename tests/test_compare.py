"""Result-set equality: named edge cases, then random sets against a brute-force check."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.compare import compare_results, exact_difference
from tallyhouse.plans import comparing
from tallyhouse.plans.star import Star
from tallyhouse.sources.tables import dealt

CELL = "struct<kind: int, num: double, txt: string>"
SCHEMA = f"case_id long, cells array<{CELL}>"


def cell(value):
    if value is None:
        return (1, None, None)
    if isinstance(value, (int, float)):
        return (0, float(value), None)
    return (2, None, value)


def frame(spark, cases):
    rows = [(case, [cell(v) for v in row]) for case, result in cases.items() for row in result]
    return spark.createDataFrame(rows, SCHEMA)


def verdicts(spark, golds, guesses, **options):
    cases = spark.createDataFrame([(c,) for c in golds], "case_id long")
    found = compare_results(cases, frame(spark, golds), frame(spark, guesses), **options).collect()
    return {r.case_id: (r.is_equal, r.reason, r.row_no, r.col_no) for r in found}


EQUAL = (1, "equal", -1, -1)
EDGES = [
    ("identical", [[1, "a"], [2, "b"]], [[1, "a"], [2, "b"]], EQUAL),
    ("half a percent", [[100.0]], [[100.5]], EQUAL),
    ("five percent", [[100.0]], [[105.0]], (0, "value", 0, 0)),
    ("decimal against double", [[4.0888]], [[4.0888019]], EQUAL),
    ("row order", [[1], [2], [3]], [[3], [1], [2]], EQUAL),
    ("row count", [[1], [2]], [[1]], (0, "row count", -1, -1)),
    ("a column more", [[1, "a"], [2, "b"]], [[1, "a", 9], [2, "b", 9]], (0, "col count", 0, -1)),
    ("a column less", [[1, "a", 9]], [[1, "a"]], (0, "col count", 0, -1)),
    ("NULL with NULL", [[None, 1]], [[None, 1]], EQUAL),
    ("NULL with zero", [[None]], [[0]], (0, "value", 0, 0)),
    ("both empty", [], [], (1, "both empty", -1, -1)),
    ("text is exact", [["SP"]], [["sp"]], (0, "value", 0, 0)),
    ("number with text", [[1]], [["1"]], (0, "value", 0, 0)),
    ("second row", [[1, "x"], [2, "y"]], [[1, "x"], [99, "y"]], (0, "value", 1, 0)),
    ("copies count", [[1], [1], [2]], [[1], [2], [2]], (0, "value", 1, 0)),
    ("zeros", [[0.0]], [[1e-12]], EQUAL),
]


@pytest.mark.parametrize("block", [2, 1_000_000])
def test_edges(spark, block):
    golds = {i: e[1] for i, e in enumerate(EDGES)}
    guesses = {i: e[2] for i, e in enumerate(EDGES)}
    got = verdicts(spark, golds, guesses, rows_per_block=block)
    assert got == {i: e[3] for i, e in enumerate(EDGES)}, [e[0] for i, e in enumerate(EDGES) if got[i] != e[3]]


def test_trimming_accepts_trailing_columns(spark):
    golds = {1: [[1, "a"], [2, "b"]], 2: [[1, "a"]]}
    guesses = {1: [[1, "a", 5], [2, "b", 6]], 2: [[1, "z", 5]]}
    got = verdicts(spark, golds, guesses, trim=True)
    assert got == {1: EQUAL, 2: (0, "value", 0, 1)}


def order(row):
    rank = {int: 0, float: 0, type(None): 1, str: 2}
    rough = [(rank[type(v)], round(v, 6) if rank[type(v)] == 0 else (v or "")) for v in row]
    return rough, [str(v) for v in row]


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) / max(abs(a), abs(b), 1e-9) <= 0.01
    return a == b


def brute(gold, guess):
    if len(gold) != len(guess):
        return (0, "row count", -1, -1)
    for i, (a, b) in enumerate(zip(sorted(gold, key=order), sorted(guess, key=order))):
        for j, (x, y) in enumerate(zip(a, b)):
            if not close(x, y):
                return (0, "value", i, j)
    return EQUAL


@pytest.mark.parametrize("block", [2, 7, 1_000_000])
def test_random_sets_with_many_copies(spark, block):
    rng = random.Random(block)
    golds, guesses = {}, {}
    for case in range(40):
        size = rng.choice([1, 4, 30])
        rows = [[rng.choice([1, 1, 1, 2, 50.0, None]), rng.choice(["a", "b", None])] for _ in range(size)]
        other = [list(r) for r in rows]
        rng.shuffle(other)
        if case % 3 == 0:
            spot = rng.randrange(size)
            other[spot][rng.randrange(2)] = rng.choice([1.004, 77, "c", None])
        golds[case], guesses[case] = rows, other
    got = verdicts(spark, golds, guesses, rows_per_block=block)
    assert got == {c: brute(golds[c], guesses[c]) for c in golds}


def test_exact_difference_counts_copies(spark):
    gold = frame(spark, {1: [[1], [1], [2]], 2: [["a"]]})
    guess = frame(spark, {1: [[1], [2], [2], [3]], 2: [["a"]]})
    rows = exact_difference(gold, guess).collect()
    assert [(r.case_id, r.gold_only, r.predicted_only) for r in rows] == [(1, 1, 2)]


def test_rows_are_dealt_to_tasks_by_their_number(spark, folder):
    """Four shuffle partitions are set here: a task's share of the answers must not grow with the table."""
    answer = comparing.gold_answer(Star(spark, folder), rows_per_task=100)
    total = answer.count()
    for side in (comparing.gold_rows(answer), comparing.predicted_rows(answer)):
        per_task = [r["count"] for r in side.groupBy(F.spark_partition_id()).count().collect()]
        assert total > 4 * 200 and max(per_task) < 200
    assert dealt(spark.range(0), ["id"]).count() == 0
