"""Vector codes against a plain version in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyhouse.llm import vector_codes

NAN, INF = float("nan"), float("inf")


def brute(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)} and the hash; rows are (id, vector), ids may repeat."""
    kept = [(i, v, k) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [([[math.floor(4096 * x) for x in v[p * size : (p + 1) * size]] for p in range(parts)], k) for _, v, k in kept]
    books = [[c[p] for c, _ in cut[:entries]] for p in range(parts)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = [list(map(list, b)) for b in books]
        for p in range(parts):
            owner = [near(c[p], books[p])[0] for c, _ in cut]
            for e in range(len(books[p])):
                mine = [c[p] for (c, _), o in zip(cut, owner, strict=True) if o == e]
                if mine:
                    new[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
        books = new
    out = {}
    for c, k in cut:
        found = [near(c[p], books[p]) for p in range(parts)]
        out[k] = ("".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 16])
def test_nearest_is_exact_and_ties_go_to_the_lower_entry(width):
    rng = np.random.default_rng(width)
    for spread in (2, 3000):
        parts, entries = rng.integers(-spread, spread, (400, width)), rng.integers(-spread, spread, (17, width))
        index, distance = vector_codes.nearest(parts, entries)
        far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_sequency_counts_sign_changes():
    signs = vector_codes.walsh_hadamard(np.eye(8, dtype=np.int64))[:, vector_codes.sequency_order(8)]
    assert (np.diff(signs, axis=0) != 0).sum(axis=0).tolist() == list(range(8))
    assert (signs.T @ signs == 8 * np.eye(8)).all()


@pytest.mark.parametrize("entries", [16, 3])
def test_like_a_plain_version(spark, entries):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), [rng.gauss(0, 1) for _ in range(16)], rng.choice(["a", "b", None])) for _ in range(90)]
    rows += [(1000, [0.0] * 16, "b"), (1001, [0.0] * 16, "b"), rows[0], rows[0], (5, None, "a"), (0, [NAN] + [0.0] * 15, None)]
    rows += [(0, [None] + [1.0] * 15, "a"), (0, [-INF] + [1.0] * 15, "a")]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>, label string").repartition(3)
    want, digest = brute([r[:2] for r in rows], entries=entries)
    got = vector_codes.code_vectors(frame, "id", "v", "label", entries=entries).collect()
    expected = sorted((str(rows[k][0]), str(rows[k][2]), *want[k]) for k in want)
    assert sorted((str(r.id), str(r.label), r.code, r.error) for r in got) == expected
    sums = {}
    for k in want:
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + want[k][1]
    assert all(r.label_error == sums[r.label] and r.codebooks_sha256 == digest for r in got)


def test_odd_tables(spark):
    names = "vec_id int, embedding array<float>, label double, code string, error int, part int, vector int, of int, id int"
    rows = [(1, [0.5] * 8, NAN, "x", 1, 1, 1, 1, 1), (None, [-0.5] * 8, NAN, "x", 1, 1, 1, 1, 1), (2, [0.25] * 9, None, "x", 1, 1, 1, 1, 1)]
    frame = spark.createDataFrame(rows, names)
    got = vector_codes.code_vectors(frame, "vec_id", "embedding", "label").collect()
    # The vector of another length than the first one's goes; the two that stay are their own entries.
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in sorted(got, key=lambda r: r.code)] == [(1, "00" * 8, 0, 0), (None, "01" * 8, 0, 0)]
    assert vector_codes.code_vectors(frame.limit(0), "vec_id", "embedding", "label").count() == 0
    uneven = spark.createDataFrame([(i, [float(i)] * 9) for i in range(40)], "i int, v array<double>").selectExpr("*", "i % 2 as label")
    padded = spark.createDataFrame([(i, [float(i)] * 9 + [0.0] * 7) for i in range(40)], "i int, v array<double>").selectExpr("*", "i % 2 as label")
    a, b = (sorted(map(tuple, vector_codes.code_vectors(f, "i", "v", "label").drop("codebooks_sha256").collect())) for f in (uneven, padded))
    assert a == b and len(a) == 40
    empty = spark.createDataFrame([(1, [], 0)], "i int, v array<double>, label int")
    assert vector_codes.code_vectors(empty, "i", "v", "label").first().error == 0


def test_large_components_are_exact_or_an_error():
    big = np.array([[4000.0] * 8, [-4000.0] * 8])
    cut = vector_codes.whole_parts(big, 4096, 1)
    index, distance = vector_codes.nearest(cut[:, 0], cut[:1, 0])
    assert index.tolist() == [0, 0] and distance.tolist() == [0, 8 * (8000 * 4096) ** 2]
    with pytest.raises(OverflowError):
        vector_codes.whole_parts(np.array([[1e30] * 8]), 4096, 1)
