import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import ann, vector_dedup
from tallyhouse.llm.queries import op4_multi_index_hashing, op7_int8_tile_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, id string, score string"


def rows_of(vectors, labels=None, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    labels = [0] * len(vectors) if labels is None else labels
    return [
        (i, None if v is None else [None if x is None else float(x) for x in v], label, "k", "i", "s")
        for i, v, label in zip(ids, vectors, labels, strict=True)
    ]


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def padded(v, width):
    return np.pad(np.asarray(v, dtype=np.float32).astype(np.float64), (0, width - len(v)))


def nearest_by_hand(rows, asks, k):
    seen = {(i, tuple(v)): v for i, v, *_ in rows if i is not None and usable(v)}
    width = max((len(v) for v in seen.values()), default=1)
    good = [(i, padded(v, width)) for (i, _), v in seen.items()]
    out = {}
    for q, x in good:
        if asks(q):
            scores = sorted((-float(x @ y), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(frame, asks, k):
    out = {}
    for r in sorted(ann.nearest(frame, "vec_id", "embedding", asks, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_recall_of_the_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in sorted(op4_multi_index_hashing(spark, folder).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, answers in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in answers if i in exact)
        assert [s for _, s in answers] == sorted((s for _, s in answers), reverse=True)


def test_inner_products_of_unequal_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 12)) * rng.uniform(0.5, 2, (1500, 1))
    rows = rows_of(vectors)
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 20)
    got = found(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20)
    assert recall(got, want) >= 0.9


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    index = ann.SubstringIndex(codes)
    for radius in (0, 3, 11, 22, 30, 64):
        at, apart = index.within(codes[17], radius)
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[17]) <= radius)
        assert at.tolist() == want.tolist() and (apart <= radius).all()
    assert len(index.at_least(codes[5], 0, 21)) >= 21 and len(index.at_least(codes[5], 0, 9999)) == 4000


def test_copies_ties_and_odd_vectors(spark):
    odd = [None, [], [0, 0, 0], [1, None, 0], [float("nan"), 1, 0], [float("inf"), 0, 0]]
    vectors = odd + [[1, 0, 0]] * 60 + [[1, 0, 0], [0, 1, 0], [2, 0], [0, 2, 0, 1], [-1, 0, 0]]
    rows = rows_of(vectors) + rows_of([[1, 0, 0], [1, 0, 0]], ids=[20, None])
    frame = spark.createDataFrame(rows, SCHEMA)
    want = nearest_by_hand(rows, lambda i: i % 4 == 0, 20)
    assert found(frame, F.col("vec_id") % 4 == 0, 20) == want
    few = rows_of([[1, 0], [0, 1], [1, 1]])
    assert found(spark.createDataFrame(few, SCHEMA), F.col("vec_id") >= 0, 20) == nearest_by_hand(few, lambda i: True, 20)
    assert found(spark.createDataFrame([], SCHEMA), F.col("vec_id") >= 0, 20) == {}


def links_by_hand(rows, threshold):
    good = [(i, v, label) for i, v, label, *_ in rows if i is not None and label is not None and usable(v)]
    width = max((len(v) for _, v, _ in good), default=1)
    unit = [padded(v, width) / np.linalg.norm(padded(v, width)) for _, v, _ in good]
    n, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and unit[a] @ unit[b] >= threshold:
                n[good[a][0]] += 1
                n[good[b][0]] += 1
                x, y = sorted((top(good[a][0]), top(good[b][0])))
                up[y] = x
    return {i: (n[i], top(i), top(i) == i) for i in n}


def linked(frame, threshold=0.98, **more):
    rows = vector_dedup.near_duplicate_vectors(frame, "vec_id", "embedding", "label", threshold, **more).collect()
    return {r["vec_id"]: tuple(r)[1:] for r in rows}


def test_query_links(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in op7_int8_tile_dedup(spark, folder).collect()} == links_by_hand(rows, 0.98)


@pytest.mark.parametrize("tile", [1024, 20])
def test_groups_of_near_copies(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((5, 16))
    vectors, labels = [], []
    for k in range(300):
        vectors.append(base[k % 5] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.2]))
        labels.append([0, 0, 0, 1, None][rng.integers(0, 5)])
    vectors += [base[0]] * 80 + [None, [], [0.0] * 16, [float("nan")] * 16, base[0] * 3]
    labels += [0] * 85
    rows = rows_of(vectors, labels)
    assert linked(spark.createDataFrame(rows, SCHEMA), tile=tile) == links_by_hand(rows, 0.98)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for scale in (1e-3, 1.0, 50.0):
        x, y = rng.standard_normal((200, 24)) * scale, rng.standard_cauchy((150, 24))
        cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
        bounds = vector_dedup.upper_bounds(vector_dedup.quantise(x), vector_dedup.quantise(y))
        assert (bounds >= cosine).all() and (bounds - cosine).max() < 0.2


def test_empty_and_null_ids(spark):
    assert linked(spark.createDataFrame([], SCHEMA)) == {}
    rows = rows_of([[1, 0], [1, 0]], ids=[None, 3])
    assert linked(spark.createDataFrame(rows, SCHEMA)) == {None: (0, None, True), 3: (0, 3, True)}
