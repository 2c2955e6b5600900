from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm.queries import op2_hypergeometric_shards
from tallyhouse.llm.sharding import communication_matrix, hypergeometric, shard_rows


def check_law(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards))
    per = [sizes.get(s, 0) for s in range(shards)]
    assert max(per) - min(per) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, folder, documents):
    import zlib

    rows = op2_hypergeometric_shards(spark, folder).collect()
    check_law(rows, 24)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_many_blocks_and_partitions(spark):
    frame = spark.range(5000).repartition(7).withColumn("shard", F.lit("clash"))
    rows = shard_rows(frame, 24, block_rows=10).collect()
    assert sorted(r["id"] for r in rows) == list(range(5000))
    check_law(rows, 24)


def test_every_row_may_go_anywhere(spark):
    """Mean place of a row over many seeds is the middle, and neighbours part."""
    frame = spark.range(300).repartition(3)
    places = np.zeros((12, 300))
    for seed in range(12):
        for r in shard_rows(frame, 4, seed=seed * 10, block_rows=40).collect():
            places[seed, r["id"]] = r["shard"] * 75 + r["slot"]
    assert abs(places.mean() - 149.5) < 1e-9
    assert abs(np.corrcoef(places.mean(axis=0), np.arange(300))[0, 1]) < 0.2
    assert np.abs(np.diff(places, axis=1)).mean() > 80


def test_hypergeometric_follows_the_distribution(spark):
    draws = (
        spark.range(20000).select(
            hypergeometric(F.lit(50), F.lit(20), F.lit(12), F.xxhash64("id") / F.lit(2.0**64) + 0.5).alias("x")
        ).groupBy("x").count().collect()
    )
    from math import comb

    for r in draws:
        want = comb(20, r["x"]) * comb(30, 12 - r["x"]) / comb(50, 12) * 20000
        assert abs(r["count"] - want) < 5 * max(3.0, want**0.5)


def test_hypergeometric_edges(spark):
    for n, k, m, want in ((0, 0, 0, 0), (5, 0, 3, 0), (5, 5, 3, 3), (5, 2, 5, 2), (1, 1, 1, 1)):
        assert spark.range(1).select(hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.lit(0.7)).alias("x")).first()["x"] == want


def test_matrix_margins(spark):
    sizes = {b: (b * 37) % 91 for b in range(500) if b % 3}
    frame = spark.createDataFrame([(b, n) for b, n in sizes.items()], "node bigint, n bigint")
    rows = communication_matrix(frame, 5, 1, 500).collect()
    assert {r["node"]: sum(r["counts"]) for r in rows} == sizes
    total = sum(sizes.values())
    assert [sum(r["counts"][j] for r in rows) for j in range(5)] == [total // 5 + (j < total % 5) for j in range(5)]
    assert min(min(r["counts"]) for r in rows) >= 0


def test_odd_rows(odd, nothing):
    rows = shard_rows(odd, 3).collect()
    check_law(rows, 3)
    assert len(rows) == odd.count()
    assert Counter(r["doc_id"] for r in rows)[2] == 2
    assert shard_rows(nothing, 3).collect() == []


def test_no_python(spark, folder):
    text = op2_hypergeometric_shards(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
