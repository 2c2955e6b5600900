from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm.packing import CAPACITIES, best_fit, pack
from tallyhouse.llm.queries import op3_best_fit_packing


def check_bins(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        if r["piece_length"]:
            bins[r["bin_id"], r["capacity"]].append((r["bin_offset"], r["piece_length"]))
        else:
            assert r["bin_id"] is None and r["capacity"] is None and r["bin_offset"] is None
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        # Each bin is the smallest permitted length that holds its contents.
        assert capacity == min(c for c in capacities if c >= at)


def test_query(spark, folder, documents):
    rows = op3_best_fit_packing(spark, folder).collect()
    check_bins(rows, CAPACITIES)
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in documents.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["piece_start"], r["piece_length"]))
    assert set(pieces) == set(words)
    for i, parts in pieces.items():
        assert [p for p, _, _ in sorted(parts)] == list(range(len(parts)))
        assert sum(length for _, _, length in parts) == words[i]
        assert all(start == p * max(CAPACITIES) for p, start, _ in parts)


def test_bins_are_nearly_full():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(5.5, 1.2, 5000).astype(np.int64) + 1)
    bins, sizes, _ = pack(lengths)
    room = sum({int(b): int(c) for b, c in zip(bins, sizes, strict=True)}.values())
    assert lengths.sum() / room > 0.98


def test_best_fit_takes_the_tightest_bin():
    bins, sizes, offsets = pack(np.array([7, 5, 3, 5]), (10,))
    assert bins.tolist() == [0, 1, 0, 1] and sizes.tolist() == [10] * 4 and offsets.tolist() == [0, 0, 7, 5]


def test_least_cost_size_is_opened_and_bins_shrink():
    bins, sizes, _ = pack(np.array([3]), (4, 8, 16))
    assert sizes.tolist() == [4]
    bins, sizes, _ = pack(np.array([5, 5, 5]), (8, 16))
    assert sizes.tolist() == [16, 16, 16] and set(bins.tolist()) == {0}
    assert pack(np.zeros(0, dtype=np.int64))[0].tolist() == []


def test_blocks_share_no_bin_and_odd_rows(spark, odd, nothing):
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " "))
    rows = best_fit(odd, F.when(F.trim("text") == "", 0).otherwise(words), (16, 64), block_pieces=20).collect()
    check_bins(rows, (16, 64))
    assert sum(r["piece_length"] for r in rows if r["doc_id"] == 6) == 9000
    assert best_fit(nothing, F.lit(1)).collect() == []
    many = best_fit(spark.range(900), F.lit(7), (16,), block_pieces=100).collect()
    check_bins(many, (16,))
    assert len(many) == 900
