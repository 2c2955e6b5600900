from collections import Counter, defaultdict

import pytest

from tallyhouse.llm.mixing import mix
from tallyhouse.llm.queries import op6_fair_queue_mixing


def targets_by_hand(words):
    """Shares by weight, each stopped at twice its words, the excess dealt again by weight."""
    names = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in words)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left = {}, 1.5 * sum(words.values())
    while True:
        open_ = [s for s in names if s not in out]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 2 * words[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * words[s]
            left -= out[s]


def check_mix(rows):
    words, taken, longest, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        words[r["source"]] += r["size"] or 0
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"] or 0)
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"] or 0, 2 * (r["size"] or 0))
    for r in rows:
        assert r["source_size"] == words[r["source"]]
    for s, want in targets_by_hand(words).items():
        assert target[s] == pytest.approx(want, rel=1e-9)
        assert abs(taken[s] - want) <= longest[s] + 0.01 * want
    assert sum(taken.values()) <= 1.5 * sum(words.values()) + 1e-6


def test_query(spark, folder, documents):
    sources = {r["doc_id"]: r["source"] for r in documents.collect()}
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in documents.collect()}
    rows = [r.asDict() | {"source": sources[r["doc_id"]]} for r in op6_fair_queue_mixing(spark, folder).collect()]
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    check_mix(rows)
    again = {r["doc_id"]: r["taken"] for r in op6_fair_queue_mixing(spark, folder).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_hot_source_null_source_and_layout(spark):
    data = [(i, ["hot", "hot", None, "b", "😀", "～"][i % 6], (i * 7919) % 97) for i in range(4000)]
    frame = spark.createDataFrame(data, "doc_id bigint, source string, size bigint")
    rows = mix(frame.repartition(5), "doc_id", "source", "size").collect()
    assert len(rows) == 4000
    check_mix([r.asDict() for r in rows])
    other = mix(frame.repartition(3), "doc_id", "source", "size").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in other)


def test_served_in_order_of_finish_times(spark):
    """A source's taken documents are a prefix of its shuffled line, twice around."""
    frame = spark.createDataFrame([(i, "s" + str(i % 3), 10) for i in range(300)], "doc_id bigint, source string, size bigint")
    by = defaultdict(list)
    for r in mix(frame, "doc_id", "source", "size").collect():
        by[r["source"]].append(r["taken"])
    assert {s: sum(v) for s, v in by.items()} == {"s0": 2000, "s1": pytest.approx(833, abs=10), "s2": pytest.approx(1666, abs=10)}


def test_odd_rows(spark, odd, nothing):
    from tallyhouse.llm.common import word_count

    rows = mix(odd.withColumn("size", word_count("text")), "doc_id", "source", "size").collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mix(nothing.withColumn("size", word_count("text")), "doc_id", "source", "size").collect() == []
    empty = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id bigint, source string, size bigint")
    assert [r["taken"] for r in mix(empty, "doc_id", "source", "size").collect()] == [0, 0]
