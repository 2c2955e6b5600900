import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import minhash
from tallyhouse.llm.components import components
from tallyhouse.llm.queries import op10_bbit_minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def least_linked(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def by_hand(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    where = defaultdict(list)
    links = []
    for i, own in sets.items():
        common = Counter(j for s in own for j in where[s])
        links += [(i, j) for j, k in common.items() if 100 * k >= percent * (len(own) + len(sets[j]) - k)]
        for s in own:
            where[s].append(i)
    return {i: (len(sets[i]), c, i == c) for i, c in least_linked(sets, links).items()}


def result(frame, *args):
    return {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(frame, "doc_id", "text", *args).collect()}


def test_query_against_all_pairs(spark, folder, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_bbit_minhash(spark, folder).collect()}
    assert got == by_hand(texts, 3, 85)


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies of one text, some too far from all others, and exact copies."""
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(90)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 10**6))
        texts[i] = " ".join(words)
    for i in range(160, 220):
        texts[i] = " ".join(rng.choice(base) for _ in range(rng.randint(1, 60)))
    for i in range(220, 260):
        texts[i] = texts[i - 220]
    return texts


def test_crowd(spark, crowd, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    frame = spark.createDataFrame(list(crowd.items()), "doc_id bigint, text string")
    assert result(frame, 3, 85) == by_hand(crowd, 3, 85)


def test_tiles_alone_find_every_link(spark, crowd, monkeypatch):
    """Without a hub round everything is left to the tiles."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(minhash, "TILE", 16)
    frame = spark.createDataFrame(list(crowd.items()), "doc_id bigint, text string")
    assert result(frame, 5, 80) == by_hand(crowd, 5, 80)


def test_short_hashes_that_meet_cost_no_link(spark, crowd, monkeypatch):
    """With ten bits nearly every set has shingles that meet, its own and others'."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(minhash, "SMALL_BITS", 10)
    frame = spark.createDataFrame(list(crowd.items()), "doc_id bigint, text string")
    assert result(frame, 3, 85) == by_hand(crowd, 3, 85)


def test_two_tiles_of_equal_size_keep_links_to_lower_ids():
    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(4)]
    own[2] = own[1]
    marks = np.stack([minhash.signature(minhash.minima(s)) for s in own])
    small = [np.unique((s >> np.uint64(32)).astype("<u4")) for s in own]
    cid = np.array([1, 9, 5, 7])
    n = np.array([len(s) for s in own])
    for side in ([0, 0, 2, 2], [2, 2, 0, 0]):
        found = minhash._links_between(85, np.array(side), cid, np.array([1, 1, 5, 7]), n, marks, small)
        assert [set(f) for f in found] == [{9, 5}]
    assert minhash._links_between(85, np.ones(4), cid, cid, n, marks, small) == [(5, 9)]


def test_estimate_corrects_for_chance(spark):
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.85, 1.0):
        got = []
        for _ in range(30):
            both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            n = int(1000 * share)
            other = np.concatenate([both[:n], rng.integers(0, 2**63, 1000 - n, dtype=np.uint64)])
            marks = [minhash.signature(minhash.minima(x))[None, :] for x in (both, other)]
            got.append(minhash.estimates(*marks)[0, 0])
        assert abs(np.mean(got) - n / (2000 - n)) < 0.03
    a, b = ([int(x) for x in m[0].view(np.int64)] for m in marks)
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert frame.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0] == got[-1]


def test_odd_rows(odd, nothing):
    rows = minhash.near_duplicates(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(tuple(r)[1:])
    assert by[1] == [(10, 1, True)] and by[2] == [(10, 1, False)] * 2
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[None] == [(4, None, True)] and by[6] == [(1, 6, True)] and by[7] == [(1, 7, True)]
    assert minhash.near_duplicates(nothing, "doc_id", "text").collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    one, two = "a b c d e f g h", "k l m n o p q r"
    frame = spark.createDataFrame([(5, one), (5, two), (3, two), (9, one)], "doc_id bigint, text string")
    rows = minhash.near_duplicates(frame, "doc_id", "text", 3, 85).collect()
    assert {r["component_id"] for r in rows} == {3}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == least_linked(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
