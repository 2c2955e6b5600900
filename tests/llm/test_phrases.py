"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import phrases


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts_of(rows, longest):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces_of(text):
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                found.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return found, totals


def brute(rows, longest=3, threshold=10, top=2000):
    found, totals = counts_of(rows, longest)
    often = {p: a for p, a in found.items() if a >= threshold and " " in p[1]}
    out = {}
    for (lang, phrase), a in often.items():
        words = phrase.split(" ")
        if any(l == lang and f" {phrase} " in f" {p} " and p != phrase and 100 * b >= 50 * a for (l, p), b in often.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, " ".join(words[:k])], found[lang, " ".join(words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
        for lang, best in out.items() for i, (score, a, p, left, right) in enumerate(sorted(best)[:top])
    }


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "sat", "on", "mat", "ÄRA", "ära", "new", "york", "city", "x\u00a0y", "\x1c", "don't", "naïve"]
    weights = [9, 9, 5, 5, 5, 5, 1, 1, 3, 3, 3, 1, 1, 1, 2]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!", ";", ": "]
    rows = []
    for _ in range(n):
        text = "".join(w + rng.choice(gaps) for w in rng.choices(words, weights, k=rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("de", " \t\n.;"), ("fr", "only here"), ("und", "the cat sat"), *rows[:5]]


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = phrases.collocations(frame, F.col("lang"), F.col("text"), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in found.collect()}


@pytest.mark.parametrize(
    "options",
    [{}, {"shards": 1}, {"shards": 4, "block_tokens": 200, "task_tokens": 300}, {"longest": 5, "threshold": 4, "shards": 3, "block_tokens": 50}, {"top": 3}],
    ids=str,
)
def test_like_plain_counting(spark, options):
    rows = texts(len(options))
    plain = {k: v for k, v in options.items() if k in ("longest", "threshold", "top")}
    want = brute(rows, **plain)
    assert want and run(spark, rows, **options) == want


def test_long_texts_are_cut_without_losing_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64)
    rows = [("en", "a b c d e " * 2000 + "x" * 5000 + ". a b"), ("en", "long " + "w" * 100_000)]
    assert run(spark, rows, block_tokens=100) == brute(rows)


@pytest.mark.parametrize("wrong", [1.0, 0.3])
def test_counts_stay_right_when_bit_tables_err(spark, monkeypatch, wrong):
    """Tables that take far too many phrases for frequent ones cost work, not results."""
    plain = phrases.bit_table

    def crowded(*args):
        bits, table = plain(*args)
        rng = np.random.default_rng(5)
        more = rng.integers(0, 1 << 63, len(table), dtype=np.uint64) & rng.integers(0, 1 << 63, len(table), dtype=np.uint64)
        return bits, table | (np.full(len(table), 2**64 - 1, dtype=np.uint64) if wrong == 1.0 else more)

    monkeypatch.setattr(phrases, "bit_table", crowded)
    rows = texts(9)
    assert run(spark, rows, shards=3, longest=4, threshold=6, block_tokens=300) == brute(rows, longest=4, threshold=6)


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 10**13
    counted = [(1, "en", "p", big + 7), (1, "en", "q", big + 11), (2, "en", "p q", big + 3)]
    frequent = spark.createDataFrame(counted, "k int, lang string, phrase string, a bigint")
    totals = spark.createDataFrame([("en", 5 * big)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a, **k: (frequent, totals))
    row = phrases.collocations(frequent, F.col("lang"), F.col("phrase")).first()
    assert row.score == 1000000 * (big + 3) ** 2 // ((big + 7) * (big + 11))


def test_hashes_agree_with_spark(spark):
    rows = [("en", "the cat"), ("de", "über alles"), ("", "x y")]
    frame = spark.createDataFrame(rows, "lang string, phrase string")
    for (lang, phrase), row in zip(rows, frame.select(phrases._phrase_hash(2).alias("two")).collect(), strict=True):
        hashes = phrases.word_hashes(lang, [w.encode() for w in phrase.split(" ")])
        folded = phrases.fold(phrases.fold(np.array([42], dtype=np.uint64), hashes[:1]), hashes[1:])
        assert int(folded.view(np.int64)[0]) == row.two


def test_odd_tables(spark, odd, nothing):
    found = phrases.collocations(odd, F.col("lang"), F.col("text"))
    assert {(r.lang, r.phrase) for r in found.collect()} == {("en", "word word word")}
    assert phrases.collocations(nothing, F.col("lang"), F.col("text")).count() == 0
