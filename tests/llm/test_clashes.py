"""Input columns with the names of helpers, or of results in another case, change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import language, mixing, packing, quality, sharding
from tallyhouse.llm.common import word_count

HELPERS = (
    "row found judged scored key at n times copy origin content rows parts _row _block _place _key _size _sent _finish _id "
    "_tokens _j _s _rows _source _text _times _copy _rank _ends _span _upto"
).split()

OPERATORS = {
    "shard_rows": (lambda f: sharding.shard_rows(f, 3), ["shard", "slot"]),
    "best_fit": (
        lambda f: packing.best_fit(f, F.length("text")),
        ["piece", "piece_start", "piece_length", "bin_id", "capacity", "bin_offset"],
    ),
    "mix": (lambda f: mixing.mix(f.withColumn("words", word_count("text")), "doc_id", "source", "words"), ["source_size", "target", "taken"]),
    "identify": (lambda f: language.identify(f, {"en": b" the cat sat on the mat ", "de": b" der hund und die katze "}), ["lang_pred", "score", "accepted"]),
    "score_quality": (
        lambda f: quality.score_quality(f, quality.Model(None, None, 0.5)), ["text_quality", "meta_quality", "quality_score", "accepted"]
    ),
}


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i, f"the cat {i} sat on the mat " * (1 + i % 5), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(None, None, None, None), (3, "the cat 3 sat on the mat " * 4, "en", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return frame.withColumn("n_chars", F.length("text").cast("bigint")).coalesce(1)


def values(frame, columns):
    return sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect())))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators(plain, name):
    operator, added = OPERATORS[name]
    clashing = plain.select("*", *[F.lit("x").alias(n) for n in HELPERS], *[F.lit("y").alias(a.title()) for a in added])
    want, got = operator(plain), operator(clashing)
    assert [c for c in got.columns if c not in want.columns] == HELPERS
    assert values(got, want.columns) == values(want, want.columns)
    assert {tuple(r) for r in got.select(*HELPERS).collect()} == {("x",) * len(HELPERS)}


@pytest.mark.parametrize("stage", [corpus_pipeline.keep_one_per_group, corpus_pipeline.mix_sources])
def test_pipeline_stages(spark, folder, plain, stage):
    names = HELPERS + ["Kept", "Size", "Taken", "Component_Id", "N_Shingles"]
    clashing = plain.select("*", *[F.lit("x").alias(n) for n in names])
    want, got = stage(spark, plain, folder), stage(spark, clashing, folder)
    assert got.columns == clashing.columns
    assert values(got, plain.columns) == values(want, plain.columns)
    assert {tuple(r) for r in got.select(*names).collect()} == {("x",) * len(names)}
