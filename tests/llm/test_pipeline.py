"""Each stage on its own input against its operator's rules, and the whole run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallyhouse.llm.common import stored  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, folder, documents):
    out = [documents]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], folder), "test-" + name.replace(" ", "-")))
    return out


def test_filters_keep_whole_rows_of_their_input(spark, folder, outputs):
    for before, after in zip(outputs[:3], outputs[1:4], strict=True):
        assert after.columns == COLUMNS
        assert after.exceptAll(before).count() == 0
        assert 0.8 * before.count() <= after.count() <= before.count()


def test_rejected_and_kept_by_label(spark, folder, outputs):
    kept = {r["doc_id"] for r in outputs[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert sum((r["doc_id"] in kept) == (r["quality"] == 1) for r in labels) >= 0.95 * len(labels)


def test_one_of_each_group_stays(outputs):
    from test_minhash import by_hand

    texts = {r["doc_id"]: r["text"] for r in outputs[2].collect()}
    want = {i for i, (_, _, kept) in by_hand(texts, 5, 80).items() if kept}
    assert {r["doc_id"] for r in outputs[3].collect()} == want


def test_mix_repeats_whole_documents(outputs):
    before = {r["doc_id"]: tuple(r) for r in outputs[3].collect()}
    rows = outputs[4].collect()
    assert outputs[4].columns == COLUMNS
    assert all(tuple(r) == before[r["doc_id"]] for r in rows)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    words = sum(len(r["text"].split()) for r in outputs[3].collect())
    assert sum(len(r["text"].split()) for r in rows) == pytest.approx(1.5 * words, rel=0.05)


def test_bins_hold_all_words(outputs):
    words = sum(len(r["text"].encode().split()) for r in outputs[4].collect())
    assert outputs[5].agg(F.sum("piece_length")).first()[0] == words


def test_run_gives_the_last_stage(spark, folder, outputs):
    run = corpus_pipeline.run(spark, folder)
    assert run.columns == outputs[5].columns
    assert run.groupBy("doc_id", "piece_length").count().exceptAll(outputs[5].groupBy("doc_id", "piece_length").count()).count() == 0


def test_stages_on_odd_and_empty_tables(spark, folder, odd):
    docs = odd.select(*COLUMNS)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, folder)
            rows = out.collect()
            assert name == "best-fit packing" or out.columns == COLUMNS
            assert rows == [] or frame is docs
    kept = corpus_pipeline.keep_one_per_group(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 7: 1, 8: 1}
