import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tallyhouse.llm import quality
from tallyhouse.llm.queries import op8_cotraining_quality


def test_labelled_documents_are_told_apart(spark, folder):
    scores = {r["doc_id"]: r for r in op8_cotraining_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    for r in scores.values():
        assert all(0 <= r[c] <= 1 for c in ("text_quality", "meta_quality", "quality_score"))
        assert r["accepted"] == (r["quality_score"] >= 0.5)
    right = [scores[r["doc_id"]]["accepted"] == (r["quality"] == 1) for r in labels if r["doc_id"] in scores]
    assert np.mean(right) >= 0.95


def made_views(rng, n):
    """Two noisy views that are independent given the class."""
    y = rng.integers(0, 2, n)
    text = rng.standard_normal((n, 6)) + 1.3 * y[:, None] * np.array([1, 1, 0, 0, 0, 0])
    meta = rng.standard_normal((n, 4)) + 2.0 * y[:, None] * np.array([1, 0, 0, 0])
    return text.astype(np.float32), meta.astype(np.float32), y


def test_views_teach_each_other():
    rng = np.random.default_rng(5)
    text, meta, y = made_views(rng, 4000)
    seen = np.full(4000, -1)
    seen[:40] = y[:40]
    aside = np.zeros(4000, dtype=bool)
    aside[20:40] = True
    t, m, y2 = made_views(rng, 4000)

    def accuracy(rounds):
        model = quality.cotrain(text, meta, seen, aside, rounds)
        return np.mean((model.score(t, m)[2] >= 0.5) == y2), np.mean((model.score(t, m)[0] >= 0.5) == y2)

    alone, taught = accuracy(0), accuracy(3)
    assert taught[0] >= alone[0] - 0.01 and taught[1] >= alone[1] - 0.01
    assert taught[0] > 0.85
    # Both views together beat each by itself.
    assert taught[0] > taught[1]


def test_calibration_brings_scores_near_the_rate():
    rng = np.random.default_rng(6)
    text, meta, y = made_views(rng, 3000)
    model = quality.cotrain(text, meta, y, np.arange(3000) % 4 == 2)
    p = model.score(text, meta)[0]
    for low in (0.1, 0.4, 0.7):
        some = (p >= low) & (p < low + 0.2)
        assert abs(y[some].mean() - p[some].mean()) < 0.08


def test_no_labels_or_one_class(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 0)], labels.schema)
    for some, score in ((labels, 0.5), (one, 0.75)):
        model = quality.train_model(odd, some)
        by = {r["doc_id"]: r for r in quality.score_quality(odd, model).collect()}
        assert by[1]["quality_score"] == score and by[1]["accepted"]
        # Null and blank texts.
        assert [by[i]["quality_score"] for i in (3, 4, 5)] == [0, 0, 0]
    assert quality.score_quality(nothing, quality.train_model(nothing, one)).collect() == []


def test_odd_rows_with_both_classes(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 0), (8, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(odd, quality.train_model(odd, labels)).collect()
    assert len(rows) == odd.count() and rows[0]["key"] == "x"
    assert len({r["quality_score"] for r in rows if r["doc_id"] == 2}) == 1


def test_rounds_do_no_harm_on_held_out_labels():
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("test tables are not here")
    docs = pd.read_parquet(folder / "documents.parquet").sort_values("doc_id")
    labels = pd.read_parquet(folder / "labels.parquet").groupby("doc_id")["quality"].min()
    docs = docs[docs["doc_id"].isin(labels.index) | (docs["doc_id"] % 4 == 0)]
    text = np.stack([quality.text_features(t) for t in docs["text"]])
    meta = np.stack([quality.meta_features(*r) for r in zip(docs["source"], docs["lang"], docs["n_chars"], strict=True)])
    y = docs["doc_id"].map(labels).fillna(-1).to_numpy(dtype=np.int64)
    drawn = np.array([zlib.crc32(f"held-{i}".encode()) for i in docs["doc_id"]])
    held, aside = (drawn % 5 == 0) & (y >= 0), (drawn % 4 == 2) & (y >= 0)
    wrong = {}
    for rounds in (0, quality.ROUNDS):
        model = quality.cotrain(text[~held], meta[~held], y[~held], aside[~held], rounds)
        wrong[rounds] = int(((model.score(text[held], meta[held])[2] >= 0.5) != (y[held] == 1)).sum())
    assert held.sum() > 500 and wrong[quality.ROUNDS] <= wrong[0] <= 0.01 * held.sum()
