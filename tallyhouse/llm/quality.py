"""Quality classifier by co-training two views of a document.

One classifier sees the text (bytes, byte pairs, repetition), the other the metadata (source,
language, length). From a bounded sample of labelled rows each learns by itself; then, round by
round, each hands its most confident judgements on unlabelled documents to the other as
pseudo-labels. Both are calibrated on labelled rows kept aside, in every round, and the two
calibrated views are added as log odds to score every document.

A view teaches only if it tells the kept rows' labels better than their base rate does, and only
where it is sure beyond that rate. A round that leaves the two views together worse on the kept
rows is taken back, so an exchange helps there or does nothing.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import packed, place, stored

# Bounds of what is fitted on the driver.
LABELLED_ROWS = 8_000
UNLABELLED_ROWS = 6_000
ROUNDS = 3
# Of the unlabelled rows, how many a view hands over per round; how sure it must be, and how much the
# odds must have moved from the base rate's; and the share of the base rate's loss it must save to teach.
HANDED_OVER = 0.1
CONFIDENCE = 0.9
ODDS_MOVED = 3.0
LOSS_SAVED = 0.1
PSEUDO_WEIGHT = 0.5
KEEP_FROM = 0.5

PAIR_SLOTS, SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 128, 64, 16, 24
TEXT_WIDTH = 256 + PAIR_SLOTS + 6
META_WIDTH = SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS


def text_features(text: str | None) -> np.ndarray:
    """What the text view sees of the whole text."""
    out = np.zeros(TEXT_WIDTH, dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    signs = np.frombuffer(raw, dtype=np.uint8)
    out[:256] = np.bincount(signs, minlength=256)
    if len(signs) > 1:
        pairs = (signs[:-1].astype(np.int32) * 37 + signs[1:]) % PAIR_SLOTS
        out[256 : 256 + PAIR_SLOTS] = np.bincount(pairs, minlength=PAIR_SLOTS)
    shares = out[:256] / len(signs)
    out[: 256 + PAIR_SLOTS] = np.log1p(out[: 256 + PAIR_SLOTS] * (1000.0 / len(signs)))
    words = raw.split()
    n = max(1, len(words))
    letters = shares[65:91].sum() + shares[97:123].sum() + shares[128:].sum()
    out[-6:] = (
        np.log1p(n) / 5, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
        letters, shares[65:91].sum(), min(1.0, len(raw) / n / 20),
    )
    return out


def meta_features(source, lang, n_chars) -> np.ndarray:
    """What the metadata view sees; nulls have a slot of their own."""
    out = np.zeros(META_WIDTH, dtype=np.float32)
    out[0 if source is None else 1 + zlib.crc32(str(source).encode()) % (SOURCE_SLOTS - 1)] = 1
    out[SOURCE_SLOTS + (0 if lang is None else 1 + zlib.crc32(str(lang).encode()) % (LANG_SLOTS - 1))] = 1
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    out[SOURCE_SLOTS + LANG_SLOTS + (1 + min(LENGTH_SLOTS - 2, int(n_chars).bit_length()) if known else 0)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _log_loss(log_odds: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(log_odds, -35, 35)
    return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))


@dataclass
class Linear:
    """Logistic regression on standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fits slope and shift, with targets drawn in from 0 and 1 by the class counts."""
        z = self.raw(x)
        up, down = y.sum(), (1 - y).sum()
        goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(a * z + b)
            g, h = p - goal, np.maximum(p * (1 - p), 1e-9)
            gradient = np.array([(g * z).sum(), g.sum()]) + np.array([1e-3 * (a - 1), 0])
            hessian = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(float(a), 0.0), float(b)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> Linear:
    """Accelerated gradient descent; the step follows from the features' spread."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0).astype(np.float32)
    z = ((x - mean) / scale).astype(np.float32)
    weight = weight / weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    probe = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(10):
        probe = z.T @ (weight * (z @ probe))
        top = np.linalg.norm(probe) or 1.0
        probe = probe / top
    rate = 1 / (0.25 * (top + 1) + ridge)
    last, at = (w, b), 1.0
    ahead = (w, b)
    for _ in range(steps):
        error = weight * (_sigmoid(z @ ahead[0] + ahead[1]) - y)
        new = (ahead[0] - rate * (z.T @ error + ridge * ahead[0]), ahead[1] - rate * error.sum())
        nxt = (1 + np.sqrt(1 + 4 * at * at)) / 2
        pull = (at - 1) / nxt
        ahead = (new[0] + pull * (new[0] - last[0]), new[1] + pull * (new[1] - last[1]))
        last, at = new, nxt
    return Linear(mean.astype(np.float32), scale, last[0].astype(np.float32), float(last[1]))


@dataclass
class Model:
    """Calibrated views and the base rate's log odds; views are None where nothing can be learned."""

    text: Linear | None
    meta: Linear | None
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            same = np.full(len(text), 1 / (1 + np.exp(-self.prior)))
            return same, same, same
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y`` is 1, 0 or -1 (no label); rows of ``aside`` are labelled and only calibrate."""
    known = (y >= 0) & ~aside
    up, down = int((y[y >= 0] == 1).sum()), int((y[y >= 0] == 0).sum())
    prior = float(np.log((up + 1) / (down + 1)))
    if len(np.unique(y[known])) < 2:
        return Model(None, None, prior)
    views, pool = (text, meta), np.flatnonzero(y < 0)
    # What each view is taught by the other: row -> label.
    taught: tuple[dict, dict] = ({}, {})

    def train(v: int) -> Linear:
        rows = np.concatenate([np.flatnonzero(known), np.fromiter(taught[v], dtype=np.int64, count=len(taught[v]))])
        goal = np.concatenate([y[known], np.fromiter(taught[v].values(), dtype=np.float64, count=len(taught[v]))])
        weight = np.concatenate([np.ones(known.sum()), np.full(len(taught[v]), PSEUDO_WEIGHT)])
        return fit(views[v][rows], goal, weight)

    check = aside & (y >= 0)
    if len(np.unique(y[check])) < 2:
        check = known
    truth = y[check].astype(np.float64)

    def calibrated() -> list[Linear]:
        models = [train(0), train(1)]
        for v in (0, 1):
            models[v].calibrate(views[v][check], truth)
        return models

    def together(models: list[Linear]) -> float:
        return _log_loss(sum(models[v].log_odds(views[v][check]) for v in (0, 1)) - prior, truth)

    by_base_rate = _log_loss(np.full(len(truth), prior), truth)
    models = calibrated()
    best, best_loss = models, together(models)
    for _ in range(rounds if len(pool) else 0):
        before = tuple(dict(t) for t in taught)
        for v in (0, 1):
            if _log_loss(models[v].log_odds(views[v][check]), truth) > (1 - LOSS_SAVED) * by_base_rate:
                continue
            z = models[v].log_odds(views[v][pool])
            quota = max(1, int(len(pool) * HANDED_OVER))
            for label, sign, some in ((1, 1, quota * up // (up + down)), (0, -1, quota * down // (up + down))):
                sure = (_sigmoid(sign * z) >= CONFIDENCE) & (sign * (z - prior) >= np.log(ODDS_MOVED))
                ranked = np.argsort(-sign * z, kind="stable")[: max(1, some)]
                taught[1 - v].update({int(pool[i]): label for i in ranked if sure[i]})
        if tuple(taught) == before:
            break
        models = calibrated()
        loss = together(models)
        if loss > best_loss:
            break
        best, best_loss = models, loss
    return Model(best[0], best[1], prior)


def train_model(
    frame: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> Model:
    """Fits on at most ``labelled_rows`` labelled and ``unlabelled_rows`` other documents.

    Rows are picked by a hash of the id. A quarter of the labelled ones, by id, only calibrates.
    Ids with both labels count as bad (0); null ids or labels are left out.
    """
    truth = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("y"))
        .orderBy(place(11, F.col("doc_id")), "doc_id").limit(labelled_rows)
    )
    others = (
        frame.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
        .orderBy(place(12, F.col("doc_id")), "doc_id").limit(unlabelled_rows)
        .join(truth, "doc_id", "left_anti").withColumn("y", F.lit(-1))
    )
    chosen = stored(truth.select("doc_id", F.col("y").cast("int")).union(others.select("doc_id", F.col("y").cast("int"))), "quality-sample")
    # The chosen ids are bounded by the parameters. A repeated id counts once, so the sample is, too.
    sample = frame.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"], "y": b["y"],
                    "t": [text_features(t).tobytes() for t in b["text"]],
                    "m": [meta_features(*r).tobytes() for r in zip(b["source"], b["lang"], b["n_chars"], strict=True)],
                }
            )

    got = sample.mapInPandas(features, "doc_id bigint, y int, t binary, m binary").toPandas().sort_values(["doc_id", "y", "t"])
    text = np.frombuffer(b"".join(got["t"]), dtype=np.float32).reshape(-1, TEXT_WIDTH)
    meta = np.frombuffer(b"".join(got["m"]), dtype=np.float32).reshape(-1, META_WIDTH)
    y = got["y"].to_numpy(dtype=np.int64)
    aside = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]], dtype=bool) & (y >= 0)
    return cotrain(text, meta, y, aside)


def score_quality(frame: DataFrame, model: Model) -> DataFrame:
    """Adds text_quality, meta_quality, quality_score (all 0 to 1) and accepted to every row.

    Texts that are null or without a word score 0 and are not accepted. Input columns named like
    the added ones, in any case, are replaced; other columns and repeated rows stay as they are. Where the
    labels have one class or none, all other rows score the base rate.
    """
    def score(batches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for texts, source, lang, n_chars in batches:
            text = np.stack([text_features(t) for t in texts]) if len(texts) else np.zeros((0, TEXT_WIDTH), np.float32)
            meta = np.stack([meta_features(*r) for r in zip(source, lang, n_chars, strict=True)]) if len(texts) else np.zeros((0, META_WIDTH), np.float32)
            parts = np.stack(model.score(text, meta), axis=1).astype(np.float64)
            parts[[t is None or not t.strip() for t in texts]] = 0
            yield pd.DataFrame(parts, columns=["t", "m", "q"])

    score.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]
    }
    scored = F.pandas_udf(score, "t double, m double, q double")
    views = scored("text", "source", "lang", F.col("n_chars").cast("double"))
    work, kept = packed(frame, ("text_quality", "meta_quality", "quality_score", "accepted"), scored=views)
    return work.select(
        *kept, F.col("scored.t").alias("text_quality"), F.col("scored.m").alias("meta_quality"),
        F.col("scored.q").alias("quality_score"), (F.col("scored.q") >= KEEP_FROM).alias("accepted"),
    )
