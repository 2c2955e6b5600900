"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

1. Equal vectors of a label form a class. Classes are cut into tiles of bounded size, by cell of
   their projection on one direction: cells further apart than linked vectors can be never meet.
2. A vector is scaled to length 1 and rounded to eight bits; how far the rounded vector lies from
   the true one is kept. For two tiles the integer products give every cosine to within
   e_x * |y'| + e_y, and only pairs that may reach the threshold are computed in double
   precision from the original values.
3. A tile pair hands on sums of links per vector and a spanning forest of its links, so a large
   group of near copies is never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import place, stored
from tallyhouse.llm.components import components
from tallyhouse.llm.vectors import usable, vector_key

TILE = 1_024
SAMPLE = 4_096
EXACT_AT_ONCE = 65_536
# Covers the rounding of the bounds themselves.
EPSILON = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows -> eight-bit rows, their scale, the distance of scaled row from unit row, and its length."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def upper_bounds(a: tuple, b: tuple) -> np.ndarray:
    """No cosine of a row of ``a`` and a row of ``b`` is above this."""
    # Products of eight-bit integers, exact in the floats that carry them.
    kind = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64)
    product *= a[1][:, None]
    product *= b[1][None, :]
    product += a[2][:, None] * b[3][None, :] + b[2][None, :] + EPSILON
    return product


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of rows of ``x`` and ``y`` with cosine >= threshold; with ``same`` each pair once."""
    possible = upper_bounds(quantise(x), quantise(y)) >= threshold
    if same:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    n, m = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), EXACT_AT_ONCE):
        p, q = i[at : at + EXACT_AT_ONCE], j[at : at + EXACT_AT_ONCE]
        keep[at : at + EXACT_AT_ONCE] = np.einsum("ij,ij->i", x[p], y[q]) / (n[p] * m[q]) >= threshold
    return i[keep], j[keep]


def spanning_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index each of n nodes is linked with."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(n, -1)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("least")
    width = group["vector"].map(len).max()
    values = np.zeros((len(group), width))
    for k, v in enumerate(group["vector"]):
        values[k, : len(v)] = v
    first = group.iloc[0]
    return pd.DataFrame(
        {
            "label": [first["label"]], "cell": [first["cell"]], "tile": [first["tile"]],
            "ids": [group["least"].to_numpy()], "copies": [group["copies"].to_numpy()], "data": [values.tobytes()],
        }
    )


def _link_tiles(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                same = (row.cell, row.tile) == (row.cell2, row.tile2)
                x, y = _matrix(row.data, len(row.ids)), _matrix(row.data2, len(row.ids2))
                width = max(x.shape[1], y.shape[1])
                x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
                i, j = linked_pairs(x, y, threshold, same)
                if not len(i):
                    continue
                shift = 0 if same else len(x)
                ids = row.ids if same else np.concatenate([row.ids, row.ids2])
                copies = row.copies if same else np.concatenate([row.copies, row.copies2])
                total = np.zeros(len(ids), dtype=np.int64)
                np.add.at(total, i, copies[j + shift])
                np.add.at(total, j + shift, copies[i])
                label = spanning_labels(len(ids), i, j + shift)
                hit = np.flatnonzero(total)
                yield pd.DataFrame({"id": ids[hit], "root": ids[label[hit]], "n": total[hit]})

    return run


def _direction(classes: DataFrame) -> list[float]:
    """The direction a bounded sample of unit vectors spreads most along."""
    rows = classes.orderBy(place(51, F.col("key")), "key").limit(SAMPLE).select("vector").toPandas()["vector"]
    width = max((len(v) for v in rows), default=1)
    x = np.zeros((max(1, len(rows)), width))
    for k, v in enumerate(rows):
        x[k, : len(v)] = np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64))
    return np.linalg.eigh(np.cov(x.T).reshape(width, width) if len(rows) > 1 else np.eye(width))[1][:, -1].tolist()


def near_duplicate_vectors(
    frame: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float = 0.98, tile: int = TILE
) -> DataFrame:
    """One row per input row: the id, n_links, component_id and kept.

    Vectors of one label are linked if their cosine is at least ``threshold`` (above 0). Null,
    zero and empty vectors, those with null or non-finite components, and rows with null label
    or null id link with nothing: 0 links, their own component, kept. A shorter vector counts as
    filled up with zeros. Ids are taken to be unique; repeated rows
    count as copies of each other. Other columns are not read. An empty frame gives an empty one.
    """
    rows = stored(
        frame.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
        .withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
        .withColumn("key", F.when(F.col("usable"), vector_key(F.col("vector")))),
        "vectors",
    )
    classes = stored(
        rows.filter("usable").groupBy("label", "key")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    direction = F.array(*[F.lit(float(d)) for d in _direction(classes)])
    zero = F.lit(0.0)
    length = F.sqrt(F.aggregate("vector", zero, lambda s, x: s + x.cast("double") * x))
    along = F.aggregate(
        F.zip_with("vector", direction, lambda x, d: F.coalesce(x.cast("double") * d, zero)), zero, lambda s, x: s + x
    )
    # Unit vectors with this cosine lie no further apart, and so do their projections.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + EPSILON
    celled = classes.withColumn("cell", F.floor(along / length / reach).cast("int"))
    counts = stored(
        celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "vector-cells"
    )
    spread = celled.join(counts, ["label", "cell"]).withColumn("tile", (place(52, F.col("key")) % F.col("tiles")).cast("int"))
    label_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("label", "id"))
    packed = stored(
        spread.select("label", "cell", "tile", "least", "copies", "vector").groupBy("label", "cell", "tile").applyInPandas(
            _pack, f"label {label_type}, cell int, tile int, ids array<{id_type}>, copies array<bigint>, data binary"
        ),
        "vector-tiles",
    )
    names = packed.select("label", "cell", "tile")
    others = names.select("label", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"))
    pairs = names.join(others, "label").filter(
        # Neighbouring cells, and the next but one, which may touch the reach at its very end.
        (F.col("cell2") - F.col("cell") <= 2)
        & ((F.col("cell2") > F.col("cell")) | ((F.col("cell2") == F.col("cell")) & (F.col("tile2") >= F.col("tile"))))
    )
    theirs = packed.select("label", *[F.col(c).alias(f"{c}2") for c in ("cell", "tile", "ids", "copies", "data")])
    found = stored(
        pairs.join(packed, ["label", "cell", "tile"]).join(theirs, ["label", "cell2", "tile2"])
        .mapInPandas(_link_tiles(threshold), f"id {id_type}, root {id_type}, n bigint"),
        "vector-links",
    )
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    by_class = (
        classes.select("label", "key", "copies", F.col("least").alias("id"))
        .join(sums, "id", "left").join(groups, "id", "left")
        .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    return rows.select("id", "label", "key").join(by_class, ["label", "key"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
