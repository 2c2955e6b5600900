"""Codes of vectors by a codebook per part, with nearest entries found in whole numbers.

Distances are taken between integer Walsh-Hadamard transforms, whose coefficients are summed in
sequency order, so that most entries fall out after a few of them. The transform of length d
multiplies every squared distance by exactly d: no rounding anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import quoted, stored

# Coefficients of all entries that are summed before the first ones are dropped.
LEAD = 2


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The transform of every row, whose length is a power of two, in natural order."""
    out, width = rows.copy(), 1
    while width < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(out.shape)
        width *= 2
    return out


def sequency_order(width: int) -> np.ndarray:
    """Coefficients by the number of sign changes of their functions."""
    signs = walsh_hadamard(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=0) != 0).sum(axis=0), kind="stable")


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, ties to the lower one, and its squared distance, for every part.

    Both hold whole numbers, one row each. Rows are padded with zeros to a power of two and
    transformed. After ``LEAD`` coefficients the entry that leads is measured whole; entries whose
    running sum passes that distance are out, at once and after each further coefficient.
    """
    width = 1 << max(0, parts.shape[1] - 1).bit_length()
    pad = ((0, 0), (0, width - parts.shape[1]))
    a, b = walsh_hadamard(np.pad(parts, pad)), walsh_hadamard(np.pad(entries, pad))
    order = sequency_order(width)
    sums = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in order[:LEAD]:
        sums += (a[:, k, None] - b[None, :, k]) ** 2
    bound = ((a - b[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for k in order[LEAD:]:
        left += (a[row, k] - b[entry, k]) ** 2
        stays = left <= bound[row]
        row, entry, left = row[stays], entry[stays], left[stays]
    ranked = np.lexsort((entry, left, row))
    first = ranked[np.searchsorted(row[ranked], np.arange(len(a)))]
    return entry[first], left[first] // width


def whole_parts(vectors: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of every component, cut into equal parts: (rows, parts, length of a part).

    Vectors whose length ``parts`` does not divide end in zeros. Components so large that a
    squared distance might pass 64 bits are an error, as sums that overflow are in Spark.
    """
    length = -(-vectors.shape[1] // parts)
    width = 1 << max(0, length - 1).bit_length()
    floors = np.floor(vectors.astype(np.float64) * scale)
    # parts * width * (2 * component)^2, times width by the transform, has to stay below 2^63.
    limit = 2.0**61 / (parts * width * width)
    if floors.size and float(np.abs(floors).max()) ** 2 >= limit:
        raise OverflowError(f"components of {limit**0.5 / scale:.0f} and above are too large for whole-number distances")
    padded = np.pad(floors.astype(np.int64), ((0, 0), (0, parts * length - vectors.shape[1])))
    return padded.reshape(len(vectors), parts, length)


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _assign(cut: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [nearest(cut[:, p], books[p]) for p in range(cut.shape[1])]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray, size: int, scale: int):
    """Per task, (part, entry, place in the part, sum, count) of the parts nearest to each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.shape
        totals, often = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)

        def rows() -> pa.RecordBatch:
            p, e, i = np.nonzero(np.broadcast_to(often[:, :, None] > 0, books.shape))
            return pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array(totals[p, e, i]), pa.array(often[p, e])],
                ["part", "entry", "at", "total", "n"],
            )

        for batch in batches:
            cut = whole_parts(_vectors(batch, size), scale, parts)
            codes = _assign(cut, books)[0]
            for p in range(parts):
                often[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(totals[p], codes[:, p], cut[:, p])
            # Far from what 64 bits hold, whatever the components.
            if int(np.abs(totals).max(initial=0)) >> 55:
                yield rows()
                totals[:], often[:] = 0, 0
        if often.any():
            yield rows()

    return add


def _code(books: np.ndarray, size: int, scale: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = _assign(whole_parts(_vectors(batch, size), scale, len(books)), books)
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(digits, pa.string()), pa.array(errors.sum(axis=1))],
                ["id", "label", "code", "error"],
            )

    return code


def _finite(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def code_vectors(
    frame: DataFrame, id_col: str, vector_col: str, label_col: str,
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """The id column, label, code, error, label_error and codebooks_sha256 of every usable vector.

    A component x counts as floor(scale * x). Vectors are cut into ``parts`` equal parts, and each
    part position has a codebook: first that part of the ``entries`` smallest ids, then, after
    each round, the componentwise floor of the mean of the parts nearest to each entry (squared
    Euclidean distance, ties to the lower entry); unused entries stay. ``code`` is the nearest
    entry per part as two hex digits, ``error`` the sum of the squared distances, ``label_error``
    its sum over rows of equal label, nulls together, and the hash that of all entries.

    Rows with a null vector, a null, infinite or NaN component go. All vectors should be equally
    long; those not as long as the one of the smallest id go too. Where ``parts`` doesn't divide
    the length, vectors end in zeros. Zero vectors stay. Null ids come last in the order of ids,
    rows of one id are ordered by their vectors, repeated rows stay rows, fewer rows than
    ``entries`` give smaller codebooks. An empty frame gives an empty one. Other columns are not read.

    The frame is read once a round, and its rows move only for ``label_error``; a round sends one
    row per part, entry and place from each task, and the codebooks, which data do not make larger.
    """
    rows = frame.select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"),
        F.col(quoted(vector_col)).cast("array<double>").alias("vector"),
    ).filter(_finite(F.col("vector")))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    by_id = rows.orderBy(F.col("id").asc_nulls_last(), "vector")
    first = by_id.select("vector").limit(1).collect()
    size = len(first[0].vector) if first else 0
    rows = rows.filter(F.size("vector") == size)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    begun = whole_parts(np.array([r.vector for r in start], dtype=np.float64).reshape(len(start), size), scale, parts)
    books = np.ascontiguousarray(begun.transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        moved = (
            rows.select("vector").mapInArrow(_sums(books, size, scale), "part int, entry int, at int, total bigint, n bigint")
            .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
            .collect()
        )
        books = books.copy()
        for part, entry, at, total, n in moved:
            books[part, entry, at] = int(total) // n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(
        rows.mapInArrow(_code(books, size, scale), f"id {id_type}, label {label_type}, code string, error bigint"), "vector-codes"
    )
    # Written, so that their true size decides how they are joined back.
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
