"""Nearest neighbours by multi-index hashing of learned binary codes.

1. Vectors get one more component that makes them equally long, so that the largest inner product
   is the smallest angle. A rotation learned on a bounded sample (principal directions, then
   iterative quantisation) turns each into a code of 64 bits, the signs of its components.
2. Distinct vectors are dealt into blocks. A block indexes its codes by each of four substrings.
   A query probes the substrings within a quarter of the radius: by the pigeonhole principle that
   retrieves every code within the radius, which is then checked on the whole code.
3. Codes within the radius are reranked by inner product in double precision. The radius is
   learned on the sample so that it holds the true neighbours; where a block has fewer codes in
   it than neighbours are asked for, it is widened until there are enough.

Equal vectors are searched for, and found, once; their ids are put back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import place, stored
from tallyhouse.llm.vectors import usable, vector_key

BITS, SUBSTRINGS = 64, 4
SUB_BITS = BITS // SUBSTRINGS
# Bound of the sample the rotation and the radius are learned on, and queries of it.
SAMPLE, SAMPLE_QUERIES = 8_192, 256
ROTATION_STEPS = 30
# Share of the sample's true neighbours the radius must hold.
HELD = 0.98
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048


@dataclass
class Coder:
    """From vectors to codes."""

    width: int
    longest: float
    mean: np.ndarray
    turn: np.ndarray
    radius: int = 0

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.einsum("ij,ij->i", x, x)
        if query:
            # A query is as long as all the others, with nothing in the added component.
            x, extra = x * (self.longest / np.sqrt(size))[:, None], np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(0.0, self.longest**2 - size))
        bits = (np.column_stack([x, extra]) - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def learn_coder(x: np.ndarray, longest: float, neighbours: int) -> Coder:
    """Rotation and radius from a sample."""
    rng = np.random.default_rng(4)
    width = x.shape[1]
    full = np.column_stack([x, np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", x, x)))])
    mean = full.mean(axis=0)
    centred = full - mean
    kept = min(BITS, width + 1)
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :kept]
    flat = centred @ axes
    turn = np.linalg.qr(rng.standard_normal((kept, kept)))[0]
    for _ in range(ROTATION_STEPS):
        signs = np.where(flat @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        turn = (left @ right).T
    whole = axes @ turn
    if kept < BITS:
        # Fewer components than bits: further directions at random.
        whole = np.column_stack([whole, axes @ rng.standard_normal((kept, BITS - kept))])
    coder = Coder(width, longest, mean, whole)
    queries = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    k = min(neighbours, len(x) - 1)
    if k > 0:
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(coder.codes(x[queries], True)[:, None] ^ coder.codes(x, False)[best])
        coder.radius = int(np.quantile(apart, HELD, method="higher"))
    return coder


class SubstringIndex:
    """Positions of codes by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view("<u2").reshape(-1, SUBSTRINGS)
        self.tables = []
        for s in range(SUBSTRINGS):
            order = np.argsort(self.parts[:, s], kind="stable")
            values, starts = np.unique(self.parts[order, s], return_index=True)
            self.tables.append((values, np.append(starts, len(codes)), order))

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All positions whose code is within the radius, with the distances."""
        mine = code.reshape(1).view("<u2")
        hit = np.zeros(len(self.codes), dtype=bool)
        for s, (values, starts, order) in enumerate(self.tables):
            # Values present that lie within the substring's share of the radius.
            near = np.flatnonzero(np.bitwise_count(values ^ mine[s]) <= radius // SUBSTRINGS)
            sizes = starts[near + 1] - starts[near]
            at = np.repeat(starts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            hit[order[at]] = True
        found = np.flatnonzero(hit)
        apart = np.bitwise_count(self.codes[found] ^ code)
        inside = apart <= radius
        return found[inside], apart[inside]

    def at_least(self, code: np.ndarray, radius: int, wanted: int) -> np.ndarray:
        """Positions within the radius, widened until ``wanted`` are found (or all are)."""
        wanted = min(wanted, len(self.codes))
        while True:
            found, _ = self.within(code, radius)
            if len(found) >= wanted:
                return found
            radius += SUBSTRINGS


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _packer(coder: Coder, query: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        x = _matrix(group["vector"], coder.width)
        return pd.DataFrame(
            {
                "block": [group["block"].iloc[0]], "keys": [group["key"].to_numpy()], "least": [group["least"].to_numpy()],
                "data": [x.tobytes()], "codes": [coder.codes(x, query).tobytes()],
            }
        )

    return pack


def _search(coder: Coder, wanted: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.frombuffer(row.data).reshape(-1, coder.width)
                q = np.frombuffer(row.q_data).reshape(-1, coder.width)
                index = SubstringIndex(np.frombuffer(row.codes, dtype="<u8"))
                ids = np.asarray(row.least)
                parts = []
                for k, code in enumerate(np.frombuffer(row.q_codes, dtype="<u8")):
                    found = index.at_least(code, coder.radius, wanted)
                    score = x[found] @ q[k]
                    if len(found) > wanted:
                        cut = np.partition(score, len(score) - wanted)[len(score) - wanted]
                        found, score = found[score >= cut], score[score >= cut]
                    order = np.lexsort((ids[found], -score))[:wanted]
                    parts.append(pd.DataFrame({"q_key": row.q_keys[k], "key": row.keys[found[order]], "least": ids[found[order]], "score": score[order]}))
                if parts:
                    yield pd.concat(parts)

    return run


def nearest(frame: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20) -> DataFrame:
    """The k nearest rows found of each query, by inner product: query_id, rank, vec_id, score.

    Queries are the rows where ``is_query`` holds; a row is no neighbour of itself. Ties go to the
    smaller id. Null, empty and zero vectors and those with null or non-finite components take no
    part, nor do rows with null id. A shorter vector counts as filled up with zeros. Repeated rows
    count once. Fewer than k other vectors give all of them; an empty frame gives an empty one.
    Other columns are not read.
    """
    rows = stored(
        frame.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(F.col("id").isNotNull() & usable(F.col("vector")))
        .withColumn("key", vector_key(F.col("vector"))),
        "ann-rows",
    )
    ids = rows.select("key", "id").distinct()
    # The answer of a query holds no more than k + 1 ids of one vector: its own and k others.
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = stored(ranked.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-members")
    distinct = stored(
        rows.groupBy("key").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.max("asks").alias("asks")),
        "ann-distinct",
    )
    total, asked, width, longest = distinct.agg(
        F.count("*"), F.count_if("asks"), F.max(F.size("vector")),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))),
    ).first()
    sample = distinct.orderBy(place(61, F.col("key")), "key").limit(SAMPLE).select("vector").toPandas()["vector"]
    id_type = rows.schema["id"].dataType.simpleString()
    if not total:
        return rows.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    coder = learn_coder(_matrix(sample, width), longest, k)
    blocks, query_blocks = math.ceil(total / BLOCK_ROWS), max(1, math.ceil(asked / BLOCK_QUERIES))

    def packed(some: DataFrame, number: int, query: bool) -> DataFrame:
        block = (place(62, F.col("key")) % number).cast("int")
        schema = f"block int, keys array<string>, least array<{id_type}>, data binary, codes binary"
        dealt = some.select("key", "vector", "least", block.alias("block"))
        return stored(dealt.groupBy("block").applyInPandas(_packer(coder, query), schema), "ann-blocks")

    index = packed(distinct, blocks, False)
    questions = packed(distinct.filter("asks"), query_blocks, True).select(
        F.col("keys").alias("q_keys"), F.col("data").alias("q_data"), F.col("codes").alias("q_codes"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    found = (
        index.join(questions, "block").select("keys", "least", "data", "codes", "q_keys", "q_data", "q_codes")
        .mapInPandas(_search(coder, k + 1), f"q_key string, key string, least {id_type}, score double")
    )
    best = Window.partitionBy("q_key").orderBy(F.col("score").desc(), "least", "key")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    listed = (
        top.join(members, "key").select("q_key", "score", F.explode("ids").alias("vec_id"))
        .groupBy("q_key")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("under"), "vec_id"))).alias("all"))
        .select(F.col("q_key").alias("key"), F.slice("all", 1, k + 1).alias("all"))
    )
    asking = rows.filter("asks").select("key", F.col("id").alias("query_id")).distinct()
    answered = asking.join(listed, "key").select(
        "query_id", F.slice(F.filter("all", lambda a: a["vec_id"] != F.col("query_id")), 1, k).alias("all")
    )
    return answered.select("query_id", F.posexplode("all").alias("at", "a")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("a.vec_id").alias("vec_id"), (-F.col("a.under")).alias("score")
    )
