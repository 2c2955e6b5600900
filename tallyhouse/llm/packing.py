"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces; no token is lost.
Pieces are dealt at random into blocks of bounded size, and each block is packed by itself:
pieces go in by falling length, each into the open bin it fits most tightly. Where none has
room, the bin size opened is the one with the least cost per token it can be filled with, given
the lengths still waiting. At the end every bin shrinks to the smallest permitted length that
holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import packed, place, stored

CAPACITIES = (256, 512, 1024, 2048, 4096)
BLOCK_PIECES = 32_768
# Attention makes a token of a longer sequence dearer: the cost of a bin is c + c * c / this.
ATTENTION_SCALE = 16_384
BINS_PER_BLOCK = 1 << 20


def bin_cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION_SCALE


class _Waiting:
    """Multiset of lengths still to be packed, by falling length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, counts = np.unique(lengths, return_counts=True)
        self.counts = counts.tolist()
        self.lengths = self.lengths.tolist()

    def take(self, length: int) -> None:
        at = bisect_left(self.lengths, length)
        self.counts[at] -= 1
        if not self.counts[at]:
            del self.lengths[at], self.counts[at]

    def fill(self, room: int) -> int:
        """Tokens that go into ``room`` when the longest fitting lengths are taken first."""
        start, at = room, bisect_left(self.lengths, room + 1) - 1
        while room and at >= 0:
            length = self.lengths[at]
            room -= length * min(self.counts[at], room // length)
            at = min(at - 1, bisect_left(self.lengths, room + 1) - 1)
        return start - room


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, capacity of that bin, offset in it) for each length; lengths are 1 to the largest capacity."""
    capacities = sorted(capacities)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    waiting = _Waiting(lengths)
    rooms: list[int] = []  # room left, rising, of open bins that have some
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        waiting.take(length)
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del rooms[at], by_room[room]
        else:
            fitting = [c for c in capacities if c >= length]
            room = min(fitting, key=lambda c: (bin_cost(c) / (length + waiting.fill(c - length)), c))
            chosen = len(used)
            used.append(0)
        bins[i], offsets[i] = chosen, used[chosen]
        used[chosen] += length
        room -= length
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(chosen)
    content = np.asarray(used, dtype=np.int64)
    shrunk = np.asarray(capacities, dtype=np.int64)[np.searchsorted(capacities, content)] if n else content
    return bins, shrunk[bins] if n else bins, offsets


def best_fit(
    frame: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, block_pieces: int = BLOCK_PIECES, seed: int = 3
) -> DataFrame:
    """One row per piece: the frame's columns, then piece, piece_start, piece_length, bin_id, capacity, bin_offset.

    ``length`` is the number of tokens of a row. Null or 0 takes no room: one piece of length 0
    with null bin, capacity and offset. Repeated rows are packed each for itself. Input columns
    with the names of the added ones, in any case, are replaced. An empty frame gives an empty one.
    """
    added = ("piece", "piece_start", "piece_length", "bin_id", "capacity", "bin_offset")
    largest = max(capacities)
    tokens = F.coalesce(length, F.lit(0)).cast("bigint")
    work, kept = packed(frame, added, _tokens=tokens, _row=F.monotonically_increasing_id())
    rows = stored(work, "pack-rows")
    pieces = rows.select(
        "row", "_row", "_tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest("_tokens", F.lit(1)) - 1) / largest).cast("bigint"))).alias("piece"),
    ).withColumn("piece_start", F.col("piece") * largest).withColumn(
        "piece_length", F.least(F.lit(largest), F.col("_tokens") - F.col("piece_start")).cast("bigint")
    )
    number = pieces.count()
    blocks = max(1, math.ceil(number / block_pieces))
    block = (place(seed, F.col("_row"), F.col("piece")) % blocks).cast("bigint")
    small = pieces.select("_row", "piece", "piece_length", block.alias("_block"))

    def in_bins(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_row", "piece"], kind="stable")
        bins, sizes, offsets = pack(group["piece_length"].to_numpy(), capacities)
        return pd.DataFrame(
            {
                "_row": group["_row"], "piece": group["piece"], "bin_id": bins + int(key[0]) * BINS_PER_BLOCK,
                "capacity": sizes, "bin_offset": offsets,
            }
        )

    placed = small.filter("piece_length > 0").groupBy("_block").applyInPandas(
        in_bins, "_row bigint, piece bigint, bin_id bigint, capacity bigint, bin_offset bigint"
    )
    return pieces.join(placed, ["_row", "piece"], "left").select(*kept, *added)
