"""Collocations by dynamic itemset counting over shards of the corpus.

The corpus is cut into shards that are scanned in a cycle. Words are counted from the first step
on. As soon as both a phrase's parts without its last and without its first word have reached the
threshold, the phrase is active: from the next step on it is counted, in whatever shard the cycle
has come to, for one full cycle, so that every shard is counted once. Lengths thus overlap, and
nothing is counted whose parts are too rare.

Which phrases have reached the threshold in which step is kept in bit tables of bounded size that
all tasks get. They may take a phrase for one that has reached it, never the reverse; and since a
step's table is never changed, they say the same of a phrase in every step. So a phrase taken in
by mistake is counted for exactly one cycle too: its count is right, and falls to the threshold.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import discard, quoted, stored

# Tokens of one language in a block, and of all languages together before a task hands blocks on.
BLOCK_TOKENS = 1 << 20
TASK_TOKENS = 3 << 19
# Bytes of one text that are cut into words at a time.
SLICE_BYTES = 4 << 20
# Bits a phrase in a table, and the most bits a table has (8 MB).
PHRASE_BITS = 16
MOST_BITS = 26

# Parts of a language's candidates that are ranked apart first.
RANK_PARTS = 256

# A byte no UTF-8 text has stands for the end of a piece.
END = b"\xff"
_TO_END = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
_GAP = re.compile(rb"[ \t\xff]")

BLOCKS = "shard int, lang string, n bigint, carried int, words binary, ids binary"
COUNTED = "k int, lang string, phrase string, start int, n bigint"

NEVER = 1 << 20
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


# -- words ------------------------------------------------------------------------------


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in parts that end between words."""
    begin = 0
    while begin < len(data):
        gap = _GAP.search(data, begin + SLICE_BYTES)
        end = gap.start() if gap else len(data)
        yield data[begin:end]
        begin = end


def _packed(data: bytes) -> bytes:
    """Packed here, a block takes no more memory where it is read than on disk."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(row: pa.RecordBatch, i: int) -> tuple[list[bytes], np.ndarray]:
    words, ids = (zstandard.ZstdDecompressor().decompress(row.column(name)[i].as_py()) for name in ("words", "ids"))
    return words.split(b" "), np.ascontiguousarray(np.frombuffer(ids, dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()


class _Buffer:
    """Words of one language in the order of the texts, as numbers into a list of distinct words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count().__next__)
        self.known[END]  # noqa: B018 - the end of a piece is number 0
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.carried = 0

    def add(self, tokens: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        # No word holds a blank; the first one, the end of a piece, is empty here.
        words = b" ".join([b"", *list(self.known)[1:]])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([lang], pa.string()),
                pa.array([int((ids[self.carried :] != 0).sum())], pa.int64()), pa.array([self.carried], pa.int32()),
                pa.array([_packed(words)], pa.binary()), pa.array([_packed(ids.view(np.uint8).reshape(-1, 4).T.tobytes())], pa.binary()),
            ],
            ["shard", "lang", "n", "carried", "words", "ids"],
        )

    def next(self, longest: int, inside: bool) -> _Buffer:
        """An empty buffer; inside a text it starts with the words a phrase may have begun with."""
        fresh = _Buffer()
        if inside and longest > 1:
            names = list(self.known)
            last = np.concatenate(self.ids)[-(longest - 1) :]
            fresh.add([names[i] for i in last])
            fresh.carried = len(last)
        return fresh


def _blocks(shards: int, longest: int, block_tokens: int, task_tokens: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of a task are dealt to the shards in turn; what is dealt is written, so it stays.
        shard = count(TaskContext.get().partitionId())
        buffers: dict[str, _Buffer] = defaultdict(_Buffer)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode().lower().translate(_TO_END)
                for part in _slices(data):
                    buffer = buffers[lang]
                    buffer.add(part.replace(END, b" \xff ").split())
                    if buffer.size >= block_tokens:
                        yield buffer.row(next(shard) % shards, lang)
                        buffers[lang] = buffer.next(longest, True)
                buffers[lang].add([END])
                if sum(b.size for b in buffers.values()) >= task_tokens:
                    lang = max(buffers, key=lambda name: buffers[name].size)
                    yield buffers.pop(lang).row(next(shard) % shards, lang)
        for lang, buffer in buffers.items():
            yield buffer.row(next(shard) % shards, lang)

    return cut


# -- hashes, the same here and in Spark --------------------------------------------------


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def fold(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """xxhash64 of a long with a seed, as Spark's function takes one column after the other."""
    h = seeds + _P5 + np.uint64(8)
    h ^= _turned(values * _P2, 31) * _P1
    h = _turned(h, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64(lang.encode(), seed=42).intdigest()
    return np.fromiter((xxhash.xxh64(w, seed=seed).intdigest() for w in words), dtype=np.uint64, count=len(words))


def _phrase_hash(k: int) -> Column:
    """Of ``phrase`` in ``lang``: a word's hash, or one over the words' hashes."""
    if k == 1:
        return F.xxhash64("lang", "phrase")
    return F.xxhash64(*[F.xxhash64("lang", F.split("phrase", " ")[i]) for i in range(k)])


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def bit_table(phrases: DataFrame, k: int, rows: int) -> tuple[int, np.ndarray]:
    """(bits, words of 64 bits) with two bits set per phrase; made in Spark, bounded in size."""
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(max(1, rows) * PHRASE_BITS))))
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    places = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1))))
    found = (
        phrases.select(_phrase_hash(k).alias("h")).select(places.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
        .toPandas()
    )
    table[found["word"].to_numpy(dtype=np.int64)] = found["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits, table


def reached_in(hashes: np.ndarray, tables: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """The earliest step whose table has each hash; ``NEVER`` where none has."""
    found = np.full(len(hashes), NEVER, dtype=np.int64)
    for step in sorted(tables, reverse=True):
        bits, table = tables[step]
        hit = np.ones(len(hashes), dtype=bool)
        for at in _probes(hashes, bits):
            hit &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        found[hit] = step
    return found


# -- one step ----------------------------------------------------------------------------


def _counted(step: int, shards: int, longest: int, shared):
    """Occurrences in a block of every phrase that is active in this step."""

    def batch_of(k: int, lang: str, phrases, starts: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
        n = len(often)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, k, dtype=np.int32)), pa.repeat(pa.scalar(lang, pa.string()), n), phrases,
                pa.array(starts.astype(np.int32)), pa.array(often.astype(np.int64)),
            ],
            ["k", "lang", "phrase", "start", "n"],
        )

    def of_block(lang: str, plain: list[bytes], ids: np.ndarray, carried: int) -> Iterator[pa.RecordBatch]:
        tables, words = shared.value, pa.array(plain, pa.binary()).cast(pa.string())
        if step < shards:
            often = np.bincount(ids[carried:], minlength=len(words))
            often[0] = 0
            seen = np.flatnonzero(often)
            yield batch_of(1, lang, words.take(pa.array(seen)), np.zeros(len(seen)), often[seen])
        if not tables.get(1):
            return
        hashes = word_hashes(lang, plain)
        # Of the k-word phrase that starts at a place: its number among the distinct ones, -1 if a
        # part of it has not reached the threshold.
        reached = reached_in(hashes, tables[1])
        reached[0] = NEVER
        number = np.where(reached[ids] < NEVER, ids, -1).astype(np.int64)
        folded = fold(np.uint64(42), hashes)
        for k in range(2, longest + 1):
            if len(ids) < k:
                return
            at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
            left, last = number[at], ids[at + k - 1]
            distinct, first, back = np.unique(left * len(words) + last, return_index=True, return_inverse=True)
            starts = np.maximum(reached[left[first]], reached[number[at[first] + 1]]) + 1
            often = np.bincount(back[at + k - 1 >= carried], minlength=len(distinct))
            active = np.flatnonzero((starts <= step) & (step < starts + shards) & (often > 0))
            where = at[first[active]]
            parts = [words.take(pa.array(ids[where + i])) for i in range(k)]
            if len(active):
                yield batch_of(k, lang, pc.binary_join_element_wise(*parts, " "), starts[active], often[active])
            if k == longest or not tables.get(k):
                return
            folded = fold(folded[left[first]], hashes[last[first]])
            # None before its own count began, so that every step says the same.
            reached = np.maximum(reached_in(folded, tables[k]), starts)
            number = np.full(len(ids) - k + 1, -1, dtype=np.int64)
            number[at] = np.where(reached[back] < NEVER, back, -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of_block(batch.column("lang")[i].as_py(), *_unpacked(batch, i), batch.column("carried")[i].as_py())

    return scan


def frequent_phrases(
    frame: DataFrame, lang: Column, text: Column, longest: int = 3, threshold: int = 10, shards: int = 2,
    block_tokens: int = BLOCK_TOKENS, task_tokens: int = TASK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """((k, lang, phrase, a), (lang, n)): phrases of up to ``longest`` words that occur ``threshold``
    times or more in a language, with their exact counts, and the words of each language.

    A-Z are lower-cased; ``. , ; : ! ?`` and the characters from line feed to carriage return end
    a piece; words are what blanks and tabs part; a phrase lies within a piece of one text. Null
    texts are empty, a null language is ``und``. Every step is written to the shared folder.
    """
    spark = frame.sparkSession
    texts = frame.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), text.cast("string").alias("text"))
    blocks = stored(texts.filter("text is not null").mapInArrow(_blocks(shards, longest, block_tokens, task_tokens), BLOCKS), "phrase-blocks")
    tables: dict[int, dict[int, tuple[int, np.ndarray]]] = {k: {} for k in range(1, longest)}
    states: list[DataFrame] = []
    closed: list[DataFrame] = []
    step = 0
    # A phrase is active up to one cycle after the later of its parts has reached the threshold.
    while step < shards or any(t >= step - shards for k in tables for t in tables[k]):
        shared = spark.sparkContext.broadcast(tables)
        counted = blocks.filter(F.col("shard") == step % shards).mapInArrow(_counted(step, shards, longest, shared), COUNTED)
        rows = counted.withColumn("reached", F.lit(None).cast("int"))
        if states:
            rows = rows.unionByName(states[-1].filter(F.col("start") > step - shards))
        summed = rows.groupBy("k", "lang", "phrase").agg(
            F.max("start").alias("start"), F.sum("n").alias("n"), F.max("reached").alias("reached")
        )
        summed = summed.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= threshold, step)))
        over = F.col("start") == step - shards + 1
        state = stored(summed.filter(~over | (F.col("n") >= threshold)), f"phrase-step-{step}")
        new = dict(state.filter((F.col("reached") == step) & (F.col("k") < longest)).groupBy("k").count().collect())
        for k, rows_k in new.items():
            tables[k][step] = bit_table(state.filter((F.col("reached") == step) & (F.col("k") == k)), k, rows_k)
        shared.unpersist()
        if step >= shards - 1:
            closed.append(state.filter(over).select("k", "lang", "phrase", F.col("n").alias("a")))
        states.append(state)
        step += 1
    frequent = closed[0]
    for more in closed[1:]:
        frequent = frequent.union(more)
    totals = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"), "phrase-totals")
    frequent = stored(frequent, "phrases")
    for done in (blocks, *states):
        discard(done)
    return frequent, totals


def collocations(
    frame: DataFrame, lang: Column, text: Column, longest: int = 3, threshold: int = 10, top: int = 2000, shards: int = 2,
    covered_percent: int = 50, **blocks: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words per language.

    ``a`` counts a phrase (see ``frequent_phrases``), ``l`` and ``r`` its part before and after a
    cut, ``n`` the language's words; the score floor(1000000 a a / (l r)) is that of the cut with
    the least one, ties to the first cut. Phrases inside a longer phrase that has reached the
    threshold and ``covered_percent`` of their count are left out. Order: score and a descending, then
    the phrase by its UTF-8 bytes. Products are whole numbers of up to 38 digits, so counts up to
    10^15 are exact.

    Repeated rows count as often as they are there. Null and empty texts give nothing, as does an
    empty frame. Other columns are not read.
    """
    frequent, totals = frequent_phrases(frame, lang, text, longest, threshold, shards, **blocks)
    candidates = frequent.filter("k >= 2").withColumn("words", F.split("phrase", " "))

    def part(begin: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", begin, size), " ")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k")).alias("right")
    )
    single = frequent.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    scored = cuts.join(single, ["lang", "left"]).join(single.toDF("lang", "right", "r"), ["lang", "right"])
    whole = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    scored = scored.withColumns({"over": F.lit(1000000).cast("decimal(7,0)") * (whole["a"] * whole["a"]), "under": whole["l"] * whole["r"]})
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best"))
    inside = candidates.filter("k >= 3").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("k") - size + 1), lambda begin: part(begin, size))))).alias("phrase"),
    )
    covers = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer") * 100 < F.col("a") * covered_percent, F.lit(True))
    )
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    # The first of each of a language's parts, then the first of these: no task gets a whole language.
    part_of = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = Window.partitionBy("lang", "part").orderBy(*order)
    few = part_of.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
        "n", F.col("best.score").alias("score"),
    )
