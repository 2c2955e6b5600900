"""Token counts of whole documents for byte-level BPE tokenizers, without token ids.

BPE works inside pre-tokens, so a document has as many tokens as its pre-tokens together:

1. Documents are cut into blocks of bounded text. A block keeps, per document, how often each
   of its pre-tokens occurs, and once per block the list of its distinct pre-tokens.
2. The lists are dealt by pre-token into slices. In a slice every distinct pre-token of the
   corpus is encoded once; each block's list is answered by a list of piece counts.
3. The answers join the block's frequencies, and counts times frequencies are summed.

Only distinct pre-tokens per block are exchanged, never (document, pre-token) rows, and a very
frequent pre-token comes once from each block.
"""

from __future__ import annotations

import ctypes
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import settings, stored
from tallyhouse.llm.spans import SpanHasher

BLOCK_CHARS = 8_000_000
CHUNK_CHARS = 250_000
SLICE_BYTES = 16_000_000

# Whole texts go to the workers in batches of so many, or of so many bytes.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

# The code points Unicode calls white space, and the contraction endings that the
# byte-level pre-tokenizer splits off.
WHITE_SPACE = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _SPACE, _BREAK = 0, 1, 2, 3, 4
# Between texts; no text holds a surrogate.
_SEPARATOR = 0xD800


def sign_classes() -> np.ndarray:
    """Class of every code point. Made on the driver and sent along: tasks keep nothing between them."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major in "LN":
            kinds[point] = _LETTER if major == "L" else _NUMBER
    kinds[WHITE_SPACE] = _SPACE
    kinds[_SEPARATOR] = _BREAK
    return kinds


def boundaries(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in texts joined by separators; ``classes`` by code point.

    A pre-token is a contraction ending, or a run of letters, of numbers or of other signs with
    at most one blank before it, or a run of white space less the last sign where text follows.
    """
    kinds = classes[points]
    n = len(points)
    before, after = np.empty_like(kinds), np.empty_like(kinds)
    before[0], before[1:], after[-1], after[:-1] = _BREAK, kinds[:-1], _BREAK, kinds[1:]
    starts = kinds != before
    space = kinds == _SPACE
    # A blank leads the run after it; other white space doesn't.
    starts[1:] &= ~((points[:-1] == 0x20) & ~space[1:] & (kinds[1:] != _BREAK))
    starts |= space & (before == _SPACE) & (after < _SPACE)
    quotes = np.flatnonzero(starts & (points == 0x27))
    if len(quotes):
        padded = np.concatenate([points, np.full(2, _SEPARATOR, dtype=points.dtype)])
        done = np.zeros(len(quotes), dtype=bool)
        for ending in CONTRACTIONS:
            hit = ~done
            for k, sign in enumerate(ending):
                hit &= padded[np.minimum(quotes + 1 + k, n)] == ord(sign)
            done |= hit
            at = quotes[hit]
            starts[at + 1] = False
            rest = at + 1 + len(ending)
            rest = rest[rest < n]
            starts[rest] |= kinds[rest] == _LETTER
    own = kinds != _BREAK
    first = np.flatnonzero(starts & own)
    edges = np.flatnonzero(starts | ~own)
    ends = np.append(edges, n)[np.searchsorted(edges, first, side="right")]
    return first, ends


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer((chr(_SEPARATOR).join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Little-endian words, all first bytes first: what zstandard packs best."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplaned(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _hand_back() -> None:
    """Gives the system what memory is free: workers live on, and their executor needs it for other work."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class _Block:
    """Frequencies and distinct pre-tokens of some documents."""

    def __init__(self) -> None:
        self.chars = 0
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.specials: list[int] = []
        self.known: dict[int, int] = {}
        self.strings: list[str] = []
        self.sizes: list[np.ndarray] = []  # distinct pre-tokens per document
        self.places: list[np.ndarray] = []
        self.often: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str], special: list[str], hasher: SpanHasher, classes: np.ndarray) -> None:
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces, found = [text], 0
            for token in special:
                cut = [p for piece in pieces for p in piece.split(token)]
                found += len(cut) - len(pieces)
                pieces = cut
            parts += pieces
            owner += [i] * len(pieces)
            self.specials.append(found)
            self.n_bytes.append(len(text.encode()))
        self.ids += ids
        self.chars += sum(map(len, texts))
        points = _points(parts)
        if not len(points):
            self.sizes.append(np.zeros(len(texts), dtype=np.int64))
            return
        starts, ends = boundaries(points, classes)
        hashes = hasher(points, starts, ends)
        part = np.searchsorted(np.flatnonzero(points == _SEPARATOR), starts)
        document = np.asarray(owner, dtype=np.int64)[part]
        distinct, first, local = np.unique(hashes, return_index=True, return_inverse=True)
        mapped = np.empty(len(distinct), dtype=np.int64)
        joined = chr(_SEPARATOR).join(parts)
        known, strings = self.known, self.strings
        for k, (h, a, b) in enumerate(zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
            at = known.get(h)
            if at is None:
                at = known[h] = len(strings)
                strings.append(joined[a:b])
            mapped[k] = at
        pairs, often = np.unique((document << 32) | mapped[local], return_counts=True)
        self.sizes.append(np.bincount(pairs >> 32, minlength=len(texts)))
        self.places.append((pairs & 0xFFFFFFFF).astype(np.uint32))
        self.often.append(often.astype(np.uint32))

    def rows(self, block: str, slices: int) -> pd.DataFrame:
        sizes = np.concatenate(self.sizes)
        places = np.concatenate([*self.places, np.zeros(0, dtype=np.uint32)])
        often = np.concatenate([*self.often, np.zeros(0, dtype=np.uint32)])
        steps = np.diff(places.astype(np.int64), prepend=0)
        begin = np.cumsum(sizes) - sizes
        begin = begin[sizes > 0]
        steps[begin] = places[begin]
        out = {
            "block": [block], "slice": [-1], "words": [None], "ids": [self.ids], "n_bytes": [self.n_bytes],
            "specials": [self.specials], "sizes": [_planes(sizes)], "places": [_planes(steps)], "often": [_planes(often)],
        }
        by_slice: dict[int, list[int]] = {}
        for h, at in self.known.items():
            by_slice.setdefault(h % slices, []).append(at)
        for number, members in by_slice.items():
            # Sorted lists pack well; the places say which pre-token of the block is which.
            members.sort(key=self.strings.__getitem__)
            words = chr(_SEPARATOR).join(self.strings[m] for m in members)
            out["block"].append(block)
            out["slice"].append(number)
            out["words"].append(zstandard.ZstdCompressor(level=3).compress(words.encode("utf-8", "surrogatepass")))
            for name in ("ids", "n_bytes", "specials", "sizes", "often"):
                out[name].append(None)
            out["places"].append(_planes(np.asarray(members, dtype=np.uint32)))
        return pd.DataFrame(out)


def _blocks(special: list[str], slices: int, block_chars: int, packed_classes: bytes):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, block, hasher = TaskContext.get().partitionId(), 0, _Block(), SpanHasher()
        classes = np.frombuffer(zlib.decompress(packed_classes), dtype=np.uint8)
        for batch in batches:
            ids, texts = batch["id"].tolist(), ["" if t is None else t for t in batch["text"]]
            begin = chars = 0
            for at, text in enumerate(texts):
                chars += len(text)
                if chars >= CHUNK_CHARS or at + 1 == len(texts):
                    block.add(ids[begin : at + 1], texts[begin : at + 1], special, hasher, classes)
                    begin, chars = at + 1, 0
                    if block.chars >= block_chars:
                        yield block.rows(f"{task}-{number}", slices)
                        number, block = number + 1, _Block()
                        _hand_back()
        if block.ids:
            yield block.rows(f"{task}-{number}", slices)
        del block
        _hand_back()

    return cut


def _answers(tokenizer_json: str):
    def encode(group: pd.DataFrame) -> pd.DataFrame:
        # A task has one core; threads of the library's own would each hold on to memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        lists = [
            zstandard.ZstdDecompressor().decompress(w).decode("utf-8", "surrogatepass").split(chr(_SEPARATOR))
            for w in group["words"]
        ]
        distinct = sorted(set().union(*lists))
        pieces: dict[str, int] = {}
        for at in range(0, len(distinct), 4096):
            some = distinct[at : at + 4096]
            encoded = tokenizer.encode_batch_fast(some, add_special_tokens=False)
            pieces.update(zip(some, map(len, encoded), strict=True))
        counts = [_planes(np.fromiter((pieces[w] for w in words), dtype=np.uint32)) for words in lists]
        found = pd.DataFrame({"block": group["block"], "places": group["places"], "counts": counts})
        del lists, distinct, pieces, tokenizer
        _hand_back()
        return found

    return encode


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            parts = [(_unplaned(a["places"]), _unplaned(a["counts"])) for a in (row.answers if row.answers is not None else [])]
            table = np.zeros(max((int(p.max()) + 1 for p, _ in parts if len(p)), default=1), dtype=np.int64)
            for where, counts in parts:
                table[where] = counts
            sizes = _unplaned(row.sizes).astype(np.int64)
            steps, often = _unplaned(row.places).astype(np.int64), _unplaned(row.often).astype(np.int64)
            ends = np.cumsum(sizes)
            begin = ends - sizes
            running = np.cumsum(steps)
            filled = sizes > 0
            base = np.repeat(running[begin[filled]] - steps[begin[filled]], sizes[filled])
            tokens = np.asarray(row.specials, dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(table[running - base] * often)])
            yield pd.DataFrame({"id": list(row.ids), "n_bytes": row.n_bytes, "n_tokens": tokens + sums[ends] - sums[begin]})


def count_tokens(
    frame: DataFrame, id_col: str, text_col: str, tokenizer_path: str, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per input row: the id column, n_bytes (UTF-8) and n_tokens (without special tokens added).

    For byte-level BPE in the ``tokenizers`` JSON format, with the file read on the driver. A
    special token's string inside a text counts as that one token. Null texts count as empty:
    0 bytes, 0 tokens. Null ids and repeated rows stay rows of their own; other columns are not
    read, whatever their names. An empty frame gives an empty one.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    described = json.loads(tokenizer_json)
    if (described.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or described.get("normalizer"):
        raise ValueError("count_tokens needs a byte-level BPE tokenizer without normalizer")
    special = [t["content"] for t in described.get("added_tokens", [])]
    texts = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    with settings(frame.sparkSession, SMALL_BATCHES):
        blocks = stored(
            texts.mapInPandas(
                _blocks(special, slices, block_chars, zlib.compress(sign_classes().tobytes())),
                f"block string, slice int, words binary, ids array<{id_type}>, n_bytes array<bigint>, specials array<bigint>, "
                "sizes binary, places binary, often binary",
            ),
            "token-blocks",
        )
    answers = (
        blocks.filter("slice >= 0")
        .select("block", "slice", "words", "places")
        .groupBy("slice")
        .applyInPandas(_answers(tokenizer_json), "block string, places binary, counts binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("places", "counts")).alias("answers"))
    )
    return (
        blocks.filter("slice < 0")
        .select("block", "ids", "n_bytes", "specials", "sizes", "places", "often")
        .join(answers, "block", "left")
        .mapInPandas(_totals, f"id {id_type}, n_bytes bigint, n_tokens bigint")
        .withColumnRenamed("id", id_col)
    )
