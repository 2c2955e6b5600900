"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own texts. A text is encoded with
every dictionary; the language whose encoding is smallest is chosen, and the choice is rejected
where the runner-up is nearly as small. Texts are lower-cased and reduced to letters first. Long
texts are encoded in pieces, all of them, so that the dictionary counts as much at a text's end
as at its start.

Sizes are whole bytes, so texts of a few words come out equally long in several languages. Where
that happens to a short text, it is encoded again right after each of a number of stretches of the
language's dictionary, in one frame with the stretch; the mean growth is a size in parts of a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import PLACE_BITS, packed, place, quoted, stored

UNKNOWN = "und"
# Bounds of the dictionaries: bytes each, documents per language, characters taken of one.
DICTIONARY_BYTES = 112_000
DICTIONARY_DOCS = 400
DICTIONARY_CHARS = 2_000
PIECE_BYTES = 8_192
LEVEL = 9
# Runner-up larger by less than this share: too close to call.
NARROW_MARGIN = 0.003
# Up to so many bytes a text that is too close to call is measured again, after so many stretches of so many bytes.
SHORT_BYTES = 256
STRETCHES, STRETCH_BYTES, STRETCH_LEVEL = 24, 3_072, 3

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased words with blanks around them; empty if there is no letter."""
    reduced = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {reduced} " if any(map(str.isalpha, reduced)) else ""


def learn(frame: DataFrame, lang: Column, text: Column, key: Column) -> dict[str, bytes]:
    """A dictionary per language, the most frequent first, from a bounded sample picked by a hash of ``key``.

    Null languages and texts are left out, and so are languages without any letter in their sample.
    """
    first = Window.partitionBy("lang").orderBy("at", "key")
    rows = frame.filter(lang.isNotNull()).select(lang.alias("lang"), text.alias("text"), key.alias("key"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    # A hash below this share of its range leaves some three times as many as are wanted, whatever
    # a language's size. Keys alone are ranked, so texts move for the picked documents only.
    share = F.least(F.lit(1.0), 3.0 * DICTIONARY_DOCS / F.col("n"))
    keys = stored(
        rows.select("lang", "key", place(21, F.col("key")).alias("at"))
        .join(counts, "lang").filter(F.col("at") <= share * float(1 << PLACE_BITS)).select("lang", "key", "at").distinct()
        .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= DICTIONARY_DOCS),
        "language-keys",
    )
    picked = (
        # At most DICTIONARY_DOCS rows a language.
        rows.filter(F.col("text").isNotNull()).join(F.broadcast(keys), ["lang", "key"])
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("n", "text")))
        .filter(F.col("r") <= DICTIONARY_DOCS)
        .select("lang", "r", F.substring("text", 1, DICTIONARY_CHARS).alias("text"))
    )
    texts: dict[str, list] = {}
    for row in picked.toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["r"], plain(row["text"])))
    often = {r["lang"]: r["n"] for r in counts.toLocalIterator()}
    found = {}
    for name in sorted(texts, key=lambda t: (-often[t], t)):
        content = "".join(t for _, t in sorted(texts[name])).encode()[:DICTIONARY_BYTES]
        if content.strip():
            found[name] = content
    return found


def _least(sizes: list) -> tuple[int, float]:
    """Place of the least size, the first of equal ones, and the share by which the runner-up is larger."""
    best = sizes.index(min(sizes))
    others = [s for i, s in enumerate(sizes) if i != best]
    return best, 1.0 if not others else (min(others) - sizes[best]) / max(1, min(others))


class Classifier:
    """Encodes texts with every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        self.encoders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.encoders.append(
                zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_dict_id=False)
            )

        self.framed = zstandard.ZstdCompressor(level=STRETCH_LEVEL, write_content_size=False)
        self.stretches = []
        for content in dictionaries.values():
            last = max(0, len(content) - STRETCH_BYTES)
            parts = [content[a : a + STRETCH_BYTES] for a in (last * i // (STRETCHES - 1) for i in range(STRETCHES))]
            self.stretches.append([(p, len(self.framed.compress(p))) for p in parts])

    def fine_sizes(self, text: str) -> list[float]:
        """The mean number of bytes by which the text lengthens the encoding of a stretch it follows."""
        raw = text.encode()
        return [
            sum(len(self.framed.compress(part + raw)) - size for part, size in parts) / STRETCHES for parts in self.stretches
        ]

    def sizes(self, text: str) -> list[int]:
        raw = text.encode()
        pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the margin is the runner-up's excess as a share of its size."""
        reduced = plain(text) if text else ""
        if not reduced or not self.names:
            return UNKNOWN, 0.0, 0.0
        best, margin = _least(self.sizes(reduced))
        if margin < NARROW_MARGIN and len(reduced.encode()) <= SHORT_BYTES:
            best, margin = _least(self.fine_sizes(reduced))
        return self.names[best], margin / (margin + NARROW_MARGIN), margin


def identify(frame: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and accepted to every row.

    A null text and one without a letter is ``und``, score 0, not accepted; so is every text if
    nothing was learned. Equal sizes, finely measured where a text is short, go to the language that
    comes first in ``dictionaries``, the most frequent one, and are not accepted. With one language only, the margin counts as 1. Input columns named like the added
    ones, in any case, are replaced; other columns and repeated rows stay.
    """

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([classifier(t) for t in texts], columns=["lang", "score", "margin"])

    classify.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judged = F.pandas_udf(classify, "lang string, score double, margin double")
    work, kept = packed(frame, ("lang_pred", "score", "accepted"), judged=judged(F.col(quoted(text_col))))
    return work.select(
        *kept, F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"),
        (F.col("judged.margin") >= NARROW_MARGIN).alias("accepted"),
    )
