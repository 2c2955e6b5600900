"""Main text of web pages, by markup and by a suffix array over each host's pages.

1. A page is read into blocks. Text inside ``article`` or ``main`` is main text; text inside menus,
   headers, footers, sidebars, notices, adverts, forms and reader comments is labelled as such;
   the rest is open.
2. Hashes of open whole blocks and long runs are counted over all pages of a host.
3. The pages of a host, in parts of bounded size, lay their labelled and open token streams end to
   end. A suffix array orders all places by what follows, so that equal runs are neighbours; of each
   group of equal open runs one is looked up in the counts.
4. A page with main text keeps that, whole and in page order. A page without keeps its open text
   but for the whole blocks and long runs that several distinct texts of the host have; phrases
   inside running text stay. Labelled runs are dropped even where they are unique.

Main text is never removed for being repeated: copied articles and shared passages are text. Copies
of a whole page are one text, so what only they have stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import place, stored
from tallyhouse.llm.spans import SpanHasher, mixed

# Labelled tokens a run must share with another page to count, and pages of a host that meet in a task.
RUN_TOKENS = 4
HOST_BLOCK_PAGES = 256
# A part holds about so many bytes of pages at most; a page alone may be larger.
PART_BYTES = 16 << 20
# Open text is boilerplate as a whole block, or as a run that is too long for a phrase, on so many distinct texts.
BLOCK_TOKENS, LONG_TOKENS = 4, 16
LEAST_TEXTS = 3

MAIN, LABELLED, OPEN = 0, 1, 2

_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "head", "object", "canvas", "math")
_LABELLED_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "header"}
_LABELLED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "note"}
# Names of classes and ids that label, word by word: known ones, pairs that make one, and what may stand before and after.
_KNOWN = set(
    "nav navbar navigation menu header masthead footer sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "banner popup modal alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
    "commentlist response responses respond disqus share sharing social related recommended newsletter subscribe signup login search "
    "widget widgets toolbar pagination pager teaser teasers readmore".split()
)
_KNOWN_PAIRS = {
    ("side", "bar"), ("nav", "bar"), ("tool", "bar"), ("bread", "crumb"), ("bread", "crumbs"), ("read", "more"), ("sign", "up"),
    ("log", "in"), ("pop", "up"), ("news", "letter"),
}
_BEFORE = set("main top site page left right bottom global mobile desktop sub primary secondary inner outer".split())
_AFTER = set(
    "box bar wrap wrapper container holder list area section block panel item items link links button buttons icon icons form field "
    "input toggle group row col column slot unit overlay message left right top bottom main primary secondary mobile "
    "desktop inner outer posts articles stories topics".split()
)
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "response", "responses"}
_CASE_CHANGE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Inside main text an id, which is often made from a heading's words, labels these alone.
_LABELLED_BY_ID = {"div", "aside", "nav", "ul", "ol", "form", "footer", "header", "table"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def name_words(name: str) -> list[str]:
    """A class or id as lower-case words, split at dashes, underscores and changes of case; numbers at the end go."""
    words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", _CASE_CHANGE.sub("-", name).lower())]
    return [w for w in words if w]


def is_label(words: list[str]) -> bool:
    """True if the words are a known name, with nothing but the listed words before and after it."""
    seen, at = False, 0
    while at < len(words):
        pair = tuple(words[at : at + 2]) in _KNOWN_PAIRS
        if pair or words[at] in _KNOWN:
            seen = True
        elif words[at] not in (_AFTER if seen else _BEFORE):
            return False
        at += 1 + pair
    return seen


def _kind_of(tag: str, attributes: str, inside: int, in_comments: bool) -> tuple[int, bool]:
    """Kind of an element's text given its parent's; True if it holds reader comments.

    Names never label a heading inside main text, and an id only what it may be the frame of.
    """
    labels: list[list[str]] = []
    roles: set[str] = set()
    if attributes and "=" in attributes:
        for name, *values in _NAMED.findall(attributes):
            names = html.unescape("".join(values)).split()
            kind = name.lower()
            if kind not in ("class", "id"):
                roles.update(n.lower() for n in names)
            elif not (tag in _HEADINGS and (kind == "id" or inside == MAIN)) and (kind == "class" or inside != MAIN or tag in _LABELLED_BY_ID):
                found = [words for words in map(name_words, names) if is_label(words)]
                # As the element does, a class "header" inside main text holds the article's heading.
                labels += [words for words in found if inside != MAIN or _KNOWN & set(words) != {"header"}]
    if in_comments or any(_COMMENTS & set(words) for words in labels):
        return LABELLED, True
    if labels or roles & _LABELLED_ROLES:
        # The heading of an article belongs to it.
        if inside == MAIN and tag == "header" and not roles & _LABELLED_ROLES:
            return inside, False
        return LABELLED, False
    if tag in ("article", "main") or "main" in roles or "articlebody" in roles:
        return MAIN, False
    if tag in _LABELLED_TAGS and not (tag == "header" and inside == MAIN):
        return LABELLED, False
    return inside, False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; white space inside a block is one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []
    kind, at = OPEN, 0
    parts: list[str] = []

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    for m in _PIECE.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                close_block()
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            close_block()
        if tag in _VOID:
            continue
        if m["close"]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag), None)
            if depth is not None:
                if tag in _INLINE and stack[-1][0] != tag:
                    # A stray inline end tag doesn't end the blocks around it.
                    continue
                if kind != (stack[depth - 1][1] if depth else OPEN):
                    close_block()
                del stack[depth:]
        else:
            ended = {"p"} if tag in _CLOSES_P else _SIBLINGS.get(tag, set())
            while stack and (stack[-1][0] in ended or (ended and stack[-1][0] in _INLINE)):
                stack.pop()
            parent, talk = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            own, own_talk = _kind_of(tag, m["attributes"], parent, talk)
            if own != kind:
                close_block()
            if not m["attributes"].endswith("/") or tag not in _INLINE:
                stack.append((tag, own, own_talk))
        kind = stack[-1][1] if stack else OPEN
    if at < len(page):
        # A "<" that opens no tag is text; an unfinished tag at the end is not.
        parts.append(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", page[at:]))
    close_block()
    return out


def repeated_places(
    tokens: np.ndarray, pages: np.ndarray, run: int = RUN_TOKENS, parts: np.ndarray | None = None,
    known: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Marks tokens covered by a run of ``run`` tokens that also stands on another page.

    With ``known``, it decides instead on the runs that start at the given places, one of each.
    ``parts`` rises along the stream where runs must not go on; pages end them anyway.

    Suffixes are ordered by prefix doubling as far as ``run`` tokens, which is all that tells
    whether they share a run; longer shared passages are covered by their runs.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n < run:
        return covered[:n] > 0
    # Rank of the first ``depth`` tokens of each suffix, for those that do not pass the end of a part.
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ends_here = np.diff(pages, append=pages[-1] + 1) != 0
    if parts is not None:
        ends_here |= np.diff(parts, append=parts[-1] + 1) != 0
    last = np.flatnonzero(ends_here)
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.where(np.arange(n) + step < n, np.arange(n) + step, n - 1)
        rank = np.unique(rank * (n + 1) + rank[ahead], return_inverse=True)[1].astype(np.int64)
        depth += step
    whole = np.flatnonzero(left >= run)
    order = whole[np.lexsort((pages[whole], rank[whole]))]
    if not len(order):
        return covered[:n] > 0
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    shared = pages[order[starts]] != pages[order[ends - 1]] if known is None else known(order[starts])
    hit = order[np.repeat(shared, ends - starts)]
    np.add.at(covered, hit, 1)
    np.add.at(covered, np.minimum(hit + run, n), -1)
    return np.cumsum(covered[:n]) > 0


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parsed = [blocks(h or "") for h in batch["html"]]
        yield pd.DataFrame(
            {
                "page_id": batch["page_id"], "url": batch["url"], "host": batch["host"], "pick": batch["pick"],
                "main": [" ".join(t for k, t in p if k == MAIN) for p in parsed],
                "has_main": [any(k == MAIN for k, _ in p) for p in parsed],
                "kinds": [[k for k, _ in p if k != MAIN] for p in parsed],
                "rest": [[t for k, t in p if k != MAIN] for p in parsed],
            }
        )


def _open_text(kinds: list, rest: list, covered: np.ndarray) -> str:
    """The open tokens that are not covered."""
    words, keep = [], []
    at = 0
    for kind, text in zip(kinds, rest, strict=True):
        own = text.split(" ")
        if kind == OPEN:
            words += own
            keep += (~covered[at : at + len(own)]).tolist()
        at += len(own)
    return " ".join(w for w, k in zip(words, keep, strict=True) if k)


class _Spans:
    """Hashes of token runs of one host's texts; equal runs of a host have equal ones wherever they stand."""

    def __init__(self, host: str, words: list[str], hasher: SpanHasher):
        self.signs = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        blanks = np.flatnonzero(self.signs == 0x20)
        self.starts, self.ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(self.signs)]])
        self.seed = np.frombuffer(md5(host.encode(), usedforsecurity=False).digest()[:8], dtype=np.uint64)
        self.hasher = hasher

    def __call__(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        own = self.hasher(self.signs, self.starts[first], self.ends[first + size - 1])
        return mixed(own ^ self.seed).view(np.int64)


def _units(host: str, open_blocks: list[str], hasher: SpanHasher) -> np.ndarray:
    """Hashes of a text's distinct whole blocks and long runs."""
    sizes = np.array([t.count(" ") + 1 for t in open_blocks], dtype=np.int64)
    if not (sizes >= BLOCK_TOKENS).any():
        return np.zeros(0, dtype=np.int64)
    hashes = _Spans(host, open_blocks, hasher)
    at = np.cumsum(sizes) - sizes
    whole = sizes >= BLOCK_TOKENS
    runs = [np.arange(a, a + n - LONG_TOKENS + 1) for a, n in zip(at, sizes, strict=True) if n > LONG_TOKENS]
    found = [hashes(at[whole], sizes[whole])] + ([hashes(np.concatenate(runs), LONG_TOKENS)] if runs else [])
    return np.unique(np.concatenate(found))


def _open_blocks(kinds: list, rest: list) -> list[str]:
    return [t for k, t in zip(kinds, rest, strict=True) if k == OPEN]


def _units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with open units: a key of the whole text, equal for copies of a page, and its units."""
    hasher = SpanHasher()
    for batch in batches:
        rows = []
        for page, host, pick in zip(batch["html"], batch["host"], batch["pick"], strict=True):
            parsed = blocks(page or "")
            units = _units(host, [t for k, t in parsed if k == OPEN], hasher)
            if len(units):
                text = "\n".join(t if k == MAIN else f"\t{t}" for k, t in parsed if k != LABELLED)
                rows.append((host, pick, md5(text.encode(), usedforsecurity=False).digest(), units))
        yield pd.DataFrame(rows, columns=["host", "pick", "text_key", "units"])


def _shared_units(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per part of a host (host, part) the units in it that enough distinct texts of the whole host have."""
    read = pages.select("html", "host", "pick")
    found = stored(read.mapInPandas(_units_of, "host string, pick bigint, text_key binary, units array<bigint>"), "html-units")
    # A unit's hash depends on its host, so it is a key by itself; counts are summed before they move.
    once = found.groupBy("host", "text_key").agg(F.first("units").alias("units"))
    shared = (
        once.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("texts"))
        .filter(F.col("texts") >= LEAST_TEXTS).select("unit")
    )
    here = (
        found.join(sizes, "host").select("host", (F.col("pick") % F.col("parts")).alias("part"), F.explode("units").alias("unit")).distinct()
    )
    return here.join(shared, "unit").select("host", "part", "unit")


def _of_host(group: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["page_id", "url"], kind="stable", na_position="last")
    shared = units["unit"].to_numpy(dtype=np.int64)
    streams = [[w for text in rest for w in text.split(" ")] for rest in group["rest"]]
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    known: dict[str, int] = {}
    tokens = np.fromiter((known.setdefault(w, len(known)) for s in streams for w in s), dtype=np.int64, count=int(sizes.sum()))
    pages = np.repeat(np.arange(len(sizes)), sizes)
    # An open block is a part of its own; labelled ones go on, as menus have a block per entry.
    parts, is_open, number, block_at, block_size = [], [], 0, [], []
    for kinds, rest in zip(group["kinds"], group["rest"], strict=True):
        before = OPEN
        for kind, text in zip(kinds, rest, strict=True):
            number += kind == OPEN or before == OPEN
            before = kind
            size = text.count(" ") + 1
            if kind == OPEN and size >= BLOCK_TOKENS:
                block_at.append(len(parts))
                block_size.append(size)
            parts += [number] * size
            is_open += [kind == OPEN] * size
    parts, is_open = np.asarray(parts, dtype=np.int64), np.asarray(is_open, dtype=bool)
    covered = repeated_places(tokens, pages, parts=parts) & ~is_open
    if len(shared) and block_at:
        hashes = _Spans(group["host"].iloc[0], [w for s in streams for w in s], SpanHasher())
        long = repeated_places(tokens, pages, LONG_TOKENS, parts, lambda first: np.isin(hashes(first, LONG_TOKENS), shared))
        covered |= long & is_open
        whole = np.isin(hashes(np.array(block_at), np.array(block_size)), shared)
        for at, size in zip(np.array(block_at)[whole], np.array(block_size)[whole], strict=True):
            covered[at : at + size] = True
    ends = np.cumsum(sizes)
    texts = [
        main if has_main else _open_text(list(kinds), list(rest), covered[end - size : end])
        for main, has_main, kinds, rest, size, end in zip(
            group["main"], group["has_main"], group["kinds"], group["rest"], sizes, ends, strict=True
        )
    ]
    return pd.DataFrame(
        {
            "page_id": group["page_id"], "url": group["url"], "text": texts, "n_chars": [len(t) for t in texts],
            "boilerplate_tokens": [int(covered[e - s : e].sum()) for s, e in zip(sizes, ends, strict=True)],
        }
    )


def extract(frame: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points), boilerplate_tokens.

    A null or empty page, and one without any kept text, has text "" and 0 characters. Pages with
    null or odd URLs form a host of their own. Repeated rows are pages of their own. Other
    columns are not read. An empty frame gives an empty one.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = frame.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    parts = F.greatest(F.count("*") / HOST_BLOCK_PAGES, F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / PART_BYTES, F.lit(1.0))
    sizes = stored(pages.groupBy("host").agg(F.ceil(parts).cast("int").alias("parts")), "host-sizes")
    id_type = pages.schema["page_id"].dataType.simpleString()
    pages = pages.withColumn("pick", place(71, F.col("page_id"), F.col("url")))
    parsed = pages.mapInPandas(
        _parse,
        f"page_id {id_type}, url string, host string, pick bigint, main string, has_main boolean, kinds array<int>, rest array<string>",
    )
    dealt = parsed.join(sizes, "host").withColumn("part", F.col("pick") % F.col("parts")).drop("pick", "parts")
    return (
        dealt.groupBy("host", "part").cogroup(_shared_units(pages, sizes).groupBy("host", "part"))
        .applyInPandas(_of_host, f"page_id {id_type}, url string, text string, n_chars bigint, boilerplate_tokens bigint")
    )
