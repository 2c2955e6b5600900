"""Near-duplicate documents by b-bit MinHash.

1. A document's words make a set of shingles; its minima under 128 hash functions are taken.
   Documents with equal sets form a class, and only classes are compared.
2. The minima's low four bits are packed into a signature of 64 bytes. Bands of whole minima
   give the buckets in which candidates meet.
3. In a bucket a class is compared with a hub rather than with all others: the share of equal
   four-bit fields, corrected for chance collisions, estimates the similarity; each class's best
   hub is confirmed on the full shingle sets. A round of hubs unites most of a large group.
4. Classes of a bucket that are still apart are compared in tiles: by signature, and by their sets
   where the estimate can't rule a link out. A tile hands on a spanning forest of its links, which
   is confirmed like the hubs'. So no link is lost, and a large group is never expanded into pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import place, settings, stored
from tallyhouse.llm.components import components
from tallyhouse.llm.spans import SpanHasher, mixed

MINIMA, BITS, BANDS, BAND_ROWS = 128, 4, 24, 4
FIELDS = 64 // BITS
CHANCE = 2.0**-BITS
# Six deviations of the estimate: what lies further below the threshold is no link.
SLACK = 0.2
HUB_ROUNDS = 1
TILE = 1_024
CLUSTER_CLASSES = 8 * TILE
ROWS_AT_ONCE = COLUMNS_AT_ONCE = 4_096
# Scans of this size on are worth a Bloom filter; by default only those of 10 GB are.
BLOOM_FROM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
# So few pairs of a tile are compared one by one; more as a product of membership grids.
FEW_PAIRS = 64
# Bits of a shingle's hash that move to the tiles at first.
SMALL_BITS = 32
_LOW_BITS = 0x1111111111111111

_random = np.random.default_rng(20_250_101)
_FACTORS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2)


def shingle_hashes(text: str | None, size: int, hasher: SpanHasher) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    signs = np.frombuffer(b" ".join(words), dtype=np.uint8)
    blanks = np.flatnonzero(signs == 0x20)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(signs)]])
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(hasher(signs, starts, ends))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        some = hashes[at : at + ROWS_AT_ONCE, None] * _FACTORS + _OFFSETS
        np.minimum(least, some.min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the (spread) minima, sixteen to a word."""
    fields = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(-1, FIELDS)
    return (fields << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _set_key(hashes: np.ndarray) -> bytes:
    from hashlib import md5

    return md5(hashes.tobytes(), usedforsecurity=False).digest()


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = SpanHasher()
        for batch in batches:
            keys, counts, marks, bands = [], [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, size, hasher)
                counts.append(len(hashes))
                keys.append(_set_key(hashes) if len(hashes) else None)
                least = minima(hashes) if len(hashes) else None
                marks.append(None if least is None else signature(least).view(np.int64))
                bands.append(None if least is None else band_keys(least).view(np.int64))
            yield pd.DataFrame({"id": batch["id"], "n": counts, "set_key": keys, "signature": marks, "bands": bands})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = SpanHasher(), set()
        for batch in batches:
            cids, sets = [], []
            for cid, key, text in zip(batch["cid"].tolist(), batch["set_key"], batch["text"], strict=True):
                # Rows that share an id may have other texts, or the same one again.
                if cid not in seen and _set_key(own := shingle_hashes(text, size, hasher)) == key:
                    seen.add(cid)
                    cids.append(cid)
                    sets.append(own)
            small = [np.unique((s >> np.uint64(64 - SMALL_BITS)).astype("<u4")).tobytes() for s in sets]
            yield pd.DataFrame({"cid": cids, "hashes": [s.view(np.int64) for s in sets], "small": small})

    return run


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""

    def different(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(_LOW_BITS)))

    apart = F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x)
    return ((1 - apart / MINIMA) - CHANCE) / (1 - CHANCE)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for every row of ``a`` against every row of ``b``."""
    apart = np.zeros((len(a), len(b)), dtype=np.int16)
    for word in range(a.shape[1]):
        z = a[:, None, word] ^ b[None, :, word]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        apart += np.bitwise_count(z & np.uint64(_LOW_BITS))
    return ((1 - apart / MINIMA) - CHANCE) / (1 - CHANCE)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the left sets shares with each of the right ones."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for some in (left, right):
        rows = np.repeat(np.arange(len(some)), [len(s) for s in some])
        sides.append((rows, np.concatenate(some)))
    values, often = np.unique(np.concatenate([v for _, v in sides]), return_counts=True)
    values = values[often > 1]
    for at in range(0, len(values), COLUMNS_AT_ONCE):
        block = values[at : at + COLUMNS_AT_ONCE]
        grids = []
        for (rows, own), some in zip(sides, (left, right), strict=True):
            column = np.minimum(np.searchsorted(block, own), len(block) - 1)
            hit = block[column] == own
            grid = np.zeros((len(some), len(block)), dtype=np.float32)
            grid[rows[hit], column[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _links_between(percent: int, side, cid, component, n, marks, sets) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the links between the two sides of a tile task.

    Short hashes may make it hold pairs that are no links; they never hide a pair that is one.
    """
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    one_tile = bool((side == 1).all())
    lost = n - np.array([len(s) for s in sets], dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), TILE // 4):
        rows = left[at : at + TILE // 4]
        close = estimates(marks[rows], marks[right]) >= percent / 100 - SLACK
        x, y = n[rows][:, None], n[right][None, :]
        close &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        close &= component[rows][:, None] != component[right][None, :]
        if one_tile:
            # Each pair once.
            close &= cid[rows][:, None] < cid[right][None, :]
        i, j = np.nonzero(close)
        if not len(i):
            continue
        if len(i) <= FEW_PAIRS:
            both = np.array([len(np.intersect1d(sets[rows[p]], sets[right[q]], assume_unique=True)) for p, q in zip(i, j, strict=True)])
        else:
            used, used_right = np.unique(i), np.unique(j)
            grid = common_counts([sets[rows[p]] for p in used], [sets[right[q]] for q in used_right])
            both = grid[np.searchsorted(used, i), np.searchsorted(used_right, j)].astype(np.int64)
        # Shared shingles are no more than this, as each one lost here met another of its own set.
        both = both + np.minimum(lost[rows[i]], lost[right[j]])
        linked = 100 * both >= percent * (n[rows[i]] + n[right[j]] - both)
        found.append((rows[i[linked]], right[j[linked]]))
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while (above := up.get(c, c)) != c:
            c = above
        return c

    out = []
    for i, j in found:
        pairs = np.stack([component[i], component[j]], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        for k in first:
            one, two = top(int(pairs[k, 0])), top(int(pairs[k, 1]))
            if one != two:
                up[max(one, two)] = min(one, two)
                out.append((int(cid[i[k]]), int(cid[j[k]])))
    return out


def _tile_links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition holds whole tasks, sorted; the last task of a batch may go on in the next.
        rest: pd.DataFrame | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                whole, rest = rest, None
            else:
                whole = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if whole is None or not len(whole):
                continue
            key, i, j = (whole[c].to_numpy() for c in ("key", "i", "j"))
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(whole)]])
            if batch is not None:
                rest = whole.iloc[bounds[-2] :].reset_index(drop=True)
                bounds = bounds[:-1]
            side, cid, component, n = (whole[c].to_numpy() for c in ("side", "cid", "component", "n"))
            marks, sets = whole["signature"].to_numpy(), whole["small"].to_numpy()
            out = []
            for a, b in itertools.pairwise(bounds.tolist()):
                some = np.stack(marks[a:b]).astype(np.int64).view(np.uint64)
                own = [np.frombuffer(x, dtype="<u4") if isinstance(x, bytes) else np.asarray(x, dtype=np.int64) for x in sets[a:b]]
                out += _links_between(percent, side[a:b], cid[a:b], component[a:b], n[a:b], some, own)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``b`` may be a hub with many partners."""
    mine = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("_x"))
    hub = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return (
        pairs.join(mine, "a").join(hub, "b")
        .withColumn("_both", both)
        .filter(100 * F.col("_both") >= percent * (F.size("_x") + F.size("_y") - F.col("_both")))
        .select("a", "b")
    )


def near_duplicates(frame: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (least id reachable by links) and kept.

    Two documents are linked if 100 * |both sets| >= percent * |either set|. Words are runs of
    anything but ASCII white space, with A-Z lower-cased; a text with fewer words than a shingle
    is one shingle. Null texts and texts without a word have no shingle and link with nothing.
    Rows with words that share an id are one document for linking. A row with null id is linked with nothing
    and kept: component_id is null. Other columns are not read. An empty frame gives an empty one.
    Ids must be whole numbers.
    """
    texts = frame.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stored(
        texts.mapInPandas(_sign(shingle), "id bigint, n bigint, set_key binary, signature array<bigint>, bands array<bigint>"),
        "minhash-signed",
    )
    classes = stored(
        signed.filter("n > 0 and id is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "minhash-classes",
    )
    in_bands = classes.select("cid", F.explode("bands").alias("key"))
    shared = in_bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = stored(in_bands.join(shared, "key"), "minhash-members")
    marks = classes.select("cid", "n", "signature")
    suspects = stored(
        classes.select("cid", "least", "set_key").join(members.select("cid").distinct(), "cid"), "minhash-suspects"
    )
    # Few texts are needed again. The condition holds for all; it lets Spark take this side for a
    # selective one and filter the texts by a Bloom filter of its ids before they move.
    wanted = suspects.withColumnRenamed("least", "id").filter("cid >= 0")
    # A class met twice, in tasks a hot id was split over, does no harm.
    with settings(frame.sparkSession, {BLOOM_FROM: "64MB"}):
        sets = stored(
            texts.join(wanted, "id").select("cid", "set_key", "text")
            .mapInPandas(_sets(shingle), "cid bigint, hashes array<bigint>, small binary"),
            "minhash-sets",
        )
    known = stored(members.join(marks, "cid"), "minhash-buckets")
    # The texts of one id hold together from the start.
    several = (
        signed.filter("n > 0 and id is not null").groupBy("id")
        .agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).filter("one <> other").select("id")
    )
    own = signed.filter("n > 0").join(several, "id").join(classes.select("set_key", "cid"), "set_key").select("id", "cid").distinct()
    hold = own.groupBy("id").agg(F.min("cid").alias("b"))
    links = stored(own.join(hold, "id").select(F.col("cid").alias("a"), "b").filter("a <> b"), "minhash-links")
    for turn in range(HUB_ROUNDS):
        links = stored(links.union(_hub_links(_labelled(known, links), sets, percent, turn)), "minhash-links")
    rest = stored(_apart(_labelled(known, links), marks, sets.select("cid", "small"), percent), "minhash-rest")
    sure = stored(_confirm(rest, sets, percent), "minhash-sure")
    links = stored(links.union(sure), "minhash-links")
    refused = rest.join(sure, ["a", "b"], "left_anti")
    if not refused.isEmpty():
        # Short hashes that met by chance made a pair stand for a path that others may give: whole
        # hashes decide wherever its components are.
        places = stored(refused.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "minhash-refused")
        rest = _apart(_labelled(known, links), marks, sets.select("cid", F.col("hashes").alias("small")), percent, places)
        links = stored(links.union(_confirm(rest, sets, percent)), "minhash-links")
    groups = components(links)
    named = classes.select("cid", "set_key", "least").join(groups.withColumnRenamed("id", "cid"), "cid", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "cid")), "minhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "component").select("set_key", "component_id")
    return signed.select("id", "n", "set_key").join(by_set, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def _labelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with the component they have so far."""
    groups = components(links).withColumnRenamed("id", "cid")
    return known.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _hub_links(rows: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links of each class with the likeliest hub of its buckets."""
    hubs = rows.groupBy("key").agg(
        F.min(F.struct(place(31 + turn, F.col("cid"), F.col("key")).alias("at"), "cid", "component", "n", "signature")).alias("hub")
    )
    met = rows.join(hubs, "key").filter(F.col("component") != F.col("hub.component"))
    best = (
        met.withColumn("likely", estimate(F.col("signature"), F.col("hub.signature")))
        .filter(F.col("likely") >= percent / 100 - SLACK / 4)
        .groupBy("cid")
        .agg(F.max(F.struct("likely", F.col("hub.cid").alias("b"))).alias("best"))
    )
    return _confirm(best.select(F.col("cid").alias("a"), F.col("best.b").alias("b")), sets, percent)


def _apart(rows: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, places: DataFrame | None = None) -> DataFrame:
    """Links between different components that share a bucket, enough of them to join what is linked.

    Inside a task the estimate rules pairs out, and the sets (``small``: 32-bit hashes, or whole ones)
    decide on the rest; only a spanning forest leaves it. With ``places``, only clusters or buckets
    that hold part of a component of its classes are compared.

    Buckets that share classes make a cluster, and a cluster of bounded size is compared as a whole,
    so a class moves once instead of once a bucket. Larger clusters stay apart by bucket.
    Per cluster or bucket the largest component is the main one. Tasks hold a tile of it (side 0) against a
    tile of the others (side 2), or two tiles of the others (side 1 is both at once).
    """
    mixed_keys = rows.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"))
    rows = rows.select("key", "cid", "component")
    rows = stored(rows.join(mixed_keys.filter("one <> other").select("key"), "key"), "minhash-labelled")
    stars = rows.groupBy("key").agg(F.min("cid").alias("b"))
    clusters = components(rows.join(stars, "key").select(F.col("cid").alias("a"), "b")).toDF("cid", "cluster")
    bounded = F.col("size") <= CLUSTER_CLASSES
    placed = rows.join(
        clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "cluster"), "cid"
    )
    # Band keys are hashes of 64 bits and clusters small numbers; should two meet, more is compared.
    rows = stored(
        placed.select(F.when(bounded, F.col("cluster")).otherwise(F.col("key")).alias("key"), "cid", "component").distinct(),
        "minhash-clusters",
    )
    if places is not None:
        met = rows.join(rows.join(places, "cid").select("component").distinct(), "component")
        rows = rows.join(met.select("key").distinct(), "key")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("top"), F.sum("k").alias("all"), F.count("*").alias("groups"))
        .filter("groups > 1")
        .select(
            "key", (-F.col("top.c")).alias("main"), F.ceil(F.col("top.k") / TILE).cast("int").alias("tiles"),
            F.ceil((F.col("all") - F.col("top.k")) / TILE).cast("int").alias("others"),
        )
    )
    r = rows.join(main, "key").withColumn("is_main", F.col("component") == F.col("main"))
    spot = place(41, F.col("cid"))
    own = F.when(F.col("is_main"), spot % F.col("tiles")).otherwise(spot % F.col("others")).cast("int")
    r = r.withColumn("own", own)

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def task(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    of_main = F.transform(upto(F.col("others")), lambda j: task(F.col("own"), j, F.lit(0)))
    # Among the others: tile pairs are numbered below zero, the smaller tile first.
    against_main = F.transform(upto(F.col("tiles")), lambda i: task(i, F.col("own"), F.lit(2)))
    among = F.transform(
        upto(F.col("others")),
        lambda j: task(
            -1 - F.least(j, F.col("own")), -1 - F.greatest(j, F.col("own")),
            F.when(j == F.col("own"), 1).when(F.col("own") < j, 0).otherwise(2),
        ),
    )
    dealt = r.join(marks, "cid").join(sets, "cid").select(
        "key", "cid", "component", "n", "signature", "small",
        F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(against_main, among))).alias("t"),
    ).select("key", "t.i", "t.j", "t.side", "cid", "component", "n", "signature", "small")
    found = (
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInPandas(_tile_links(percent), "a bigint, b bigint")
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
