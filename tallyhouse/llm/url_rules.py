"""URL filter: allow and block entries in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import packed, quoted, stored

ADDED = ("host", "path", "rule", "verdict")
RESULT = "host string, path string, rule string, verdict string"

# Rule tables beyond either bound are joined instead of broadcast.
TRIE_RULES = 500_000
TRIE_BYTES = 32 << 20

Rule = tuple[str, str, str]  # host, path, verdict

# Keys of a trie's nodes beside labels and segments, which are strings.
PATHS, RESTS, LENGTHS = 0, 1, 2


def build_trie(rules: Iterable[Rule]) -> dict:
    """Hosts by label from the right; below a host its paths by whole segment, then by the rest's start.

    A rule fits its host and all subdomains if the url's path starts with the rule's, which may
    end inside a segment. Of the rules that fit, the longest (host and path together) wins; of
    equally long ones that with the longer host.
    """
    root: dict = {}
    ended = []
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *whole, rest = path.split("/")
        node = node.setdefault(PATHS, {})
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault(RESTS, {})[rest] = (len(host) + len(path), len(host), host + path, verdict)
        ended.append(node)
    for node in ended:
        if LENGTHS not in node:
            node[LENGTHS] = sorted(set(map(len, node[RESTS])), reverse=True)
    return root


def domain_paths(root: dict, host: str) -> list[dict]:
    """Path tries of the host and of the domains above it."""
    node, found = root, []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if PATHS in node:
            found.append(node[PATHS])
    return found


def longest_rule(tries: list[dict], path: str) -> tuple | None:
    """(length, host length, rule, verdict) of the longest rule that fits, or None."""
    segments, found = path.split("/"), None
    for node in tries:
        for at, segment in enumerate(segments):
            # Only starts as long as some rule's rest are looked up, the longest first.
            for length in node.get(LENGTHS, ()):
                hit = node[RESTS].get(segment[:length]) if length <= len(segment) else None
                if hit:
                    found = max(found or hit, hit)
                    break
            node = node.get(segment) if at + 1 < len(segments) else None
            if node is None:
                break
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = (url or "").partition("://")[2]
    ends = [p for p in map(rest.find, "/?#") if p >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    return host.encode().lower().decode(), path


def _judge(shared, default: str):
    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for urls in batches:
            known: dict[str, list[dict]] = {}
            rows = []
            for url in urls:
                host, path = split_url(url)
                tries = known.get(host)
                if tries is None:
                    tries = known[host] = domain_paths(trie, host)
                hit = longest_rule(tries, path) if tries else None
                rows.append((host, path, hit[2] if hit else None, hit[3] if hit else default))
            yield pd.DataFrame(rows, columns=list(ADDED))

    return judge


def _host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _joined(work: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by joins, for rule tables of any size.

    Every distinct host meets the rule hosts among its domains once; every distinct url is then
    cut to the path lengths these rules have, and equal starts are joined.
    """
    host, path = _host_and_path(F.col("url"))
    split = work.select("row", host.alias("host"), path.alias("path"))
    urls = split.select("host", "path").distinct()
    labels = F.split("host", "[.]")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    hosts = (
        urls.select("host").distinct().withColumn("domain", F.explode(domains))
        .join(lengths.withColumnRenamed("host", "domain"), "domain")
    )
    starts = (
        urls.join(hosts, "host")
        .withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .withColumn("start", F.substr("path", F.lit(1), F.col("length")))
    )
    fits = starts.join(
        rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), "verdict"), ["domain", "start"]
    )
    best = (
        fits.groupBy("host", "path")
        .agg(F.max(F.struct(F.length("domain") + F.length("start"), F.length("domain"), F.concat("domain", "start").alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    found = split.join(best, ["host", "path"], "left")
    return found.select("row", F.struct("host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).alias("found"))


def judge_urls(
    frame: DataFrame, url_col: str, rules: DataFrame, default: str = "allow",
    trie_rules: int = TRIE_RULES, trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per input row: its columns, then host, path, rule and verdict of the url.

    ``rules`` has host, path (null: empty) and verdict (``allow`` or ``block``); rules without
    host or verdict are left out, and one given twice blocks. The longest rule that fits decides
    (see ``build_trie``), ``default`` where none fits. The rules' size is measured first: up to
    ``trie_rules`` rows and ``trie_bytes`` bytes the trie is broadcast, beyond that rules and
    urls are joined, with the same results.

    A null url, or one without ``://``, has an empty host and path. Repeated rows stay; an empty
    frame gives an empty one, and no rules leave the default. An input column that has an added
    one's name, in any case, is replaced.
    """
    spark = frame.sparkSession
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = (
        rules.filter("host is not null and verdict in ('allow', 'block')")
        .select(F.translate("host", capitals, capitals.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    rules = stored(rules, "url-rules")
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    work, kept = packed(frame, ADDED, url=F.col(quoted(url_col)).cast("string"))
    if n <= trie_rules and size <= trie_bytes:
        trie = spark.sparkContext.broadcast(build_trie(tuple(r) for r in rules.collect()))
        found = work.select("row", _judge(trie, default)("url").alias("found"))
    else:
        found = _joined(work, rules, default)
    return found.select(*kept, *[F.col(f"found.{c}") for c in ADDED])
