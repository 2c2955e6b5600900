"""URL rules against a plain scan over all rules, in both plans."""

import itertools
import random

import pytest

from tallyhouse.llm import url_rules

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b.com", "/", "block"), ("b.com", "/x/y", "allow"),
    ("b.com", "/x/", "block"), ("B.com", "", "allow"), ("net", "/twice", "allow"), ("net", "/twice", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "://", "http://example.org", "https://EXAMPLE.org/", "http://example.org/es/1",
    "http://m.example.org/es/", "http://example.org/es", "http://example.org/en/1", "http://example.org/en/12/x",
    "http://example.org/en/2/1", "http://badexample.org/es/x", "http://x.com/de/?q=/fr/", "http://x.com?/de/", "http://com/fr/#/de/",
    "ftp://a.b.com/x/yz", "http://c.a.b.com/x/", "http://b.com/x/yonder", "http://b.com/x/z", "http://b.com", "http://x.b.com#top",
    "a://b://c.org/", "http://user@x.org:80/", "http://x.org:80/", "http://.org/", "http://x..org/", "http://net/twice/", "http://x.org/a\nb",
    "http://ÄÖ.org/ß", "http://é.com/de/" + "long/" * 5000, "http://example.org/ rests/ paths", "HTTP://X.ORG/En/1",
]


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[cut:]))
    fits = [
        (len(h) + len(p), len(h), v, h + p) for h, p, v in ((h.lower(), p, v) for h, p, v in rules)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("limit", [url_rules.TRIE_RULES, 0], ids=["trie", "join"])
def test_every_url_like_a_plain_scan(spark, limit):
    rng = random.Random(7)
    labels, segments = ["org", "com", "a", "b", "example"], ["", "en", "e", "1", "12", "fr", "x"]

    def host():
        return ".".join(rng.choices(labels, k=rng.randint(1, 3)))

    def path():
        return "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3)))

    rules = RULES + [(host(), path()[: rng.randint(0, 6)], rng.choice(["allow", "block"])) for _ in range(80)]
    urls = URLS + [f"http://{host()}{path()}{rng.choice(['', '/', '?q', '#t'])}" for _ in range(600)]
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("org", "/", None)], "host string, path string, verdict string")
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(frame, "url", table, trie_rules=limit).collect()}
    assert len(got) == 2 * len(urls)
    for i, url in enumerate(urls * 2):
        assert got[i] == brute(url, rules), url


@pytest.mark.parametrize("limit", [url_rules.TRIE_RULES, 0], ids=["trie", "join"])
def test_odd_tables(spark, limit):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    clash = spark.createDataFrame(
        [("x", "y", "z", 1, 2, "http://a.org/", 3, None)] * 2, "Host string, PATH string, rule string, row int, found int, url string, length int, verdict int"
    )
    found = url_rules.judge_urls(clash, "url", rules, trie_rules=limit)
    assert found.columns == ["row", "found", "url", "length", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in found.collect()] == [(1, 2, "http://a.org/", 3, "a.org", "/", "org/", "allow")] * 2
    assert url_rules.judge_urls(clash.limit(0), "url", rules, trie_rules=limit).count() == 0
    none = url_rules.judge_urls(clash, "url", rules.limit(0), default="block", trie_rules=limit).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}
    only = url_rules.judge_urls(clash.select(clash["url"].alias("host")), "host", rules, trie_rules=limit)
    assert only.columns == list(url_rules.ADDED) and {r.host for r in only.collect()} == {"a.org"}


def test_the_trie_is_broadcast_and_urls_do_not_move(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    frame = spark.createDataFrame([(u,) for u in URLS], "url string")
    plan = url_rules.judge_urls(frame, "url", rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
