import html
import re

import numpy as np
import pytest

from tallyhouse.llm import html_text
from tallyhouse.llm.queries import op9_suffix_array_html


def main_text(page):
    return " ".join(t for kind, t in html_text.blocks(page) if kind == html_text.MAIN)


def test_articles_of_all_pages(spark, folder):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op9_suffix_array_html(spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        want = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r["text"] == " ".join(html.unescape(want).split())
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_menus_adverts_and_footers_are_found_on_other_pages(spark, folder):
    rows = html_text.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert sum(r["boilerplate_tokens"] > 5 for r in rows) >= 5


def test_markup():
    page = """<!DOCTYPE html><head><title>t</title><meta x></head><body class="home"><header>top</header>
    <nav class=main><a href="/a>b">menu</a></nav><div class="cookie-notice">we use</div>
    <article class="post"><header><h1>The  <i>ti</i>tle</h1></header><p>a&amp;b &lt;i&gt; caf&eacute;&#x21;<p>x<br>y 1 < 2
    <!-- <p>no --><script>if (a < b) "</p>"</script><style>p{}</style><div class="ad">buy</div><aside>side</aside>
    <form>mail <input></form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><div id="comments"><article>me too</article></div>
    last&nbsp;word</article><footer>&copy; us</footer></body>"""
    assert main_text(page) == "The title a&b <i> café! x y 1 < 2 one two c1 c2 last word"


def test_odd_markup():
    assert html_text.blocks("") == [] and html_text.blocks("<p") == []
    assert main_text("<main>a<p class=ad>b<p>c</main>") == "a c"
    assert main_text("<article>open <b>bold <p>next </i> end") == "open bold next end"
    assert main_text("<nav>unclosed <article>text</article>") == "text"
    assert main_text("<article>a &amp;lt; b</article>") == "a &lt; b"
    assert main_text("<article><script>x") == ""


@pytest.mark.parametrize(
    "inside, kept",
    [
        ('<h2 id="search-algorithms">x</h2>', True), ('<section id="related-work"><p>x</section>', True), ('<p id="share-prices-fell">x', True),
        ('<div class="header-image">x</div>', True), ('<h2 id="menu">x</h2>', True), ('<section id="comments-on-the-law">x</section>', True),
        ('<p id="notice">x', True), ('<div class="advance">x</div>', True), ('<div class="navigation-satellites">x</div>', True),
        ('<h3 class="banner">x</h3>', True), ('<div class="header"><h1>x</h1></div>', True), ('<div class="adapter shared">x</div>', True),
        ('<div class="teaser">x</div>', False), ('<p class="read-more">x', False), ('<div class="advertBox">x</div>', False),
        ('<div class="social_share-buttons">x</div>', False), ('<div id="comments">x</div>', False), ('<div id="ad3">x</div>', False),
        ('<ul class="leftSideBar">x</ul>', False), ('<div class="post cookie-consent-banner">x</div>', False), ('<p class="ADS">x', False),
    ],
)
def test_names_label_as_a_whole(inside, kept):
    assert main_text(f"<article>a {inside}</article>") == ("a x" if kept else "a")


def test_ids_of_headings_and_frames_outside_of_main_text():
    found = html_text.blocks('<h2 id="menu">a</h2><section id="sidebar">b</section><div id="pageFooter">c</div><p class="main-content">d')
    assert [k for k, _ in found] == [html_text.OPEN, html_text.LABELLED, html_text.LABELLED, html_text.OPEN]


def brute_covered(tokens, pages, run):
    out = np.zeros(len(tokens), dtype=bool)
    for a in range(len(tokens) - run + 1):
        for b in range(len(tokens) - run + 1):
            one = pages[a] == pages[a + run - 1] and pages[b] == pages[b + run - 1] and pages[a] != pages[b]
            if one and (tokens[a : a + run] == tokens[b : b + run]).all():
                out[a : a + run] = True
    return out


def test_suffix_array_marks_runs_of_other_pages():
    rng = np.random.default_rng(1)
    for run in (1, 2, 3, 4, 5, 7):
        for _ in range(6):
            sizes = rng.integers(0, 25, 6)
            tokens = rng.integers(0, 3, sizes.sum())
            pages = np.repeat(np.arange(6), sizes)
            assert (html_text.repeated_places(tokens, pages, run) == brute_covered(tokens, pages, run)).all()


def test_pages_without_article_keep_what_no_other_page_has(spark):
    pages = [
        (i, f"http://h.example/{i}", f"<div>Home of all the best news</div><p>story {i} tells {i * 7} things by {i + 1} people</p>"
         "<div>Call us any time you like</div><div class=share>only {i} here</div>", "x")
        for i in range(6)
    ]
    pages += [(9, "http://h.example/9", pages[0][2], "x"), (10, None, None, "x"), (11, "odd", "", "x"), (12, "http://one.example/", "<p>alone <b>here</b></p>", "x")]
    frame = spark.createDataFrame(pages + [pages[1]], "page_id bigint, url string, html string, text string")
    by = {}
    for r in html_text.extract(frame).collect():
        by.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert by[3] == [("story 3 tells 21 things by 4 people", 35)]
    assert by[10] == [("", 0)] and by[11] == [("", 0)] and by[12] == [("alone here", 10)]
    # Copies of a whole page keep their text.
    assert len(by[1]) == 2 and all("story 1 tells" in t for t, _ in by[1]) and "story 0 tells" in by[9][0][0]
    assert html_text.extract(frame.limit(0)).collect() == []


def test_phrases_in_running_text_stay(spark):
    phrases = ["as the old saying has it", "on the other hand we know", "in the end of the day"]
    pages, want = [], {}
    for i in range(12):
        text = " ".join(f"a{i}x{k} {phrases[(i + k) % 3]} b{i}y{k}" for k in range(5))
        want[i] = text
        pages.append((i, f"http://h.example/{i}", f"<div>{text}</div><div>Subscribe to all of our letters</div>"))
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()} == want


def test_long_runs_inside_blocks_go(spark):
    long = " ".join(f"legal{k}" for k in range(20))
    pages = [(i, f"http://h.example/{i}", f"<div>own story of page{i} and nothing else <b>{long}</b> page{i}</div>") for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in html_text.extract(frame).collect()}
    assert rows[2]["text"] == "own story of page2 page2" and rows[2]["boilerplate_tokens"] == 23


def test_hot_host_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(html_text, "HOST_BLOCK_PAGES", 10)
    pages = [(i, f"http://big.example/{i}", f"<nav>the same old menu</nav><article>page {i}</article>") for i in range(95)]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"page {i}" for i in range(95)}
    assert sum(r["boilerplate_tokens"] == 4 for r in rows) > 90


def test_parts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PART_BYTES", 2_000)
    pages = [(i, f"http://big.example/{i}", f"<nav>the same old menu</nav><article>page {i} {'long ' * 200}</article>") for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = html_text.extract(frame).collect()
    assert {r["page_id"]: len(r["text"]) for r in rows} == {i: len(f"page {i} {'long ' * 200}".strip()) for i in range(20)}


def test_boilerplate_of_few_pages_of_a_hot_host_goes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "HOST_BLOCK_PAGES", 5)
    legal = " ".join(f"legal{k}" for k in range(20))
    pages = [
        (i, f"http://big.example/{i}", f"<p>story {i} has five own words</p>" + (f"<div>Of one section of ours</div><p>see {i} {legal}</p>" if i % 25 == 0 else ""))
        for i in range(100)
    ]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {
        i: f"story {i} has five own words" + (f" see {i}" if i % 25 == 0 else "") for i in range(100)
    }


def test_short_story_beside_a_long_menu(spark):
    menu = "<div>" + " ".join(f"entry{k}" for k in range(150)) + "</div>"
    pages = [(i, f"http://h.example/{i}", f"{menu}<p>the short story of page {i} has ten words</p>") for i in range(5)]
    pages += [(7, "http://h.example/7", menu), (8, "http://h.example/8", pages[2][2])]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    want = {i: f"the short story of page {i} has ten words" for i in range(5)}
    assert {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()} == want | {7: "", 8: want[2]}
