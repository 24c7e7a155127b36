import html
import re

import pytest

from marketlens.llm import html_extract
from marketlens.llm.html_extract import LABELLED, best_run, extract, train

WEIGHTS = train()


def bare(part):
    blocks = re.split(r"</?(?:p|h\d|ul|li|blockquote|div)\b[^>]*>", part)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)


@pytest.mark.parametrize("page", LABELLED)
def test_labelled_pages(page):
    assert extract(page.replace("[[", "").replace("]]", ""), WEIGHTS) == bare(page.split("[[")[1].split("]]")[0])


def test_best_run_against_all_runs():
    import random

    rnd = random.Random(0)
    for _ in range(200):
        x = [rnd.choice([-3, -1, 0, 1, 2]) for _ in range(rnd.randrange(12))]
        a, b = best_run(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


BODY = "<p>The first paragraph of the story has a fair number of words in it, &eacute; &amp; &#8212; too.</p><p>The second one\n  goes on for a while, as such things tend to do.</p>"
TEXT = "The first paragraph of the story has a fair number of words in it, é & — too.\nThe second one goes on for a while, as such things tend to do."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=/>Home</a></nav><main>{BODY}</main><footer>All rights reserved by us</footer>",
        f"<header><h1>Site name</h1></header><article>{BODY}<section class='comments'><p>I do not agree with any of this at all, sorry to say.</p></section></article>",
        f"<article>{BODY}<aside>Read more of this and of that and of the other</aside><form>Your name and mail <input></form></article>",
        f"<div class=sidebar>Archive of the month and of all the months before</div><div role='main'>{BODY}</div><div id=cookie-notice>We use cookies here</div>",
        f"<script>var a='<p>not text at all</p>'</script><style>p{{x:1}}</style><!-- <p>a comment here</p> --><article>{BODY}",
        f"<article><div class='ad'>Buy one and get the other one for free today</div>{BODY}<div style='display: none'>hidden words here</div></article>",
        f"<div class='menu'><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div>{BODY}</div><div class='footer'>Contact and terms</div>",
    ],
)
def test_boilerplate_goes(page):
    assert extract(page, WEIGHTS) == TEXT


LINKS = "<ul>" + "<li><a href='x'>Some page</a></li>" * 8 + "</ul>"
UNNAMED = f"<div>Welcome to this site of ours</div>{LINKS}<div>{BODY}</div>{LINKS}<div>All of this is ours to keep</div>"


def test_the_scan_and_the_weights_decide(monkeypatch):
    assert extract(UNNAMED, WEIGHTS) == TEXT
    flat = {k: 1.0 if k in html_extract.WORDS else -0.5 for k in WEIGHTS}
    assert extract(UNNAMED, flat) != TEXT
    monkeypatch.setattr(html_extract, "best_run", lambda scores: (0, len(scores)))
    assert extract(UNNAMED, WEIGHTS) != TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>A title</title><body><p>{BODY[3:]}",
        f"<div class='container has-sidebar'><article>{BODY}</article></div>",
        f"<div class='sidebar'><main>{BODY}</main></div>",
        f"<div class='sidebar'><article>{BODY}</article></div><p>beside",
        f"<article><section class='long-form'>{BODY}</section></article>",
        f"<article>{BODY.replace('<p>', '<p class=follow-up id=tags-explained aria-hidden=false>')}</article>",
        f"<article>{BODY}<section class='comment-list'><article><p>No, I say</p></article></section></article>",
        f"<article title='a > b'>{BODY}<svg><text>drawn</text></svg></article>",
        f"<ul><li><a href=1>Home</li></ul><div>{BODY}</div>",
    ],
)
def test_regions(page):
    assert extract(page, WEIGHTS) == TEXT


def test_formulas_are_text():
    assert extract("<article><p>So <math><mi>x</mi> = <mn>2</mn></math> holds.</p></article>", WEIGHTS) == "So x = 2 holds."


@pytest.mark.parametrize("part", ['"x" ', "a='", "a=\"b' ", "<", "<p ", "</", "<!--", "<script>", "&#", "<a href="])
def test_time_is_linear(part):
    import time

    began = time.perf_counter()
    extract("<p " + part * 100_000, WEIGHTS)
    extract("<article><p>word</p>" + part * 100_000, WEIGHTS)
    assert time.perf_counter() - began < 5


def test_odd_pages():
    for page in (None, "", " ", "<html></html>", "<script>x", "<!-- ", "<p", "<a href='"):
        assert extract(page, WEIGHTS) == ""
    assert extract("1 < 2 and words", WEIGHTS) == "1 < 2 and words"
    assert extract("<p>one<p>two<br>three<br><br>four", WEIGHTS) == "one\ntwo three\nfour"
    long = "<article>" + "<p>word and word</p>" * 20_000
    assert extract(long, WEIGHTS) == "\n".join(["word and word"] * 20_000)


def test_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert len(rows) == pages.count()
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts) if x)
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want) and rows[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>a b", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.main_text(odd).collect()) == [(0, "", 0), (1, "", 0), (1, "a b", 3)]
    assert html_extract.main_text(pages.limit(0)).collect() == []
