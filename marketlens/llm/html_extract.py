"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens: runs of words and tags, each of a kind (words in a
link, in a boilerplate element, in an article, beside one, ...; a tag by its name). A kind's
weight is the log-odds of being inside against outside the content, learned from
labelled pages (`LABELLED`); a tag's is never over TAG, so words of content score positive and tags
negative. A linear scan of prefix sums finds the contiguous run of
the highest score, which is the region of the main text; of the text blocks that it touches those are
kept whose own words score positive, so boilerplate within the region goes by its weight. Words of
an element inside the region that names itself no part of it (an advert, a form, comments) don't
end the region, as what comes behind them belongs to the article.

An element is boilerplate by its tag, by attributes that hide it, or by a name (class, id, role,
aria-label) of which every part between hyphens is a word of MARKS or a plain word of LAYOUT, and one of MARKS.

Tags are read by hand, in time linear in the page's length.

Defined cases: null, empty or word-less html gives an empty text; a page cut off
in an element, a comment or a tag ends there; a quote that is not closed is part of its attribute; a head that
is not closed ends where the body's words or elements begin; unknown tags count as one kind; character references
are decoded in text; scripts, styles, comments and other raw elements hold no
words; an article inside boilerplate counts only if the page has none outside;
repeated rows are extracted each; other columns are kept by the caller.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role.
RAW = "script style noscript template textarea title iframe noembed noframes xmp".split()
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
BOILERPLATE = "nav footer aside form menu dialog button search fieldset select svg object canvas audio video".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that are closed by a sibling of their kind.
SIBLINGS = "p li td th tr dt dd option".split()
#: Words in class, id, role or aria-label that mark an element as no part of the article.
MARKS = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation navigator menu menus breadcrumb breadcrumbs pager pagination toolbar topbar "
    "footer foot copyright masthead sidebar side rail aside widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form "
    "comment comments commentlist reply replies respond discussion disqus reviews "
    "share sharing social follow related recommended recommendation recommendations trending popular tags taglist skip hidden "
    "complementary contentinfo dialog"
).split()
#: Words that say how an element is laid out, and nothing of what it holds.
LAYOUT = "area bar block body bottom box button buttons col column container content group holder icons inner item items left link links list main outer page panel primary right row secondary section site slot top unit wrap wrapper global posts articles stories text us by and the".split()

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
PART = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_raw, _blocks, _void, _marks, _layout, _boilerplate, _siblings = set(RAW), set(BLOCKS), set(VOID), set(MARKS), set(LAYOUT), set(BOILERPLATE), set(SIBLINGS)
WORDS = ("free", "region", "link", "bad", "beside", "inset")
#: The highest weight of a tag.
TAG = -0.05


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, where the tag ends) of a tag whose name ends at `at`; the end is -1 in a page that is cut off."""
    found: dict[str, str] = {}
    close = page.find(">", at)
    if close < 0:
        return found, -1
    if close == at:
        return found, close + 1
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            break
        found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        at = m.end()
    close = page.find(">", at)
    return found, close + 1 if close >= 0 else -1


def named(value: str) -> bool:
    """A class, id, role or label that marks boilerplate."""
    for token in value.lower().split():
        parts = PART.findall(token)
        if not _marks.isdisjoint(parts) and all(x in _marks or x in _layout for x in parts):
            return True
    return False


def marked(found: dict[str, str]) -> tuple[bool, bool]:
    """(boilerplate, main region), by an element's attributes."""
    bad = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if "style" in found:
        style = "".join(found["style"].lower().split())
        bad |= "display:none" in style or "visibility:hidden" in style
    bad = bad or any(named(found[c]) for c in ("class", "id", "role", "aria-label") if c in found)
    return bad, found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() == "main"


def tokens(page: str) -> list[tuple[str, int, str, int, int]]:
    """(kind, count, text, block, place in the page) in page order: a tag counts 1, a run of text its words."""
    found: list[list] = []
    stack: list[tuple[str, int, int, int]] = []  # name, and the state before it: boilerplate, region, region in boilerplate
    opened: Counter[str] = Counter()
    block, bad, region, doubt, link, breaks = 0, 0, 0, 0, 0, 0

    def text(piece: str, place: int) -> None:
        nonlocal breaks
        if "&" in piece:
            piece = entities.unescape(piece)
        if n := len(piece.split()):
            kind = ("inset" if region else "doubt" if doubt else "bad") if bad else "region" if region else "link" if link else "free"
            found.append([kind, n, piece, block, place])
            breaks = 0
        elif piece and found and found[-1][3] == block and found[-1][2]:
            found[-1][2] += piece

    def close(name: str) -> None:
        nonlocal bad, region, doubt
        while True:
            top, bad, region, doubt = stack.pop()
            opened[top] -= 1
            if top == name:
                return

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        while 0 <= lt < end - 1 and not (page[lt + 1].isascii() and (page[lt + 1].isalpha() or page[lt + 1] in "/!?")):
            lt = page.find("<", lt + 1)  # a sign, not a tag
        if lt < 0 or lt == end - 1:
            text(page[at:], at)
            break
        if lt > at:
            text(page[at:lt], at)
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        closing = page[lt + 1] == "/"
        m = TAG_NAME.match(page, lt + 1 + closing)
        if not m:
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        name = m[0].lower()
        attrs, at = attributes(page, m.end())
        if at < 0:
            break
        if name in _raw and not closing:
            if name in ("textarea", "title"):
                block += 1
            if page[at - 2] != "/" or name in ("script", "style", "title", "textarea"):
                stop = RAW_END[name].search(page, at)
                at = stop.start() if stop else end
            continue
        if name == "a":
            link = 0 if closing else 1
        if name == "br":
            breaks += 1
            block += breaks == 2
            if found and found[-1][3] == block and found[-1][2]:
                found[-1][2] += " "
        elif name in _blocks:
            block += 1
            link = 0 if closing else link  # a link that isn't closed ends with its block
        if closing:
            if opened[name]:
                close(name)
        elif name not in _void and page[at - 2] != "/":
            if name in _siblings and stack and stack[-1][0] == name:
                close(name)
            wrong, main = marked(attrs)
            main |= name in ("article", "main")
            wrong = (wrong and name not in ("html", "body", "main")) or name in _boilerplate or (name == "header" and not region)
            stack.append((name, bad, region, doubt))
            opened[name] += 1
            if main and not wrong and not region:
                if name == "main" or not bad:  # a page has one main element, and what is around it can't mark it
                    bad, region = 0, 1
                else:
                    doubt = 1
            bad += wrong
        found.append([("/" if closing else "") + (name if name in _blocks or name in ("a", "b", "i", "br", "img", "span") else "other"), 1, "", block, lt])
    kinds = {x[0] for x in found}
    if "region" in kinds or "doubt" in kinds:
        # a page that names its article says that the rest is none
        as_region = "region" if "region" in kinds else "doubt"
        for x in found:
            if x[2]:
                x[0] = "region" if x[0] == as_region else "beside" if x[0] in ("free", "link") else "bad" if x[0] == "doubt" else x[0]
    return [tuple(x) for x in found]


# Labelled pages: html with the content between [[ and ]].
LABELLED = [
    "<html><head><title>Site - News</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><div class='ad'>Buy now and save a lot</div><article>[[<h1>The harbour reopens</h1><p>The old harbour opened again on Monday after two years of work on its walls and its gates.</p><p>Ships came in at noon, and a small crowd stood on the pier to greet the crews.</p>]]</article><footer>Copyright the site, all rights reserved</footer></body></html>",
    "<html><body><div id='header'><a href='/'>Home</a> <a href='/a'>About us</a> <a href='/c'>Contact</a></div><div class='sidebar'><ul><li><a href='1'>Latest posts</a></li><li><a href='2'>Archive</a></li></ul></div><div class='content'>[[<h2>How bread rises</h2><p>Yeast eats the sugar in the dough and gives off a gas, which the gluten holds in small bubbles.</p><p>Warm rooms speed this up, and cold ones slow it down, so a baker watches the dough and not the clock.</p><ul><li>Use warm water and wait for an hour.</li><li>Fold the dough twice before it is shaped.</li></ul>]]</div><div class='comments'><p>Great recipe, thank you for this</p><p>Mine did not rise at all</p></div><div id='footer'>Terms and privacy</div></body></html>",
    "<html><body><table><tr><td><a href='a'>Index</a></td><td><a href='b'>Help</a></td><td><a href='c'>Login</a></td></tr></table><div>[[<p>A long letter came from the coast in the spring, and nobody in the house could read the hand it was written in.</p><p>They took it to the teacher, who read it aloud twice and then was silent for a while.</p>]]</div><form><label>Search the site</label><input name='q'><button>Go</button></form><div><a href='x'>Next</a> <a href='y'>Previous</a></div></body></html>",
    "<html><body><div class='cookie-notice'>We use cookies to improve your visit</div><main>[[<p>The committee met for the third time this week and agreed on most of the plan for the new line.</p><blockquote>It is a start, said the chair, and a good one.</blockquote><p>Work begins in the autumn if the money is found.</p>]]</main><aside><h3>Related</h3><a href='1'>Old line closes</a><a href='2'>New trains</a></aside></body></html>",
    "<html><body><div><a href='1'>World</a> <a href='2'>Trade</a> <a href='3'>Sport</a> <a href='4'>Arts</a></div><div><a href='5'>Five things to know</a></div><div>[[<p>The river froze in the second week of January, and by the third the ferries had stopped.</p><p>People walked across with their shopping, as <a href='6'>they had</a> in the winters before the bridge.</p>]]</div><div><ul><li><a href='7'>More from the town</a></li><li><a href='8'>Weather maps</a></li><li><a href='9'>Letters</a></li></ul></div></body></html>",
    "<html><body><div>Skip to the text</div><article>[[<h1>A short walk</h1><p>From the station, take the path along the canal until the second lock.</p>]]</article><div>You may also like these stories from our partners</div><div>Sign up and never miss a walk</div></body></html>",
]


def train(pages: list[str] = LABELLED, smooth: float = 1.0) -> dict[str, float]:
    """Log-odds of each kind: inside the labelled content against outside; of a tag at most TAG. `other` is for kinds that no page has."""
    inside, outside = Counter(), Counter()
    for page in pages:
        begin, end = page.index("[["), page.index("]]") - 2
        for kind, n, _, _, place in tokens(page.replace("[[", "").replace("]]", "")):
            (inside if begin <= place < end else outside)[kind] += n
    names = set(inside) | set(outside) | set(WORDS)
    a, b = sum(inside.values()) + smooth * len(names), sum(outside.values()) + smooth * len(names)
    weights = {k: math.log((inside[k] + smooth) / a) - math.log((outside[k] + smooth) / b) for k in names}
    return {k: w if k in WORDS and k != "inset" else min(w, TAG) for k, w in weights.items()} | {"other": TAG}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum, the first and longest of equals; (0, 0) if none is positive."""
    best, found, total, low, at = 0.0, (0, 0), 0.0, 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total < low:
            low, at = total, i + 1
        elif total - low > best or (total - low == best and found[0] == at and best > 0):
            best, found = total - low, (at, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    seq = tokens(page)
    other = weights["other"]
    scores = [weights.get(kind, other) * n for kind, n, *_ in seq]
    # in a named article, tags and what is set into it part nothing
    within = {block for kind, _, text, block, _ in seq if text and kind == "region"}
    span = (min(within), max(within)) if within else (1, 0)
    start, end = best_run([max(x, TAG) if kind == "inset" or (not text and span[0] <= block <= span[1]) else x for x, (kind, _, text, block, _) in zip(scores, seq)])
    parts: dict[int, list[str]] = {}
    worth: Counter[int] = Counter()
    for i in range(start, end):
        worth[seq[i][3]] += scores[i] if seq[i][2] else 0.0
    for i, (kind, _, text, block, _) in enumerate(seq):
        if text and worth[block] > 0 and (weights.get(kind, other) > 0 or kind == "link"):
            parts.setdefault(block, []).append(text)
    return "\n".join(x for block in sorted(parts) if (x := " ".join("".join(parts[block]).split())))


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    learned = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(x, learned) for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
