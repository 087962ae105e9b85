"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand and tags score below zero,
both with weights fitted on labelled pages (``html_labels``): log odds of lying inside the main
text. One linear scan finds the contiguous region of the highest sum. Inside it, text whose own
words score below zero (an advert between two paragraphs, say) is left out.

Defined results: null or empty html gives an empty text; so does a page without any word that scores
above zero; a page that breaks off keeps what was read; repeated rows give a row each; a null
page_id or url is carried; an empty table gives no rows. Work is linear in the page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .html_labels import PAGES

# Element and attribute vocabulary of HTML.
SKIPPED = frozenset("script style noscript template iframe svg math head title select option button textarea canvas object audio video map datalist".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("br td th".split())
CONTAINERS = frozenset("article aside body center details dialog dl div fieldset figure footer form header main menu nav ol section table ul blockquote label".split())
PLACES = {"nav": "nav", "menu": "nav", "aside": "aside", "footer": "foot", "header": "head", "form": "form", "fieldset": "form", "label": "form", "dialog": "notice", "article": "main", "main": "main"}
ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "head", "contentinfo": "foot", "complementary": "aside", "search": "form", "form": "form", "main": "main", "article": "main", "dialog": "notice", "alert": "notice", "alertdialog": "notice"}
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip toolbar tabs",
    "head": "header masthead topbar banner site-header logo",
    "foot": "footer colophon copyright imprint legal",
    "aside": "sidebar side aside widget related recommended trending popular promo teaser more share sharing social tags tag author-box byline-links",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer toast",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors dfp outbrain taboola",
    "comments": "comment comments commentlist reply replies respond disqus discussion responses",
    "form": "form login search searchbox register contact-form",
    "main": "article content post entry story body main text maincontent article-body post-content",
}
_HINT = {w: k for k, words in reversed(HINTS.items()) for w in words.split()}
_ATTR = re.compile(r"""\b(class|id|role|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|\b(hidden|aria-hidden\s*=\s*["']?true)""", re.I)
#: A tag up to its end: plain characters, and quoted values right after their =. Where a quote never closes
#: there is no later one of its kind either, so each kind is looked for in vain once.
_INSIDE = re.compile(r"""(?:[^>="']+|="[^"]*"|='[^']*'|[="'])*+""")
_NAME = re.compile(r"/?\s*([a-zA-Z][a-zA-Z0-9:-]*)")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("open" or "close", element, attributes) in page order.

    Comments, declarations and the content of script-like elements are passed over; each character
    is looked at a bounded number of times whatever the page.
    """
    at, n, text = 0, len(page), 0
    lower = None
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = page[lt + 1]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = n if end < 0 else end + 3
        elif c in "!?":
            end = page.find(">", lt)
            end = n if end < 0 else end + 1
        elif m := _NAME.match(page, lt + 1):
            end = _INSIDE.match(page, m.end()).end() + 1  # past the > outside quotes
            end = min(end, n)
        else:
            at = lt + 1
            continue
        if lt > text:
            yield "text", page[text:lt], ""
        if c not in "!?":
            name = m[1].lower()
            kind = "close" if c == "/" else "open"
            yield kind, name, page[m.end() : end - 1] if kind == "open" else ""
            if kind == "open" and name in RAW and page[end - 2 : end - 1] != "/":
                lower = page.lower() if lower is None else lower
                if len(lower) != n:  # a letter whose small form is longer
                    lower = page
                stop = lower.find("</" + name, end)
                end = n if stop < 0 else stop
        at = text = end
    if text < n:
        yield "text", page[text:], ""


@cache
def _named(word: str) -> str:
    """What one class or id says. A compound whose last part names content says nothing against it, whatever
    its other parts say."""
    if word in _HINT:
        return _HINT[word]
    parts = [_HINT.get(w, "") for w in re.split(r"[^a-z0-9]+", word) if w]
    said = [x for x in parts if x]
    against = [x for x in said if x != "main"]
    if not against:
        return said[0] if said else ""
    return "" if parts[-1] == "main" else against[0]


def _place(name: str, attrs: str) -> str:
    """What an element's name, role, class and id say about its content; empty if nothing."""
    found = PLACES.get(name, "")
    if not attrs:
        return found
    said = []
    for key, value, hidden in _ATTR.findall(attrs):
        if hidden:
            return "notice"
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            said.append(ROLES.get(value, ""))
        elif key.lower() == "style":
            said.append("notice" if re.search(r"display\s*:\s*none", value) else "")
        else:
            said += [_named(w) for w in value.split()]
    said = [x for x in said if x]
    against = [x for x in said if x != "main"]
    return against[0] if against else found if found and found != "main" else said[0] if said else found


def units(page: str) -> list[tuple[str, str, str, int]]:
    """("word", text, context, block) and ("tag", element, "", block) in page order."""
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str]] = []
    inner: list[str] = []  # containers opened inside what is skipped
    opened, within = Counter(), Counter()  # how many of a name are on either list, so that neither is searched
    place, block, skip, links, kind = "", 0, "", 0, "div"
    for what, value, attrs in tokens(page):
        if what == "text":
            if not skip and (value := html.unescape(value)):
                out.append(("word", value, f"{place or 'plain'}{'/link' if links else ''}/{kind}", block))
            continue
        if skip and skip != "head" and what == "close" and value != skip and value in CONTAINERS:
            # an element that is never closed ends with what it stands in
            if within[value]:
                while within[value] and (last := inner.pop()) != value:
                    within[last] -= 1
                within[value] -= 1
            elif opened[value]:
                skip = ""
        elif skip and what == "open" and value in CONTAINERS:
            inner.append(value)
            within[value] += 1
        if value in SKIPPED:
            if what == "open" and not skip and value not in VOID:
                skip, inner, within = value, [], Counter()
            elif what == "close" and skip == value:
                skip = ""
            if skip == "head" or value == "head":
                skip = value if what == "open" else ""
            continue
        if skip == "head" and value == "body":
            skip = ""
        if skip:
            continue
        if value == "a":
            links = 1 if what == "open" else 0
        elif value in BLOCKS:
            block, links = block + 1, 0
            kind = "p" if value in ("p", "blockquote", "pre", "dd") else "h" if value[0] == "h" and len(value) == 2 else "li" if value in ("li", "tr") else "div"
            if what == "close":
                kind = "div"
        elif value in SPACED:
            out.append(("word", " ", "", block))
        if value in CONTAINERS:
            if what == "open":
                own = _place(value, attrs)
                said = "main" if place == "main" and own == "head" else own  # an article's own heading
                stack.append((value, place))
                opened[value] += 1
                if not (place in ("comments", "advert", "notice") and said == "main" and value not in ("article", "main")):
                    place = said or place
            elif opened[value]:
                last = ""
                while last != value:
                    last, place = stack.pop()
                    opened[last] -= 1
        out.append(("tag", value, "", block))
    return out


@cache
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """(word weights by context, tag weights by element), fitted on the labelled pages.

    A weight is the smoothed log odds of lying inside the main text; contexts back off from place,
    link and block to place and link, to place. Tags between the first and the last word of the main
    text lie inside; their weights are capped below zero.
    """
    words, tags = (Counter(), Counter()), (Counter(), Counter())
    for page in PAGES:
        inside, at, edges = False, 0, []
        found = []
        for at, (what, value, context, _) in enumerate(units(page)):
            if what == "tag":
                found.append((value, at))
                continue
            for part in re.split(r"(\[\[|\]\])", value):
                if part in ("[[", "]]"):
                    inside = part == "[["
                    edges.append(at)
                elif n := len(part.split()):
                    place, *rest = context.split("/")
                    for key in {context, place, f"{place}/link" if "link" in rest else f"{place}/text"}:
                        words[inside][key] += n
        for value, at in found:
            tags[edges[0] < at < edges[-1]][value] += 1
    odds = lambda pair, key, a: math.log((pair[True][key] + a) / (pair[False][key] + a))
    word = {k: odds(words, k, 0.5) for k in {*words[0], *words[1]}}
    tag = {k: min(-0.2, odds(tags, k, 1.0)) for k in {*tags[0], *tags[1]}}
    return word, tag


@cache
def word_weight(context: str) -> float:
    word, _ = weights()
    place, *rest = context.split("/")
    for key in (context, f"{place}/link" if "link" in rest else f"{place}/text", place):
        if key in word:
            return word[key]
    return 0.5 if place in ("plain", "main") else -1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the greatest sum, empty where none is above zero; one pass."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str) -> str:
    """Blocks of the best region joined by line ends."""
    _, tag = weights()
    found = units(page)
    counts = [len(value.split()) if what == "word" and context else 0 for what, value, context, _ in found]
    region = best_region([n * word_weight(context) if n else tag.get(value, -0.2) if what == "tag" else 0.0 for n, (what, value, context, _) in zip(counts, found, strict=True)])
    blocks: dict[int, list[str]] = {}
    for i in range(*region):
        what, value, context, block = found[i]
        if what == "word" and (not context or word_weight(context) > 0 or not counts[i]):
            blocks.setdefault(block, []).append(value)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
