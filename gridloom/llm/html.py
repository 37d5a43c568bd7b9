"""Main text of web pages: maximum-scoring subsequence over words and tags.

A page is read as a sequence of words and tags. Tags score negative, words positive, words in
links by a weight of their own; the names (class, id) of the elements around a word are
evidence for or against it, so words among adverts or comments score negative. One linear
scan finds the contiguous region of the highest score; the main text is that region,
completed to the article (or else main, or else the smallest box) element that holds all of
it, without the words whose own score is not positive. Elements that HTML itself says are not the article
(scripts, styles, menus, forms, footers, by tag or role, and hidden ones) count as tags only.

All weights come from labelled pages, a bounded sample (`SAMPLE` pages, of each at most
`SAMPLE_CHARS` characters around the mark, in the order of a hash) whose `<article>` or
`<main>` marks the answer: the evidence of a name is its log odds of standing around words of
the article, added to what is assumed before; the weights of tags and of words in links are
those under which the scan's regions, without the evidence of the mark itself, agree best
with the labels. Style: Arrow batches, no shuffle of pages; time is linear in a page, however deep it is nested.

Edge cases: a null or empty page, and one without words, has an empty text; unclosed and
stray tags are repaired as browsers do; pages of any length are read whole; repeated rows
are treated one by one; without labelled pages default weights hold; further columns are
ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import first_by_hash, slices

SAMPLE, SAMPLE_CHARS = 150, 200_000
#: Tried weights of a tag and of a word in a link, of equal ones the first; a word outside links counts 1.
TAG_WEIGHTS, LINK_WEIGHTS = (-1.0, -0.5, -2.0, -4.0, -8.0), (-1.0, 0.0, 1.0, -3.0)

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Element names by what a parser does with them.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "canvas", "audio", "video"}
BOXES = {"div", "section", "td", "center", "table", "blockquote", "article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: Words of class and id names that mark what is not the article, and the evidence they are before anything is learned.
NAMES = {
    -8.0: {
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion",
        "sidebar", "navbar", "breadcrumb", "breadcrumbs", "masthead", "comment", "comments", "disqus", "respond", "replies",
        "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
        "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "paywall",
    },
    -4.0: {"banner", "menu", "nav", "navigation", "header", "footer", "notice", "notification", "alert", "widget", "toolbar", "copyright", "disclaimer", "skip"},
    2.0: {"article", "articlebody", "post", "entry", "story", "content", "main", "maincontent"},
}
PRIOR = {word: weight for weight, words in NAMES.items() for word in words}
#: Evidence is held between these; the article element is evidence as well.
LEAST, MOST, ARTICLE = -8.0, 4.0, 2.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Weights:
    tag: float = -1.0
    link: float = -1.0
    names: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    article: float = ARTICLE


@dataclass
class Page:
    """Blocks in page order, and the elements around them."""

    texts: list[str] = field(default_factory=list)
    #: For each block the tags, and the score of words that are left out, before it, and its plain and linked words' score.
    runs: list[tuple[int, float, float, float]] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)  # whether the block is in an article or main element
    words: list[int] = field(default_factory=list)
    around: list[tuple[int, int]] = field(default_factory=list)  # depth and number of the smallest element around it and the block before
    home: list[tuple[int, int]] = field(default_factory=list)  # depth and number of the smallest element around it
    spans: list[list[int]] = field(default_factory=list)  # by element: first block, and the one after its last
    holders: list[list[int]] = field(default_factory=list)  # by element: the outermost article, the outermost main and the smallest box around it, or itself
    tally: dict[str, list[int]] = field(default_factory=dict)  # by name: words in the article, other words


def names_of(attributes: str) -> list[list[str]]:
    """The words of each class and id name."""
    found = [(k.lower(), v.strip("\"'")) for k, v in _NAMES.findall(attributes)]
    words = [[w.lower() for w in _PARTS.findall(x)] for k, v in found if k in ("class", "id", "itemprop") for x in v.split()]
    return [w for w in words if w and w[0] not in ("has", "with", "no", "without")]


def evidence(names: list[list[str]], weights: dict[str, float]) -> float:
    """What names say: the last word of each is what it is, the others say something of it."""
    return sum(weights.get(w[-1], 0.0) + 0.5 * sum(weights.get(x, 0.0) for x in w[:-1]) for w in names)


def _never(name: str, attributes: str, in_article: bool) -> bool:
    """Whether HTML itself says that an element is not the article."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(k.lower() == "role" and v.strip("\"'").lower() in ROLES for k, v in _NAMES.findall(attributes))


def parse(html: str | None, weights: Weights | None = None) -> Page:
    """The blocks of a page without what is never content or scores negative."""
    page, html, weights = Page(), html or "", weights or Weights()
    #: Open elements: name, number, evidence in all, whether in an article; names and words counted before them.
    stack: list[tuple[str, int, float, bool, list[list[str]], int, int]] = []
    open_count: dict[str, int] = {}
    dropped_at, link, tags, lowest, left_out = -1, False, 0, 0, 0.0
    inside_words = outside_words = 0
    piece: list[str] = []
    plain = linked = 0.0
    here = 0

    def flush() -> None:
        nonlocal plain, linked, tags, piece, lowest, left_out, here
        if piece:
            text = _SPACE.sub(" ", references.unescape("".join(piece))).strip()
            if text:
                page.around.append((lowest, stack[lowest - 1][1] if lowest else -1))
                page.home.append((len(stack), stack[-1][1] if stack else -1))
                page.texts.append(text)
                page.runs.append((tags, left_out, plain, linked))
                page.marked.append(bool(stack) and stack[-1][3])
                page.words.append(here)
                tags, left_out, lowest = 0, 0.0, len(stack)
        piece, plain, linked, here = [], 0.0, 0.0, 0

    def pop() -> str:
        nonlocal dropped_at, lowest
        name, number, _, _, names, was_inside, was_outside = stack.pop()
        open_count[name] -= 1
        page.spans[number][1] = len(page.texts)
        lowest = min(lowest, len(stack))
        for word in {x for w in names for x in w}:
            counts = page.tally.setdefault(word, [0, 0])
            counts[0] += inside_words - was_inside
            counts[1] += outside_words - was_outside
        if len(stack) <= dropped_at:
            dropped_at = -1
        return name

    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        m = _TOKEN.match(html, at) if at <= last else None
        text = m[0] if m else html[at:]
        at = m.end() if m else end
        name = (m[2] or m[5] or "").lower() if m else ""
        if not name:
            if not m or text[0] != "<" or text == "<":
                if dropped_at < 0 and (n := len(text.split())):
                    value = 1 + (min(MOST, max(LEAST, stack[-1][2])) if stack else 0.0)
                    if stack and stack[-1][3]:
                        inside_words += n
                    else:
                        outside_words += n
                    if value <= 0:
                        left_out += n * value
                        piece.append(" ")
                    else:
                        piece.append(text)
                        here += n
                        plain, linked = (plain, linked + n * value) if link else (plain + n * value, linked)
                elif dropped_at < 0:
                    piece.append(text)
            continue
        tags += 1
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
                if dropped_at < 0:
                    piece.append(" ")
            continue
        if name == "a":
            link = not closing
        if name in INLINE and name != "span":
            if name == "br" and dropped_at < 0:
                piece.append(" ")
            continue
        if name != "span":
            if dropped_at < 0:
                flush()
            link = False
        if closing:
            if open_count.get(name):
                while pop() != name:
                    pass
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] in CLOSED_BY_NEXT and name != "span":  # an open p ends at any block, others at their like
            before = stack[-1][0]
            if before == "p" or before == name or (before in ("dt", "dd") and name in ("dt", "dd")) or (before in ("td", "th") and name in ("td", "th", "tr")):
                pop()
        if attributes.endswith("/") and name not in ("article", "main", "div", "p", "section"):
            continue
        said, inside = (stack[-1][2], stack[-1][3]) if stack else (0.0, False)
        names: list[list[str]] = []
        if dropped_at < 0:
            if _never(name, attributes, inside):
                if name == "span":
                    piece.append(" ")
                dropped_at = len(stack)
            elif name not in ("html", "body"):
                names = names_of(attributes) if attributes else []
                said += evidence(names, weights.names) if names else 0.0
                if name in ("article", "main"):
                    said, inside = said + weights.article, True
        stack.append((name, len(page.spans), said, inside, names, inside_words, outside_words))
        number = len(page.spans)
        holders = list(page.holders[stack[-2][1]]) if len(stack) > 1 else [-1, -1, -1]
        if name in ("article", "main") and holders[name == "main"] < 0:
            holders[name == "main"] = number
        if name in BOXES:
            holders[2] = number
        page.holders.append(holders)
        page.spans.append([len(page.texts), len(page.texts)])
        open_count[name] = open_count.get(name, 0) + 1
    if dropped_at < 0:
        flush()
    while stack:
        pop()
    return page


def best_region(runs: list[tuple[int, float, float, float]], tag: float, link: float) -> tuple[int, int]:
    """First and last block (exclusive) of the highest-scoring subsequence; tags and left out words between two blocks lie before the second."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for k, (tags, left_out, plain, linked) in enumerate(runs):
        total += tag * tags + left_out
        if total <= 0:
            total, begin = 0.0, k
        total += plain + link * linked
        if total > best:
            best, span = total, (begin, k + 1)
    return span


def main_text(html: str | None, weights: Weights | None = None) -> str:
    """The best region, completed to the element that holds it."""
    weights = weights or Weights()
    page = parse(html, weights)
    a, b = best_region(page.runs, weights.tag, weights.link)
    if a < b:
        _, around = min([page.home[a], *page.around[a + 1 : b]])
        if around >= 0 and (whole := next((h for h in page.holders[around] if h >= 0), -1)) >= 0:
            a, b = page.spans[whole]
    return "\n".join(page.texts[a:b])


def fit(pages: list[str]) -> Weights:
    """The weights from labelled pages."""
    tally: dict[str, list[int]] = {}
    for html in pages:
        for word, (inside, outside) in parse(html).tally.items():
            counts = tally.setdefault(word, [0, 0])
            counts[0] += inside
            counts[1] += outside
    odds = {w: math.log((i + 5) / (o + 5)) for w, (i, o) in tally.items()}
    names = {w: min(MOST, max(LEAST, PRIOR.get(w, 0.0) + odds.get(w, 0.0))) for w in {*PRIOR, *odds}}
    parsed = [page for html in pages if any((page := parse(html, Weights(names=names, article=0.0))).marked)]
    best, chosen = -1.0, Weights(names=names)
    for tag in TAG_WEIGHTS:
        for link in LINK_WEIGHTS:
            agree = 0.0
            for page in parsed:
                a, b = best_region(page.runs, tag, link)
                truth, words = np.array(page.marked), np.array(page.words)
                got = np.zeros(len(truth), bool)
                got[a:b] = True
                agree += 2 * (words * (got & truth)).sum() / max(1, (words * got).sum() + (words * truth).sum())
            if agree > best + 1e-9:
                best, chosen = agree, Weights(tag, link, names)
    return chosen


def labelled_pages(pages: DataFrame) -> list[str]:
    """At most SAMPLE pages with an article element, of longer ones what is around its beginning."""
    usable = pages.select("page_id", "html").where(F.lower("html").rlike("<(article|main)[ >]"))
    mark = F.regexp_instr(F.lower("html"), F.lit("<(article|main)[ >]"))
    part = F.substring("html", F.greatest(mark - SAMPLE_CHARS // 4, F.lit(1)), F.lit(SAMPLE_CHARS))
    rows = first_by_hash(usable, ["page_id", "html"], SAMPLE).select(F.when(F.length("html") <= SAMPLE_CHARS, F.col("html")).otherwise(part).alias("html"))
    return [r["html"] for r in rows.collect()]


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page with its main text."""
    weights = weights or fit(labelled_pages(pages))

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
