"""Operator 7: main text of HTML pages by two-pass block rules.

A tolerant scan splits a page into blocks at block-level tags and notes for each
its words, the characters inside links, and the region it lies in. Scripts,
styles and form controls hold no text. A region is an element that by tag,
role, class or id promises content (``article``, ``main``) or boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments); that
promise is a prior, the rules decide:

Pass 1. A block with link density above ``LINK_DENSITY`` is bad, unless it is
long running text with a content prior. A block of ``LONG_WORDS`` words or more
whose stop-word density reaches ``STOP_DENSITY`` is running text: good, or bad
under a boilerplate prior. A long block below it is bad, but undecided with a
content prior (lists, tables, names). Short blocks are undecided. The prior of
a layout region (sidebar, header, form and the like) is dropped where no running
text lies outside such regions: then the name speaks of the layout, as with a
form around the whole page.

Pass 2. An undecided block inherits the label of the nearest decided neighbours in
its own region: what both sides agree on; else the prior is the third vote, and
without one the nearer side decides. A heading takes the label of the block
after it. Where nothing in the region was decided, the prior is the label;
without a prior, the nearest decided blocks of the page, other regions
included, lend theirs.

The scan is linear: every search that can fail remembers that it failed.

Defined cases: null or empty html gives empty text; broken markup never fails
(an unclosed container ends with its parent, the "<" of an unclosed tag is
text, an unclosed comment or script goes to the end); repeated rows are
extracted each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality import STOP_WORDS

#: share of a block's characters that may be link text; words of a block that decides alone; share of stop words in running text
LINK_DENSITY, LONG_WORDS, STOP_DENSITY = 0.4, 10, 0.1

_SKIP = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button datalist head title".split())
_BOILER_TAGS = frozenset("nav footer aside menu dialog form header".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that an opening tag ends, if no other block is open inside.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Names whose text is never the article, and names of layout, whose prior can be overturned.
_HARD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription signup comment comments disqus replies respond share sharing social related recommended pagination pager copyright disclaimer hidden".split()
)
_LAYOUT_NAMES = frozenset("banner sidebar side menu nav navbar navigation masthead topbar toolbar overlay login widget legal header".split())
_HARD_TAGS = frozenset("nav footer dialog".split())
_ROLES = {"main": "content", "article": "content", "navigation": "hard", "contentinfo": "hard", "alert": "hard", "dialog": "hard", "alertdialog": "hard", "banner": "layout", "complementary": "layout", "search": "layout", "menu": "layout", "menubar": "layout", "form": "layout"}
_STOPS = frozenset(STOP_WORDS)

_NAME_AT = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_GONE = re.compile(r"display\s*+:\s*+none")
_ZEROS = re.compile(r"&#([xX]?)0{8,}")
_HUGE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{8,});?")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in _SKIP}
_BODY = re.compile(r"<body(?=[\s/>])", re.I | re.A)


def decoded(text: str) -> str:
    """Character references replaced; numbers beyond all characters become the replacement sign."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\g<1>0", text))
    return unescape(text)


def _prior(tag: str, attrs: str, inside: bool) -> str | None:
    """content, hard or layout (boilerplate), or None if the element says nothing. inside: within a content region, where headers belong to it."""
    if tag in _HARD_TAGS:
        return "hard"
    found = "content" if tag in ("article", "main") else "layout" if tag in _BOILER_TAGS and not (inside and tag == "header") else None
    if "=" not in attrs and "hidden" not in attrs.lower() or tag in ("html", "body"):
        return found
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _GONE.search(value):
            return "hard"
        if key == "role":
            found = _ROLES.get(value.strip(), found)
        elif key == "itemprop" and value == "articlebody":
            found = "content"
        elif key in ("class", "id") and found != "content":
            names = set(_WORDS.findall(value))
            if inside:
                names.discard("header")
            if names & _HARD_NAMES:
                return "hard"
            if names & _LAYOUT_NAMES:
                found = "layout"
    return found


class Block(NamedTuple):
    text: str
    link: int  # characters inside links
    region: int  # 0: none
    prior: str | None
    heading: bool


class _Parts:
    __slots__ = ("heading", "link", "parts", "region")

    def __init__(self, region: tuple[int, str | None], heading: bool):
        self.parts, self.link, self.region, self.heading = [], 0, region, heading


def blocks(html: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[_Parts] = []
    stack: list[tuple[str, bool]] = []  # open elements: tag, whether it began a region
    where: dict[str, list[int]] = {}  # tag -> its places in the stack
    open_blocks: list[int] = []  # places of block elements in the stack
    regions: list[tuple[int, str | None]] = [(0, None)]
    n_regions = links = headings = 0
    now: _Parts | None = None
    at, size, last_gt = 0, len(html), html.rfind(">")
    quotes = True  # until a quoted value swallows the rest of the page
    endless: set[str] = set()  # tags whose end tag doesn't come any more

    def text(raw: str) -> None:
        nonlocal now
        if now is None:
            if raw.isspace():
                return
            now = _Parts(regions[-1], headings > 0)
            out.append(now)
        raw = decoded(raw)
        now.parts.append(raw)
        if links:
            now.link += len(raw.strip())

    def close(place: int) -> None:
        nonlocal links, headings
        while len(stack) > place:
            tag, region = stack.pop()
            where[tag].pop()
            if open_blocks and open_blocks[-1] == len(stack):
                open_blocks.pop()
            if region:
                regions.pop()
            links -= tag == "a"
            headings -= tag in _HEADINGS

    while at < size:
        lt = html.find("<", at)
        if lt != at:
            text(html[at : lt if lt >= 0 else size])
            if lt < 0:
                break
        at = lt
        if at > last_gt:  # no tag ends any more
            comment = html.find("<!--", at)
            text(html[at : comment if comment >= 0 else size])
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith(("<!", "<?"), at):
            at = html.find(">", at) + 1
            continue
        m = _NAME_AT.match(html, at + 1)
        if m is None:
            text("<")
            at += 1
            continue
        rest = _REST.match(html, m.end()) if quotes else None
        if rest is None:
            quotes = False
            end = html.find(">", m.end()) + 1
        else:
            end = rest.end()
        closing, tag, attrs = html[at + 1] == "/", m.group(1).lower(), html[m.end() : end - 1]
        at = end
        empty = attrs.endswith("/")
        if tag in _SKIP and not closing and not empty:
            shut = _ENDS[tag].search(html, at) if tag not in endless else None
            if shut is None:
                endless.add(tag)
            if tag == "head" and (shut is not None or "body" not in endless):
                body = _BODY.search(html, at, shut.start() if shut else size)
                if body is None and shut is None:
                    endless.add("body")
                at = body.start() if body else html.find(">", shut.start()) + 1 if shut else at
            elif shut is not None:
                gt = html.find(">", shut.end())
                at = gt + 1 if gt >= 0 else size
            elif tag not in ("head", "title", "button", "object"):
                at = size
            if now is not None:
                now.parts.append(" ")
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            now = None
        if tag in _VOID or empty:
            continue
        if closing:
            places = where.get(tag)
            # An inline end tag doesn't close blocks.
            if places and (block or not open_blocks or open_blocks[-1] < places[-1]):
                close(places[-1])
            continue
        shuts = _CLOSES.get(tag)
        if shuts and open_blocks and stack[open_blocks[-1]][0] in shuts:
            close(open_blocks[-1])
        inside = regions[-1][1]
        prior = _prior(tag, attrs, inside == "content")
        # What is inside boilerplate stays so; a layout region may hold the content.
        begins = prior is not None and prior != inside and inside != "hard" and not (inside == "content" and prior == "content")
        if begins:
            n_regions += 1
            regions.append((n_regions, prior))
        places = where.setdefault(tag, [])
        places.append(len(stack))
        if block:
            open_blocks.append(len(stack))
        stack.append((tag, begins))
        links += tag == "a"
        headings += tag in _HEADINGS
    found = []
    for b in out:
        t = _SPACE.sub(" ", "".join(b.parts)).strip()
        if t:
            found.append(Block(t, b.link, b.region[0], b.region[1], b.heading))
    return found


def running(text: str) -> bool | None:
    """Whether a block is running text: None if it is too short to tell."""
    words = text.lower().split()
    if len(words) < LONG_WORDS:
        return None
    return sum(w.strip(".,;:!?") in _STOPS for w in words) >= STOP_DENSITY * len(words)


def first_pass(found: list[Block]) -> tuple[list[bool | None], list[str | None]]:
    """(label or None, prior) of each block."""
    prose = [running(b.text) for b in found]
    dense = [b.link > LINK_DENSITY * len(b.text) for b in found]
    # A layout name that holds all the running text describes the layout.
    doubt = not any(p and not d and b.prior not in ("hard", "layout") for p, d, b in zip(prose, dense, found))
    priors = [None if doubt and b.prior == "layout" else b.prior for b in found]
    out: list[bool | None] = []
    for p, d, prior in zip(prose, dense, priors):
        if d and not (p and prior == "content"):
            out.append(False)
        elif p is None:
            out.append(None)
        elif p:
            out.append(prior not in ("hard", "layout"))
        else:
            out.append(None if prior == "content" else False)
    return out, priors


def _nearest(labels: list[bool | None]) -> tuple[list, list]:
    """For each place the nearest decided one before it and after it, as (place, label) or None."""
    n, seen = len(labels), None
    before, after = [None] * n, [None] * n
    for k, x in enumerate(labels):
        before[k] = seen
        if x is not None:
            seen = k, x
    seen = None
    for k in range(n - 1, -1, -1):
        after[k] = seen
        if labels[k] is not None:
            seen = k, labels[k]
    return before, after


def _inherited(k: int, before, after, heading: bool, prior: bool | None = None) -> bool | None:
    """prior: a third vote where neighbours differ; without it the nearer decides, as far from both is bad."""
    if before is None or after is None:
        return (before or after or (0, None))[1]
    if heading or before[1] == after[1]:
        return after[1]
    if prior is not None:
        return prior
    left, right = k - before[0], after[0] - k
    return left != right and (before[1] if left < right else after[1])


def labels(found: list[Block]) -> list[tuple[bool, str]]:
    """(whether it is content, what decided: rules, neighbours or prior) of each block."""
    first, priors = first_pass(found)
    own: dict[int, list[int]] = {}
    for k, b in enumerate(found):
        own.setdefault(b.region, []).append(k)
    near: list[tuple] = [(None, None)] * len(found)
    for region, members in own.items():
        if region:
            before, after = _nearest([first[k] for k in members])
            for i, k in enumerate(members):
                near[k] = tuple(x and (members[x[0]], x[1]) for x in (before[i], after[i]))
    page = list(zip(*_nearest(first))) if found else []
    out = []
    for k, b in enumerate(found):
        label, why, good = first[k], "rules", priors[k] == "content"
        if label is None:
            why = "neighbours"
            label = _inherited(k, *near[k], b.heading, good if priors[k] else None)
            if label is None and priors[k] is not None:
                label, why = good, "prior"
            elif label is None:
                label = _inherited(k, *page[k], b.heading) or False
        out.append((label, why))
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, (good, _) in zip(found, labels(found)) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    flat = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return flat.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
