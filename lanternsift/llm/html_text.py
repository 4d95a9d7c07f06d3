"""HTML extraction by tag-path ratios.

A page is read in one linear pass into text blocks. Every container (body, div, section, article, ...) is a node of its
own, and below it a root-to-leaf path goes by tag and class. Per path, text length and punctuation are added up and
divided by the tags seen on it; these ratios are smoothed over the order in which a container's paths appear, fused with
how much of the path's text isn't links and how long it is, and thresholded against the best path. A block is content when its path
is; a heading, caption or list that stays below the threshold is content with the paths of its own container, and a
container between two content ones with them, unless links are most of its text. Where the best path lies in an article
or main element, that element is the region and its containers are content unless links are most of their text.

What markup itself declares isn't scored: navigation, footer, aside, form, script, style and the like by tag or role,
hidden elements, a header outside an article, and elements whose whole class or id name says advert, comments, notice
or sidebar. Part of a name says nothing.

Defined cases: a null, empty or tagless html gives its plain text; a page without text, or of links alone, gives an
empty string; broken nesting, unclosed tags and comments and cut entities are read as browsers do; elements may be nested
to any depth; repeated rows are read one by one; other columns are left alone; an empty table gives an empty result.
Work is linear in the length of the page, whatever is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from lanternsift.llm.common import slim

#: Share of the best path's fused ratio at which a path is content.
THRESHOLD = 0.25
#: Weight of a path itself in smoothing; its neighbours in its container share the rest.
SELF = 0.6
#: Ratio from which a path is prose; longer paragraphs don't make others look poor.
PROSE = 120.0
#: A mark of punctuation counts as so many characters.
PUNCT = 10
#: Share of link text from which a path or container is a menu.
LINKS = 0.5
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("nav footer aside form menu dialog script style template noscript iframe svg math canvas object audio video head title select textarea button xmp noembed noframes".split())
#: Tags that an opening tag ends when they are still open, up to an element that contains both.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section main div body html aside nav header footer form blockquote td th figure fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td html blockquote header".split())
#: Each of these is a path of its own, so that a list of links beside a list of things is told apart.
LISTS = frozenset("ul ol dl table".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Whole names of classes and ids that declare what isn't the article; what is no part of an article's structure either.
SKIP_NAME = frozenset(
    "ad ads advert adverts advertisement advertising ad-box ad-slot ad-banner ad-container adbox adsense comments comment comment-list comment-section comment-thread comment-body comments-area comments-list comments-section commentlist disqus-thread"
    " reader-comments user-comments replies cookie-notice cookie-banner cookie-bar cookie-consent cookie-popup consent-banner gdpr-banner sidebar side-bar newsletter newsletter-signup newsletter-box paywall popup"
    " modal promo promotion sponsored sponsored-content sponsor share-buttons share-bar share-links social-links social-share social-media social-buttons related-posts related-articles related-links related-stories"
    " breadcrumb breadcrumbs pagination pager navbar nav navigation main-nav site-nav top-nav main-menu site-menu nav-menu menu site-header site-footer page-footer masthead skip-link skip-links notice site-notice banner"
    " site-banner toolbar widget widget-area subscribe subscribe-box subscription signup sign-up login copyright".split()
)
_NAME = re.compile("[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile("[\t\n\f\r /]*([^\t\n\f\r />=][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(\"|'|[^\t\n\f\r >\"'][^\t\n\f\r >]*)?)?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />]|$)", re.IGNORECASE) for t in RAW}
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile("-?[0-9]+$")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。、！？،]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _names(value: str) -> set[str]:
    return {_NUMBER.sub("", _CAMEL.sub("-", n).lower().replace("_", "-")) for n in value.split()}


def _declared(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether the element says that it isn't the article."""
    if tag in SKIP or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") and not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in SKIP_ROLE:
        return True
    if _HIDDEN.search(attributes.get("style", "").lower()):
        return True
    if tag in ("html", "body", "main"):
        return False
    return any(not SKIP_NAME.isdisjoint(_names(attributes[k])) for k in ("class", "id") if k in attributes)


class _Reader:
    """Text blocks with their paths. An open element is (tag, skipped, container, path)."""

    def __init__(self):
        self.open: list[tuple[str, bool, int, int]] = []
        self.counts: dict[str, int] = {}
        #: Per open element of SCOPE, how many others of each block tag are open in it; per open block, the inline ones.
        self.scopes: list[dict[str, int]] = [{}]
        self.inline: list[dict[str, int]] = [{}]
        #: Containers: parent, outermost article or main, or -1.
        self.containers: list[tuple[int, int]] = [(-1, -1)]
        self.paths: dict[tuple, int] = {("root",): 0}
        self.tags: list[int] = [1]
        self.blocks: list[list] = []  # [pieces, path, container, characters in links]
        self.fresh = True
        self.articles = 0

    def _push(self, tag: str, skipped: bool, label: str) -> None:
        _, _, box, path = self.open[-1] if self.open else ("", False, 0, 0)
        if tag in CONTAINERS:
            region = self.containers[box][1]
            self.containers.append((box, len(self.containers) if region < 0 and tag in ("article", "main") else region))
            box = len(self.containers) - 1
            path = self._path(("box", box))
        elif tag in BLOCKS:
            path = self._path((path, label, len(self.tags) if tag in LISTS else -1))
        self.tags[path] += 1
        self.open.append((tag, skipped, box, path))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.articles += tag in ("article", "main")
        if tag not in BLOCKS:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
            return
        self.inline.append({})
        if tag in SCOPE:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def _path(self, key: tuple) -> int:
        found = self.paths.setdefault(key, len(self.tags))
        if found == len(self.tags):
            self.tags.append(0)
        return found

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.counts[tag] -= 1
        self.articles -= tag in ("article", "main")
        if tag not in BLOCKS:
            self.inline[-1][tag] -= 1
            return tag
        self.inline.pop()
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def _end_implied(self, tag: str) -> None:
        scope = self.scopes[-1]
        if tag in ENDS:
            ends, at, found = ENDS[tag], len(self.scopes) - 1, 0
            here = len(self.open)
            while True:  # scope by scope from the innermost: an end that is a scope itself leads to the one around it
                found = max(found, sum(1 for e in (*ends, "p") if self.scopes[at].get(e)))
                while here > 0 and self.open[here - 1][0] not in SCOPE:
                    here -= 1
                if here == 0 or self.open[here - 1][0] not in ends:
                    break
                found, here, at = 1, here - 1, at - 1
            if found:
                while self.open and len(self.open) > here and (len(self.scopes) - 1 > at or any(self.scopes[at].get(e) for e in (*ends, "p"))):
                    self._pop()
            return
        heading = next((h for h in HEADINGS if scope.get(h)), None) if tag in HEADINGS else None
        if (scope.get("p") or heading) and not scope.get("li"):
            while scope.get("p") or heading and scope.get(heading):
                self._pop()
        elif scope.get("p"):  # in a list item: a paragraph in it ends, one around it doesn't
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ("p", "li"):
                    break
            if self.open[k][0] == "p":
                while len(self.open) > k:
                    self._pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.fresh = True
            if tag not in ("html", "head", "body"):
                self._end_implied(tag)
        if tag in ("body", "html") and self.counts.get(tag):
            return
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            self.tags[self.open[-1][3] if self.open else 0] += 1
            return
        if tag == "body":
            while self.open and self.open[-1][0] == "head":
                self._pop()
        skipped = bool(self.open and self.open[-1][1]) or _declared(tag, attributes, self.articles > 0)
        self._push(tag, skipped, f"{tag}.{attributes['class']}" if "class" in attributes else tag)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if tag == "br":
            self.text(" ")
        elif tag in BLOCKS and self.counts.get(tag) or tag not in BLOCKS and self.inline[-1].get(tag):  # an inline end tag doesn't end a block
            while self._pop() != tag:
                pass

    def text(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        if self.fresh:
            if not data or data.isspace():
                return
            _, _, box, path = self.open[-1] if self.open else ("", False, 0, 0)
            self.blocks.append([[], path, box, 0])
            self.fresh = False
        block = self.blocks[-1]
        block[0].append(data)
        if self.counts.get("a"):
            block[3] += len(data.strip())


def read(page: str) -> _Reader:
    """Tokens of a page in one pass; every character is looked at a bounded number of times."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0 or mark == n - 1:
            reader.text(unescape(page[at:]))
            break
        following = page[mark + 1]
        name = _NAME.match(page, mark + 2 if following == "/" else mark + 1)
        if not name and following not in "!?/":
            reader.text(unescape(page[at : mark + 1]))
            at = mark + 1
            continue
        if mark > at:
            reader.text(unescape(page[at:mark]))
        if not name:  # comments and what is read as one
            stop = page.find("-->", mark + 2) if page.startswith("<!--", mark) else page.find(">", mark)
            at = n if stop < 0 else stop + (3 if page.startswith("<!--", mark) else 1)
            continue
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        while at < n and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            if not m:
                at += 1
                continue
            value, at = m[2] or "", m.end()
            if value in ('"', "'"):
                stop = page.find(value, at)
                if stop < 0:
                    at = n
                    break
                value, at = page[at:stop], stop + 1
            if following != "/" and len(attributes) < 64:
                attributes.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        if at >= n:
            break  # a tag that never ends isn't one
        at += 1
        if following == "/":
            reader.end(tag)
            continue
        reader.start(tag, attributes)
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else n
    return reader


def _chosen(blocks: list[tuple[str, int, int, int]], tags: list[int], containers: list[tuple[int, int]]) -> list[bool]:
    """For each block (text, path, container, characters in links) whether it is content."""
    stats: dict[int, list[float]] = {}
    boxes: dict[int, list[float]] = {}
    home: dict[int, int] = {}
    for text, path, box, linked in blocks:
        s, b = stats.setdefault(path, [0, 0, 0]), boxes.setdefault(box, [0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += linked
        b[0] += len(text)
        b[1] += linked
        home[path] = box
    paths = list(stats)
    plain = {p: 1 - min(1.0, stats[p][2] / stats[p][0]) for p in paths}
    ratio = {p: min(PROSE, (stats[p][0] + PUNCT * stats[p][1]) / max(tags[p], 1)) * plain[p] for p in paths}
    near: dict[int, list[float]] = {p: [] for p in paths}
    before: dict[int, int] = {}
    for p in paths:
        if home[p] in before:
            near[p].append(ratio[before[home[p]]])
            near[before[home[p]]].append(ratio[p])
        before[home[p]] = p
    smooth = {p: SELF * ratio[p] + (1 - SELF) * (sum(near[p]) / len(near[p]) if near[p] else ratio[p]) for p in paths}
    menu = {p for p in paths if stats[p][2] > LINKS * stats[p][0]}
    fused = {p: 0.0 if p in menu else smooth[p] * plain[p] * log1p(stats[p][0]) for p in paths}
    best = max(paths, key=lambda p: fused[p])
    if fused[best] <= 0:
        return [False] * len(blocks)
    content = {p for p in paths if fused[p] >= THRESHOLD * fused[best]}
    full = {home[p] for p in content}
    # A container between two content ones of one parent belongs to them.
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    order = {b: i for i, b in enumerate(boxes)}
    for b in full:
        up = containers[b][0]
        first[up], last[up] = min(first.get(up, order[b]), order[b]), max(last.get(up, order[b]), order[b])
    between = {b for b in boxes if boxes[b][1] <= LINKS * boxes[b][0] and first.get(containers[b][0], len(order)) < order[b] < last.get(containers[b][0], -1)}
    regions = {containers[b][1] for b in full if containers[b][1] >= 0} if containers[home[best]][1] >= 0 else None
    out = []
    for _, path, box, _ in blocks:
        if regions is not None:
            out.append(containers[box][1] in regions and path not in menu)
        else:
            out.append(path in content or (box in full or box in between) and path not in menu)
    return out


def extract(html: str | None) -> str:
    reader = read(html or "")
    blocks = [(t, path, box, linked) for pieces, path, box, linked in reader.blocks if (t := _SPACE.sub(" ", "".join(pieces)).strip())]
    return "\n\n".join(b[0] for b, keep in zip(blocks, _chosen(blocks, reader.tags, reader.containers)) if keep) if blocks else ""


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row."""
    base = slim(pages, "page_id", "url", "html")
    kind = {f.name: f.dataType.simpleString() for f in base.schema}
    return base.mapInArrow(_batches, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
