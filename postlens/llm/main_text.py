"""Main text of web pages by composite text density.

The page is read into a tree.  Elements and roles that are never article text leave it
first: scripts, menus, page headers and footers, sidebars, forms, dialogs and what is
hidden.  So do boxes whose class or id is a name for adverts, notices, comments and the
like; a name counts only if all of its words are of that kind (``ad-box``, not
``no-sidebar`` or ``copyright-law``), and a box that holds most of the text stays.

For every node left the characters per tag are computed and lowered by the share of
characters and tags in links; a node's score is the sum of its children's densities.
The node with the largest score is the core of the article.  The least density on the
way from it to the body is the threshold.  The article grows from the core to its parent
as long as all that the parent adds looks like the article too: parts at the threshold
whose text is not mostly links, and of those without a tag for headings, paragraphs or
sections only such with a fair share of the core's score.  Scores inside an ``article`` or ``main`` element count
``RAISED`` times, and such an element around the core lets it grow that far.  In the article, parts below
the threshold whose text is mostly links are dropped.

Character references are decoded, white space becomes one blank, blocks are joined in
page order by one blank.  Nothing else is dropped and nothing is cut, however long the
page is.  NULL, empty and tag-only pages have an empty text.  Broken and cut-off markup
is read as browsers do in the common cases: open elements end with their parents, a tag
cut off by the end of the page is dropped.  Only page_id, url and html are read, so other
columns may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?P<close>>?)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr img ruby rt rp nobr".split()
)
#: An open p ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An open element of the key ends where one of its values begins.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Looking for an open element to end stops here.
SCOPE = frozenset("html table td th caption button object template body".split())
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe object"
    " embed svg canvas audio video dialog menu map title".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that tell what is not article text.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar rail nav"
    " navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations comment comments commentlist disqus respond replies reply widget toolbar pagination pager"
    " copyright disclaimer skip".split()
)
HEADER_WORDS = frozenset("header topbar".split())
#: Words that say nothing about what a box holds.
BOX_WORDS = frozenset(
    "box wrap wrapper container block section area list bar panel inner outer holder unit slot zone row col column item"
    " items site page top bottom left right global small large main primary secondary content div group".split()
)
#: Tags of parts that a text is made of.
TEXT_TAGS = frozenset(
    "h1 h2 h3 h4 h5 h6 hgroup p ul ol dl table figure figcaption blockquote pre section header details address hr center".split()
)
#: Share of the core's score that another box beside it needs.
FAIR = 0.25
#: What a score in an ``article`` or ``main`` element counts for.
RAISED = 4


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _says(name: str, never: frozenset) -> bool:
    """Whether a class or id names a box of a kind that is never article text."""
    words = [x.lower() for x in _NAME_PARTS.findall(name)]
    known = [x in never for x in words]
    return any(known) and all(k or x in BOX_WORDS or x.isdigit() for k, x in zip(known, words))


class _Page:
    """The tree in page order: parents before children, a subtree is a range of nodes."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes = ["#page"], [-1], [{}]
        self.first, self.end = [0], [0]  # range of a node's entries in ``parts``
        self.parts: list[tuple[int, str]] = []  # node and its text; "" is a break
        self.stack = [0]
        self._read(source)
        while self.stack:
            self._close()

    def _close(self) -> None:
        node = self.stack.pop()
        if self.tag[node] not in INLINE:
            self.parts.append((node, ""))
        self.end[node] = len(self.parts)

    def _open(self, tag: str, raw: str) -> None:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.attributes.append(_attributes(raw) if raw.strip(" /") else {})
        if tag not in INLINE:
            self.parts.append((node, ""))
        self.first.append(len(self.parts))
        self.end.append(len(self.parts))
        if tag not in VOID:
            self.stack.append(node)

    def _open_at(self, tags, stop=SCOPE) -> int | None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in stop:
                return None
        return None

    def _text(self, text: str) -> None:
        if text:
            self.parts.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                return
            self._text(source[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None or not found["close"]:
                if found[0].startswith("<![CDATA["):
                    self._text(found[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if found["end"]:
                depth = self._open_at({tag}, () if tag not in INLINE else ENDS_P | SCOPE)
                while depth is not None and len(self.stack) > depth:
                    self._close()
                continue
            if tag in ENDS_P:
                depth = self._open_at({"p"})
                while depth is not None and len(self.stack) > depth:
                    self._close()
            for sibling, by in SIBLINGS.items():
                if tag in by:
                    depth = self._open_at({sibling}, {"table", "ul", "ol", "dl", "select", "body"})
                    while depth is not None and len(self.stack) > depth:
                        self._close()
            self._open(tag, found["attributes"])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(source, at)
                self.parts.append((self.stack[-1], source[at : close.start()]))
                at = close.end()
                self._close()

    def left_out(self) -> list[bool]:
        """Whether a node is in a part that is never article text."""
        n = len(self.tag)
        holds = [self.tag[i] in ("article", "main") or self.attributes[i].get("role") == "main" for i in range(n)]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        out, inside, named = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            tag, have = self.tag[i], self.attributes[i]
            inside[i] = inside[up] or tag in ("article", "main") or have.get("role") == "main"
            if out[up]:
                out[i] = True
            elif tag in NEVER:
                out[i] = not holds[i] or tag in RAW
            elif tag == "header":
                out[i] = not inside[up] and not holds[i]
            elif have and tag not in ("html", "body", "main") and not (holds[i] and tag != "article"):
                out[i] = (
                    "hidden" in have
                    or have.get("aria-hidden") == "true"
                    or "display:none" in have.get("style", "").replace(" ", "").lower()
                    or have.get("role", "").lower() in NEVER_ROLES
                )
                if not out[i] and ("class" in have or "id" in have):
                    never = NEVER_WORDS if inside[i] else NEVER_WORDS | HEADER_WORDS
                    named[i] = any(_says(name, never) for name in f"{have.get('class', '')} {have.get('id', '')}".split())
        if any(named):
            size = [0] * n
            for node, text in self.parts:
                if text and not out[node]:
                    size[node] += len("".join(text.split()))
            for i in range(n - 1, 0, -1):
                size[self.parent[i]] += size[i]
            for i in range(1, n):
                out[i] = out[i] or out[self.parent[i]] or named[i] and 2 * size[i] <= size[0]
        return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, all_links: float) -> float:
    """Characters per tag, lowered for text in links; ``all_links`` is the body's share."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + all_links * chars + math.e)
    return chars / tags * max(math.log(chars / max(link_chars, 1) * tags / link_tags), 0.0) / max(math.log(base + 1), 1e-9)


def main_text(source: str) -> str:
    if not source:
        return ""
    page = _Page(source)
    out, n = page.left_out(), len(page.tag)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    linked = [False] * n
    for i in range(n):
        linked[i] = page.tag[i] == "a" or (i > 0 and linked[page.parent[i]])
    for node, text in page.parts:
        if text and not out[node]:
            length = len("".join(text.split()))
            chars[node] += length
            link_chars[node] += length * linked[node]
    for i in range(n - 1, 0, -1):
        if out[i]:
            continue
        up = page.parent[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density = [0.0 if out[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
    score = [0.0] * n
    for i in range(1, n):
        score[page.parent[i]] += density[i]
    holding = [False] * n
    for i in range(1, n):
        holding[i] = page.tag[i] in ("article", "main") or holding[page.parent[i]]
        score[i] *= RAISED if holding[i] else 1
    best = max(range(n), key=lambda i: (score[i], -i)) if any(score) else 0
    core, path, up = best, [], best
    while up > 0 and page.tag[up] not in ("body", "html"):
        path.append(up)
        up = page.parent[up]
    thin = min([density[i] for i in path] + [density[up]])
    text_like = [density[i] >= thin or 2 * link_chars[i] <= chars[i] for i in range(n)]
    children: dict[int, list[int]] = {i: [] for i in path}
    for i in range(min(path, default=n), n):
        if page.parent[i] in children and not out[i] and chars[i]:
            children[page.parent[i]].append(i)

    def fits(i: int) -> bool:
        fair = page.tag[i] in TEXT_TAGS or page.tag[i] in INLINE or score[i] + density[i] >= FAIR * score[core]
        return text_like[i] and 2 * link_chars[i] <= chars[i] and fair

    named = [k for k, i in enumerate(path) if page.tag[i] in ("article", "main")]
    reach = max((k for k in named if page.tag[path[k]] == "article"), default=min(named, default=0))
    for k in range(1, len(path)):
        if k <= reach or not named and all(i == path[k - 1] or fits(i) for i in children[path[k]]):
            best = path[k]
        else:
            break
    kept = [False] * n
    for i in range(best, n):
        up = page.parent[i]
        if i == best:
            kept[i] = True
        elif up >= best and kept[up] and not out[i]:
            # Link lists are thin; a thin part without links is a short paragraph.
            kept[i] = text_like[i] or page.tag[i] in INLINE
    pieces = [
        text if text else " " for node, text in page.parts[page.first[best] : page.end[best]] if not text or kept[node]
    ]
    return " ".join("".join(pieces).split())


def text_column() -> Callable[[Column], Column]:
    """``html -> text``."""
    return per_batch(lambda: lambda pages: [main_text(p) for p in pages], pa.string(), "string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.  Repeated rows are read one by one."""
    return pages.select("page_id", "url", text_column()(F.col("html")).alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
