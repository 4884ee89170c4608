"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from feedloom.llm.common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li tbody td tfoot th thead title tr".split())
#: What a start tag ends besides, up to the nearest element that holds such tags.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("td th caption table button object li dd dt div section article aside main".split())
#: Never main text.
DROP_TAGS = frozenset(
    "head script style noscript template textarea title nav footer aside button select option "
    "iframe svg canvas object embed xmp noembed noframes menu dialog".split()
)
#: A class, id or role of this name surrounds a main text, as a form does, unless the main
#: text is in it (``Page.decide``).
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead banner cookie cookies consent "
    "gdpr notice notices popup modal overlay comment comments disqus reply replies related recommended "
    "share sharing social newsletter subscribe subscription signup widget toolbar pagination pager "
    "skip copyright contentinfo complementary search".split()
)
#: Those that also name parts of an article: in one they go if they are lists of links.
PART_WORDS = frozenset("notice notices side share sharing social".split())
#: Of a name of several parts (comment-list, siteFooter) one of these is enough, unless another
#: part says that it is about the main text or that such a thing is there or not.
COMPOUND_WORDS = DROP_WORDS - frozenset("side search notice notices skip complementary copyright toolbar".split())
NO_COMPOUND = frozenset(
    "no not has have with without is content article main post entry page story wrap wrapper container layout".split()
)
#: Names that begin or end with one of these are of readers whatever else they say.
READERS = frozenset("comment comments disqus".split())
HAVING = frozenset("no not has have with without is closed count".split())
#: What holds most of a page without article and main is no surrounding if it has so many characters.
LEAST_MAIN = 200
PAGE_HEADER = frozenset(("header", "hgroup"))
MAIN = frozenset(("article", "main", "body", "html"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE = re.compile(r"=\s*([\"'])|>")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LABEL = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _tag_end(page: str, at: int, dead: set) -> int:
    """Where the tag open at ``at`` closes (its ``>``), or -1. Quoted values may hold ``>``;
    a quote that never closes is an ordinary character (``dead`` remembers it)."""
    while True:
        m = _VALUE.search(page, at)
        if not m:
            return -1
        quote = m[1]
        if quote is None:
            return m.start()
        at = m.end()
        if quote not in dead:
            close = page.find(quote, at)
            if close < 0:
                dead.add(quote)
            else:
                at = close + 1


def _link_list(chars: int, link_chars: int, link_tags: int) -> bool:
    """Whether an element is mostly links, and more than one."""
    return link_tags > 1 and 2 * link_chars > chars


def _compound(name: str) -> int:
    """Whether a name of several parts tells a surrounding: 2 for readers' comments, 1 for
    others, 0 for none."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if len(parts) < 2:
        return 0
    if not HAVING & set(parts) and (parts[0] in READERS or parts[-1] in READERS):
        return 2
    return int(bool(COMPOUND_WORDS & set(parts)) and not NO_COMPOUND & set(parts))


class Page:
    """The elements of a page in order, and its texts.

    Element ``i`` has ``tag[i]`` and ``parent[i]``; ``texts`` holds (element, text) and, where
    a block begins or ends, None. Everything is one pass over the page in linear time.
    """

    def __init__(self, page: str):
        self.tag = ["#page"]
        self.parent = [-1]
        self.dropped = [False]
        self.doubtful: dict[int, bool] = {}  # surroundings by label or form: whether an article's part
        self.compound: dict[int, int] = {}  # those by a name of several parts (``_compound``)
        self.texts: list[tuple[int, str] | None] = []
        self.stack = [0]
        self.open: Counter = Counter()
        self.main = 0  # open elements that hold a main text
        self.read(page)
        self.decide()

    def read(self, page: str) -> None:
        at, size, dead = 0, len(page), set()
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            if lt > at:
                self.text(page[at:lt])
            nxt = page[lt + 1 : lt + 2]
            if nxt == "/" and page[lt + 2 : lt + 3].isalpha():
                end = page.find(">", lt)
                if end < 0:
                    return
                self.close(_NAME.match(page, lt + 2)[0].lower())
                at = end + 1
            elif nxt.isascii() and nxt.isalpha():
                name = _NAME.match(page, lt + 1)
                end = _tag_end(page, name.end(), dead)
                if end < 0:
                    return
                tag = name[0].lower()
                self.start(tag, page[name.end() : end])
                at = end + 1
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                    if not close:
                        return
                    at = close.start()
            elif page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                if end < 0:
                    return
                at = end + 3
            elif nxt in ("!", "?", "/"):
                end = page.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            else:
                self.text("<")
                at = lt + 1

    def text(self, text: str) -> None:
        self.texts.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def start(self, tag: str, rest: str) -> None:
        if tag in ENDS_P and self.open["p"]:
            self.end_nearest(("p",), SCOPE)
        if tag in ENDS:
            self.end_nearest(*ENDS[tag])
        if tag == "br":
            self.text(" ")
            return
        if tag in BLOCKS:
            self.texts.append(None)
        up = self.stack[-1]
        dropped = self.dropped[up] or tag in DROP_TAGS or (tag in PAGE_HEADER and not self.main)
        if not dropped and tag not in MAIN:
            given = [w for m in _LABEL.finditer(rest) for w in (m[2] or m[3] or m[4] or "").split()]
            names = {w.lower() for w in given} & DROP_WORDS
            if names or tag == "form":
                self.doubtful[len(self.tag)] = bool(self.main) and tag != "form" and names <= PART_WORDS
            elif given:
                kind = max(map(_compound, given))
                if kind:
                    self.compound[len(self.tag)] = kind
        self.tag.append(tag)
        self.parent.append(up)
        self.dropped.append(dropped)
        if tag not in VOID and not (rest.endswith("/") and tag in ("svg", "path")):
            self.stack.append(len(self.tag) - 1)
            self.open[tag] += 1
            self.main += tag in ("article", "main")

    def decide(self) -> None:
        """Drop the doubtful elements, but not those that hold a main element or, where no
        article or main element stands outside of all, an article or most of the page's
        characters outside links. One with a name of several parts goes if it holds no article
        and no more than half of the characters of the article, main element or page around
        it; if it is of readers' comments, also where enough is left without it."""
        if not self.doubtful and not self.compound:
            return
        n, parent = len(self.tag), self.parent
        free, links, link_tags = [0] * n, [0] * n, [0] * n
        in_link, within, article, main = ([False] * n for _ in range(4))
        outside = False
        box = [0] * n
        for i in range(1, n):
            box[i] = parent[i] if self.tag[parent[i]] in ("article", "main") else box[parent[i]]
            in_link[i] = in_link[parent[i]] or self.tag[i] == "a"
            within[i] = within[parent[i]] or i in self.doubtful
            article[i] = self.tag[i] in ("article", "main") and not self.dropped[i]
            main[i] = article[i] and self.tag[i] == "main"
            outside = outside or (article[i] and not within[i])
            link_tags[i] = int(self.tag[i] == "a")
        for part in self.texts:
            if part and not self.dropped[part[0]]:
                (links if in_link[part[0]] else free)[part[0]] += len(" ".join(part[1].split()))
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                for column in (free, links, link_tags, article, main):
                    column[parent[i]] += column[i]
        for i in range(1, n):
            gone = False
            if i in self.doubtful:
                most = free[i] >= LEAST_MAIN and 2 * free[i] > free[0]
                if self.doubtful[i]:
                    gone = _link_list(free[i] + links[i], links[i], link_tags[i])
                else:
                    gone = not (main[i] or not outside and (article[i] or most))
            elif i in self.compound and not article[i]:
                rest = free[box[i]] - free[i]
                gone = rest >= free[i] or (self.compound[i] == 2 and rest >= LEAST_MAIN)
            self.dropped[i] = self.dropped[i] or gone or self.dropped[parent[i]]

    def end_nearest(self, tags: tuple, within) -> None:
        """End the nearest open element of ``tags`` that no element of ``within`` holds."""
        if not any(self.open[t] for t in tags):
            return
        for i in reversed(self.stack):
            tag = self.tag[i]
            if tag in tags:
                self.close(tag)
                return
            if tag in within:
                return

    def close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while True:
            name = self.tag[self.stack.pop()]
            self.open[name] -= 1
            self.main -= name in ("article", "main")
            if name in BLOCKS:
                self.texts.append(None)
            if name == tag:
                return


def _density(chars: int, tags: int, link_chars: int, link_tags: int, page_links: float) -> float:
    """Characters per tag, lowered by the share of link characters and link tags."""
    if not chars:
        return 0.0
    tags, links, other = max(tags, 1), max(link_chars, 1), max(chars - link_chars, 1)
    base = math.log(chars / other * links + page_links * chars + math.e)
    return chars / tags * math.log(chars / links * tags / max(link_tags, 1)) / math.log(base) if base > 1 else 0.0


def _container(tree: Page, core: int) -> int:
    """The element that holds the whole text around ``core``: the outermost article or main
    element; without one the nearest that holds a headline too; else the parent. The body is
    one only if the headline stands right in it. 0 if there is none."""
    parent, up = tree.parent, [core]
    while up[-1] > 0:
        up.append(parent[up[-1]])
    named = [i for i in up if tree.tag[i] in ("article", "main")]
    if named:
        return named[-1]
    holds = {}  # elements with a headline below, and whether it is their child
    for i, tag in enumerate(tree.tag):
        if tag == "h1" and not tree.dropped[i]:
            holds[parent[i]] = True
            j = parent[i]
            while j > 0 and parent[j] not in holds:
                j = parent[j]
                holds[j] = False
    for i in [j for j in up if j in holds] + up[1:2]:
        return i if i > 0 and (tree.tag[i] not in ("body", "html") or holds.get(i)) else 0
    return 0


def main_text(page: str) -> str:
    """The page's main text: its blocks, one per line.

    Elements that surround a main text by their tag or by a name in their class, id or role
    (``Page.decide``) are left out. Of the others the one with the largest sum of child densities is the text
    (a text of its own counts as a child). The least density on the way from it to the body
    is the threshold: from the body down, an element that reaches it adds the element with
    the largest sum below it. Of the element that holds the text (``_container``) all else is
    added but blocks that are mostly links.
    """
    tree = Page(page)
    n, parent = len(tree.tag), tree.parent
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    total = [0.0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tree.tag[i] == "a"
    for part in tree.texts:
        if part and not tree.dropped[part[0]]:
            i, size = part[0], len(" ".join(part[1].split()))
            chars[i] += size
            total[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if not tree.dropped[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    if not chars[0]:
        return ""
    page_links = max(link_chars[0], 1) / chars[0]
    density = [_density(*x, page_links) for x in zip(chars, tags, link_chars, link_tags)]
    for i in range(n - 1, 0, -1):
        if not tree.dropped[i]:
            total[parent[i]] += density[i]
    best = list(range(n))  # below each element, itself included
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if not tree.dropped[i] and total[best[i]] > total[best[p]]:
            best[p] = best[i]
    threshold, i = density[best[0]], best[0]
    while i > 0:
        i = parent[i]
        if i > 0 and tree.tag[i] != "html":
            threshold = min(threshold, density[i])
    marked, reached = [False] * n, [False] * n
    for i in range(n):
        if tree.dropped[i]:
            continue
        reached[i] = i == 0 or tree.tag[i] == "html" or (reached[parent[i]] and density[i] >= threshold)
        if reached[i]:
            marked[best[i]] = True
    for i in range(1, n):
        marked[i] = not tree.dropped[i] and (marked[i] or marked[parent[i]])
    box = _container(tree, best[0])
    if box:
        inside = [False] * n
        inside[box] = marked[box] = True
        for i in range(box + 1, n):
            links = tree.tag[i] in BLOCKS and _link_list(chars[i], link_chars[i], link_tags[i])
            inside[i] = inside[parent[i]] and not tree.dropped[i] and not links
            marked[i] = marked[i] or inside[i]
    blocks, block = [], []
    for part in [*tree.texts, None]:
        if part is None:
            words = "".join(block).split()
            if words:
                blocks.append(" ".join(words))
            block = []
        elif marked[part[0]]:
            block.append(part[1])
    return "\n".join(blocks)


def extract(
    df: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Kept columns, ``text`` and ``n_chars`` (code points) of every page, row by row.

    Character references are decoded, white space inside a block becomes one space, blocks
    follow in page order, one per line; ``<br>`` is white space. NULL, empty or text-free
    pages give an empty text. Of elements with equal sums of densities the outer one is the
    text, else the later one. A tag, comment or raw element that never closes takes the rest
    of the page with it. Repeated rows give repeated results; a kept column named as an
    output gives way.
    """

    def rows(batches: Iterator[list]):
        for (pages,) in batches:
            texts = [main_text(p) if p else "" for p in pages.to_pylist()]
            yield [texts, [len(t) for t in texts]], None

    return map_arrow(df, [column], list(keep), "text string, n_chars long", rows)
