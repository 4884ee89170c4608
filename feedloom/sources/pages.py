"""HTML pages to records: a page spec names the repeated block and its fields.

Python only walks the markup and hands back texts and attributes; conversion,
JSON parsing and clean-up are Spark expressions on its output.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Optional

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedloom.session import spread

# Fixed values of HTML: elements without an end tag, and those a sibling closes.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "table"}, "option": {"option"}}


@dataclass(frozen=True)
class Step:
    """One element on a path: its tag (None = any) and exact attribute values."""

    tag: Optional[str] = None
    attrs: tuple[tuple[str, str], ...] = ()
    child: bool = False                    # a direct child, not any descendant
    href_prefix: Optional[str] = None
    nth: Optional[int] = None              # 1-based among the matches below one parent
    alone: Optional[str] = field(default=None, init=False, compare=False)   # the text of a lone attribute that fits

    def __post_init__(self):
        if len(self.attrs) == 1 and self.href_prefix is None and not re.search("[&\"]", self.attrs[0][1]):
            object.__setattr__(self, "alone", ' %s="%s"' % self.attrs[0])


def at(tag: Optional[str] = None, child: bool = False, href_prefix: Optional[str] = None,
       nth: Optional[int] = None, cls: Optional[str] = None, **attrs: str) -> Step:
    named = dict(attrs, **({"class": cls} if cls is not None else {}))
    return Step(tag, tuple(sorted(named.items())), child, href_prefix, nth)


@dataclass(frozen=True)
class Take:
    """What to read at a path: ``text``, ``html`` or an attribute name."""

    path: tuple[Step, ...]
    what: str = "text"
    unescape: bool = False
    whole_page: bool = False   # look in the page, not in the block
    index: int = 0             # which match (0 = first)


@dataclass(frozen=True)
class PageSpec:
    """Blocks of a page and the fields of each block."""

    blocks: tuple[tuple[Step, ...], ...]   # tried in turn, results in this order
    fields: dict[str, Take] = field(default_factory=dict)


# A comment, a declaration, or a tag: (closing slash, name, attribute text).
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    # What no ``>`` follows is text up to the end of the page.
    r"|(<[!?/]?[a-zA-Z!?][^>]*\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_CLOSED = (" /", '"/', "'/")   # how the attribute text of an element without content ends
FEW_NODES = 16   # so many are looked through rather than bisected
_RAW = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style", "title", "textarea")}


class _Node:
    __slots__ = ("tag", "raw", "parent", "texts", "start", "end", "_attrs")

    def __init__(self, tag: str, raw: str, parent: Optional[_Node], start: int):
        self.tag, self.raw, self.parent, self.start = tag, raw, parent, start
        self.end, self.texts, self._attrs = start, [], None

    @property
    def attrs(self) -> dict[str, str]:
        """Attributes, parsed when first asked for; the first of a repeated name counts."""
        if self._attrs is None:
            self._attrs = {}
            for name, value in _ATTRIBUTE.findall(self.raw):
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                self._attrs.setdefault(name.lower(), html_lib.unescape(value) if "&" in value else value)
        return self._attrs


class _Page:
    """Elements of a page in document order, each with its place in the source."""

    def __init__(self, source: str):
        self.source = source
        self.root = top = _Node("", "", None, -1)
        self.nodes: list[_Node] = []
        self.by_tag: dict[str, list[_Node]] = {}
        nodes, by_tag = self.nodes, self.by_tag
        opened: dict[str, int] = {}   # open elements per tag
        position, again = 0, True
        # One loop without calls: it runs for every tag of every page.
        while again:
            again = False
            for match in _TOKEN.finditer(source, position):
                begin, end = match.span()
                if begin > position:
                    top.texts.append(source[position:begin])
                position = end
                slash, tag, raw, rest = match.groups()
                if tag is None:
                    if rest is not None:
                        top.texts.append(rest)
                    continue
                tag = tag.lower()
                if slash:
                    if opened.get(tag):  # else an end tag without a start tag
                        while top.tag != tag:
                            top.end = begin
                            opened[top.tag] -= 1
                            top = top.parent
                        top.end = end
                        opened[tag] -= 1
                        top = top.parent
                    continue
                if top.tag in _CLOSED_BY and tag in _CLOSED_BY[top.tag]:
                    top.end = begin
                    opened[top.tag] -= 1
                    top = top.parent
                node = _Node(tag, raw, top, begin)
                node.end = end
                nodes.append(node)
                if tag in by_tag:
                    by_tag[tag].append(node)
                else:
                    by_tag[tag] = [node]
                if tag in _VOID or raw == "/" or raw[-2:] in _CLOSED:
                    continue
                opened[tag] = opened.get(tag, 0) + 1
                top = node
                if tag in _RAW:
                    # Up to its end tag the content is text, whatever it looks like.
                    stop = _RAW[tag].search(source, end)
                    position = stop.start() if stop else len(source)
                    if position > end:
                        top.texts.append(source[end:position])
                    again = True
                    break
        if position < len(source):
            top.texts.append(source[position:])
        while top is not None:
            top.end = len(source)
            top = top.parent

    def below(self, node: _Node, tag: Optional[str]) -> Iterable[_Node]:
        """Descendants with a tag, in document order."""
        pool = self.nodes if tag is None else self.by_tag.get(tag, ())
        if node is self.root:
            return pool
        if len(pool) <= FEW_NODES:
            return [n for n in pool if node.start < n.start < node.end]
        first = bisect_right(pool, node.start, key=_start)
        return pool[first:bisect_left(pool, node.end, lo=first, key=_start)]


def _start(node: _Node) -> int:
    return node.start


def _fits(node: _Node, step: Step) -> bool:
    raw = node.raw
    if raw == step.alone:
        return True  # this attribute as it is asked for and no other
    for name, value in step.attrs:
        if value not in raw and "&" not in raw:
            return False  # not even in the source text: no need to parse attributes
        if node.attrs.get(name) != value:
            return False
    if step.href_prefix is not None:
        return node.attrs.get("href", "").startswith(step.href_prefix)
    return True


def _step(page: _Page, found: Sequence[_Node], step: Step) -> list[_Node]:
    """The matches of one step below the nodes that the steps before it found."""
    if len(found) == 1 and step.nth is None:
        node = found[0]
        below = page.below(node, step.tag)
        if step.child:
            return [n for n in below if n.parent is node and _fits(n, step)]
        return [n for n in below if _fits(n, step)]
    matches, known = [], set()
    for node in found:
        seen: dict[int, int] = {}
        for n in page.below(node, step.tag):
            if (step.child and n.parent is not node) or not _fits(n, step):
                continue
            if step.nth is not None:
                seen[id(n.parent)] = seen.get(id(n.parent), 0) + 1
                if seen[id(n.parent)] != step.nth:
                    continue
            if id(n) not in known:
                known.add(id(n))
                matches.append(n)
    return matches


def _find(page: _Page, start: _Node, path: Sequence[Step]) -> list[_Node]:
    found = [start]
    for step in path:
        found = _step(page, found, step)
    return found


class _Paths:
    """Paths of several fields, as a tree: what paths begin with alike is sought once."""

    def __init__(self, paths: Iterable[tuple[Step, ...]]):
        self.steps: list[tuple[int, Step]] = []   # the place of the steps before it, and the step
        places: dict[tuple[Step, ...], int] = {(): 0}
        for path in paths:
            for n in range(1, len(path) + 1):
                if path[:n] not in places:
                    self.steps.append((places[path[: n - 1]], path[n - 1]))
                    places[path[:n]] = len(self.steps)
        self.places = places

    def found(self, page: _Page, start: _Node) -> list[list[_Node]]:
        """The matches of each path by its place."""
        out = [[start]]
        for before, step in self.steps:
            out.append(_step(page, out[before], step) if out[before] else [])
        return out


class _Reader:
    """A page spec made ready: once for many pages."""

    def __init__(self, spec: PageSpec):
        self.blocks = spec.blocks
        self.own = _Paths(t.path for t in spec.fields.values() if not t.whole_page)
        self.whole = _Paths(t.path for t in spec.fields.values() if t.whole_page)
        self.fields = [
            (name, t, (self.whole if t.whole_page else self.own).places[t.path]) for name, t in spec.fields.items()
        ]

    def records(self, source: str) -> list[dict]:
        page = _Page(source)
        rows, whole = [], None
        for path in self.blocks:
            for block in _find(page, page.root, path):
                row = {}
                own = self.own.found(page, block)
                if whole is None:
                    whole = self.whole.found(page, page.root)
                for name, take, place in self.fields:
                    values: list[str] = []
                    for n in (whole if take.whole_page else own)[place]:
                        values += _read(page, n, take.what)
                        if len(values) > take.index:
                            break
                    value = values[take.index] if len(values) > take.index else ""
                    row[name] = html_lib.unescape(value) if take.unescape else value
                rows.append(row)
        return rows


def _read(page: _Page, node: _Node, what: str) -> list[str]:
    if what == "text":
        if node.tag in ("script", "style"):
            return node.texts
        return [html_lib.unescape(t) if "&" in t else t for t in node.texts]
    if what == "html":
        return [page.source[node.start:node.end]]
    return [node.attrs[what]] if what in node.attrs else []


def page_records(source: str, spec: PageSpec) -> list[dict]:
    """Records of one page, in block order. A field without a match is ''."""
    return _Reader(spec).records(source)


def parse_html(
    df: DataFrame, spec: PageSpec, html_col: str = "html", keep: Optional[Sequence[str]] = None
) -> DataFrame:
    """One row per block: the ``keep`` columns, ``record_pos`` and the spec's fields.

    Pages are parsed one by one inside Arrow batches; a page never meets another one.
    """
    keep = [c for c in df.columns if c != html_col] if keep is None else list(keep)
    schema = StructType(
        [df.schema[c] for c in keep]
        + [StructField("record_pos", LongType())]
        + [StructField(name, StringType()) for name in spec.fields]
    )
    names = [f.name for f in schema.fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(spec)
        for batch in batches:
            origin, records = [], []
            for k, source in enumerate(batch.column(len(keep)).to_pylist()):
                if source is not None:
                    for i, record in enumerate(reader.records(source)):
                        origin.append(k)
                        records.append([i, *record.values()])
            # Kept columns never leave Arrow: ids keep every bit.
            index = pa.array(origin, pa.int64())
            columns = [c.take(index) for c in batch.columns[: len(keep)]]
            kinds = [pa.int64()] + [pa.string()] * len(spec.fields)
            columns += [pa.array([r[n] for r in records], t) for n, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(df.select(*keep, html_col)).mapInArrow(parse, schema)
