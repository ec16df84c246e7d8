"""Main text of web pages by composite text density.

A page is read into a tree of elements with the usual implied end tags. Every element has its number of characters,
of tags, of characters inside links and of link tags; its composite density is characters per tag, adjusted by the
share of links in it and in the page. The densities of what an element holds add up to its density sum; neighbouring
text and inline elements are one line, which counts as one child with the density of the whole line, so that a long
paragraph with much markup does not outweigh the container of all paragraphs. The element with the largest sum is
the core of the page. The smallest density on the path from the body to the core is the threshold. From the body
down, every element that reaches it gives the subtree with the largest density sum in it, and so do lines of bare
text; of elements below it nothing is taken. On a page without links the density is characters per tag. The names
``article`` and ``main`` do not decide what is taken; they only keep a header inside them, and a part that is named
an advert from passing for the article beside it.

Elements that are never part of an article (navigation, footers, forms, scripts, styles, their roles)
and elements with a class or id that names an advert, sidebar, comments and the like are left out
before the densities are taken, so that they cannot win and are not part of a winner. A class counts as
a whole, by its last word (``top-ad``) or by its first before the name of a part (``ad-slot``), and not
if it has a word of state or denial (``no-sidebar``, ``comments-open``). Paragraphs, headings, list items
and cells go by advert names only. An element with blocks in it that holds most of the page's text outside links is a
wrapper and stays, unless an article stands beside it.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by one line break, empty blocks vanish; nothing else is dropped, and no page is cut off.

Defined results: null, empty and text-free pages give the empty text; a page without any tag is one
block of text; unclosed and stray tags are tolerated; where the quotes of a tag run to the end of the page, quotes mean
nothing from there on, and a ``<`` after the last ``>`` is text; a numeric reference beyond all characters is U+FFFD; of
equal density sums the outer element wins; very long pages are read whole, in time proportional to their length; repeated
rows give equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style textarea title xmp iframe noembed noframes")
BLOCK = names(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead title tr ul"
)
CLOSES_P = BLOCK - names("html body caption td th tr tbody thead tfoot title")
# What an element's start tag closes, and the elements that close nothing beyond themselves.
IMPLIED = {
    "li": (names("li"), names("ul ol menu")),
    "dt": (names("dt dd"), names("dl")),
    "dd": (names("dt dd"), names("dl")),
    "tr": (names("tr td th"), names("table")),
    "td": (names("td th"), names("table tr")),
    "th": (names("td th"), names("table tr")),
    "tbody": (names("tbody thead tfoot tr td th"), names("table")),
    "thead": (names("tbody thead tfoot tr td th"), names("table")),
    "tfoot": (names("tbody thead tfoot tr td th"), names("table")),
    "option": (names("option"), names("select datalist")),
}
DROPPED = names(
    "head script style noscript template nav footer aside form button select option textarea input iframe object embed svg "
    "canvas map dialog menu title"
)
DROPPED_ROLE = names("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
DROPPED_WORD = names(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification popup "
    "promo promoted promotion related recommended share sharing sidebar sidebars social sponsor sponsored subscribe "
    "subscription toolbar widget widgets"
)
ADVERT_WORD = names("ad ads advert adverts advertisement advertising adsense sponsor sponsored")
# Names that, after a dropped word, still mean the dropped thing.
PART_WORD = names(
    "area bar block box button buttons container form frame holder icon icons inner item items label left link links list outer "
    "panel posts right section slot slots stories thread top bottom unit units wrap wrapper zone"
)
STATE_WORD = names(
    "no non not without has have with is are on off in open opened close closed enable enabled disable disabled allow allowed "
    "active inactive hide hidden show layout page"
)
# Elements that hold wording rather than contain parts of a page.
WORDING = names("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption b i em strong span u small mark code a")
HEADERS = names("header")

_OPENS = re.compile(r"[a-zA-Z]")
_NAME = re.compile(r"[^\s/>]*")
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTR = re.compile(r"([^\s=>\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "named")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = False  # its class or id says that it is no part of an article


def _says(token: str, dropped: frozenset[str]) -> bool:
    """Whether a class or id names something dropped."""
    words = _WORDS.findall(_HUMP.sub("-", token).lower())
    if not words or not STATE_WORD.isdisjoint(words):
        return False
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    return words[-1] in dropped or (words[0] in dropped and all(x in dropped or x in PART_WORD for x in words[1:]))


def decoded(raw: str) -> str:
    """``raw`` with its character references decoded; numbers beyond all characters become U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", raw))
    return html.unescape(raw)


def _attributes(raw: str) -> list[tuple[str, str]]:
    """Names and values of the attributes that can name a part of a page."""
    out = []
    for name, a, b, c in _ATTR.findall(raw) if raw else ():
        if (name := name.lower()) in ("class", "id", "role"):
            out.append((name, a or b or c))
    return out


def _unwanted(tag: str, attributes: list[tuple[str, str]], inside_article: bool) -> bool:
    if tag in DROPPED or (tag in HEADERS and not inside_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(kind == "role" and value.lower().strip() in DROPPED_ROLE for kind, value in attributes)


def _named(tag: str, attributes: list[tuple[str, str]]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    dropped = ADVERT_WORD if tag in WORDING else DROPPED_WORD
    return any(kind != "role" and any(_says(x, dropped) for x in value.split()) for kind, value in attributes)


def _prune(root: Node) -> None:
    """Takes out the elements named as no part of an article."""
    order: list[Node] = []  # as the elements begin in the page
    around: list[int] = []  # articles around each of them
    todo = [(root, 0)]
    while todo:
        node, inside = todo.pop()
        order.append(node)
        around.append(inside)
        inside += node.tag in ("article", "main")
        todo.extend((x, inside) for x in reversed(node.items) if isinstance(x, Node))
    if not any(x.named for x in order):
        return
    number = {id(x): k for k, x in enumerate(order)}
    plain = [0] * len(order)  # characters outside links
    last = list(range(len(order)))  # the last element inside each
    for k in range(len(order) - 1, -1, -1):
        for x in order[k].items:
            if isinstance(x, str):
                plain[k] += len(" ".join(x.split()))
            else:
                plain[k] += plain[number[id(x)]]
                last[k] = max(last[k], last[number[id(x)]])
        if order[k].tag == "a":
            plain[k] = 0
    told, blocks = [0], [0]  # articles with text, and blocks, among the first elements
    for k, x in enumerate(order):
        told.append(told[-1] + (x.tag in ("article", "main") and plain[k] > 0))
        blocks.append(blocks[-1] + (x.tag in BLOCK))
    gone = set()
    for k, node in enumerate(order):
        end = last[k] + 1
        # a wrapper that holds most of the text stays, unless an article stands beside it
        wrapper = 2 * plain[k] > plain[0] and blocks[end] > blocks[k + 1]
        if node.named and not (wrapper and told[end] - told[k] + around[k] >= told[-1]):
            gone.add(id(node))
    for node in order:
        if any(id(x) in gone for x in node.items):
            node.items = [x for x in node.items if id(x) not in gone]


class _Open:
    """The open elements, with the heights at which each kind of element stands."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.heights: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        height = len(self.stack)
        self.stack.append(node)
        self.heights.setdefault(node.tag, []).append(height)
        if node.tag in BLOCK:
            self.blocks.append(height)

    def pop_to(self, height: int) -> None:
        while len(self.stack) > height:
            tag = self.stack.pop().tag
            self.heights[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def nearest(self, *tags: str) -> int:
        """Height of the innermost open element of ``tags``, 0 if there is none."""
        return max((self.heights[t][-1] for t in tags if self.heights.get(t)), default=0)

    def lowest_above(self, tags: frozenset[str], limit: int) -> int:
        """Height of the outermost open element of ``tags`` above ``limit``, 0 if there is none."""
        found = [at[k] for t in tags if (at := self.heights.get(t)) and (k := bisect_right(at, limit)) < len(at)]
        return min(found, default=0)

    def close(self, tag: str) -> None:
        """An end tag; those of lines do not reach out of cells, tables and articles."""
        height = self.nearest(tag)
        if height and (tag in BLOCK or self.nearest("td", "th", "table", "article", "main", "body") <= height):
            self.pop_to(height)

    def make_room(self, tag: str) -> None:
        """Closes what the start tag ``tag`` closes."""
        if tag in CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.pop_to(self.blocks[-1])
        if tag in IMPLIED:
            closed, limit = IMPLIED[tag]
            if lowest := self.lowest_above(closed, self.nearest(*limit)):
                self.pop_to(lowest)


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the ``>`` of a start tag is, -1 if there is none; values in quotes may hold any character."""
    if not quotes:
        return page.find(">", at)
    while found := _STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        at = _SPACE.match(page, found.end()).end()
        if page[at : at + 1] in ('"', "'"):
            at = page.find(page[at], at + 1) + 1
            if not at:
                return -1
    return -1


def parse(page: str) -> Node:
    """The tree of what may be part of the article, in time proportional to the page.

    Every character is looked at a bounded number of times: the scan goes from one ``<`` to the next and never back.
    Where the quotes of a tag run to the end of the page, quotes mean nothing from there on. A ``<`` after the last
    ``>`` of the page is text.
    """
    root = Node("html", None)
    open_ = _Open(root)
    stack = open_.stack
    skip = 0  # height of the stack at which an unwanted element began, or 0
    at, end, last, quotes = 0, len(page), page.rfind(">"), True

    def text(raw: str) -> None:
        if raw and not skip:
            stack[-1].items.append(decoded(raw))

    position = 0
    while 0 <= (start := page.find("<", position)):
        after = page[start + 1 : start + 2]
        closing = after == "/" and _OPENS.match(page, start + 2)
        if after in ("!", "?"):
            comment = page.startswith("<!--", start)
            stop = page.find("-->", start + 4) if comment else page.find(">", start + 2)
            text(page[at:start])
            at = position = end if stop < 0 else stop + (3 if comment else 1)
            continue
        if start > last and not closing or not (closing or _OPENS.match(after)):
            position = start + 1
            continue
        name_end = _NAME.match(page, start + 1 + bool(closing)).end()
        tag = page[start + 1 + bool(closing) : name_end].lower()
        stop = page.find(">", name_end) if closing else _tag_end(page, name_end, quotes)
        if stop < 0 and not closing:
            quotes, stop = False, page.find(">", name_end)
        text(page[at:start])
        at = position = end if stop < 0 else stop + 1
        if closing:
            open_.close(tag)
            if skip and len(stack) <= skip:
                skip = 0
            continue
        raw_attributes = page[name_end:stop]
        open_.make_room(tag)
        if skip and len(stack) <= skip:
            skip = 0
        if tag in ("html", "body") and open_.heights.get(tag):
            continue
        attributes = _attributes(raw_attributes)
        node = Node(tag, stack[-1])
        node.named = not skip and _named(tag, attributes)
        unwanted = bool(skip) or _unwanted(tag, attributes, open_.nearest("article", "main") > 0)
        if not unwanted:
            stack[-1].items.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if not unwanted and tag not in DROPPED:
                node.items.append(decoded(page[at : found.start() if found else end]))
            close = page.find(">", found.start()) if found else -1
            at = position = end if close < 0 else close + 1
            continue
        if tag in VOID or raw_attributes.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if unwanted and not skip:
            skip = len(stack)
        open_.push(node)
    text(page[at:])
    _prune(root)
    return root


def _density(c: int, tags: int, lc: int, link_tags: int, c_all: int, l_all: int) -> float:
    """Composite text density; plain characters per tag on a page without link text."""
    if not c or not l_all:
        return c / max(tags, 1)
    base = math.log(c / max(c - lc, 1) * lc + l_all / c_all * c + math.e)
    ratio = (c / max(lc, 1)) * (max(tags, 1) / max(link_tags, 1))
    return max(c / max(tags, 1) * math.log(max(ratio, 1.0) + 1e-9) / max(math.log(base + 1e-9), 1e-3), 0.0)


def _width(text: str) -> int:
    return len(" ".join(text.split()))


def _lines(items: list[Node | str], inline: set[int]) -> Iterator[tuple[int, int]]:
    """Ranges of an element's items: each block alone, neighbouring text and inline elements together."""
    start = 0
    for k, x in enumerate(items):
        if isinstance(x, Node) and id(x) not in inline:
            if start < k:
                yield start, k
            yield k, k + 1
            start = k + 1
    if start < len(items):
        yield start, len(items)


class Measured:
    """Counts, densities and density sums of all elements of a page; a line of text counts as one child."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.order: list[Node] = [root]  # parents first
        for node in self.order:
            self.order.extend(x for x in node.items if isinstance(x, Node))
        self.inline: set[int] = set()  # elements without a block in them
        for node in reversed(self.order):
            if node.tag not in BLOCK and all(isinstance(x, str) or id(x) in self.inline for x in node.items):
                self.inline.add(id(node))
            node.chars += sum(_width(x) for x in node.items if isinstance(x, str))
            if node.tag == "a":
                node.link_chars, node.link_tags = node.chars, node.tags + 1
            if node.parent is not None:
                up = node.parent
                up.chars += node.chars
                up.tags += node.tags + 1
                up.link_chars += node.link_chars
                up.link_tags += node.link_tags
        self.page = (max(root.chars, 1), root.link_chars)
        for node in self.order:
            node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, *self.page)
        for node in self.order:
            node.total = sum(self.line(node.items[lo:hi])[0] for lo, hi in _lines(node.items, self.inline))

    def line(self, items: list[Node | str]) -> tuple[float, int, int]:
        """Density, characters and characters in links of a block or of a line."""
        if isinstance(items[0], Node) and id(items[0]) not in self.inline:
            return items[0].density, items[0].chars, items[0].link_chars
        nodes = [x for x in items if isinstance(x, Node)]
        c = _width("".join(x for x in items if isinstance(x, str))) + sum(x.chars for x in nodes)
        lc = sum(x.link_chars for x in nodes)
        return _density(c, sum(x.tags + 1 for x in nodes), lc, sum(x.link_tags for x in nodes), *self.page), c, lc


def _chosen(page: Measured) -> list[Node | str | None]:
    """What makes up the main text, in page order."""
    root, inline = page.root, page.inline
    # of equal sums the first, which is the outer one; a line is taken whole
    core = max((x for x in page.order if id(x) not in inline), key=lambda x: x.total, default=root)
    if not core.total or core is root:
        return [root]
    path, at = [], core
    while at is not None:
        path.append(at)
        at = at.parent
    best: dict[int, Node] = {}  # the subtree with the largest sum, of equal ones the outer
    for node in reversed(page.order):
        if id(node) not in inline:
            inside = (best[id(x)] for x in node.items if isinstance(x, Node) and id(x) not in inline)
            best[id(node)] = max([node, *inside], key=lambda x: x.total)
    below = [x for x in path if x is not root] if any(x.tag == "body" for x in path) else path
    threshold = min(x.density for x in below)
    marked, taken = {id(core)}, set()  # elements, and single items of other elements
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if id(node) in marked or node is not root and (not node.chars or node.density < threshold):
            continue
        densest = best[id(node)]
        if 2 * densest.link_chars < densest.chars:
            marked.add(id(densest))
        if id(node) in marked:
            continue
        for lo, hi in _lines(node.items, inline):
            line = node.items[lo:hi]
            if isinstance(line[0], Node) and id(line[0]) not in inline:
                todo.append(line[0])
                continue
            density, c, lc = page.line(line)
            if c and 2 * lc < c and density >= threshold:
                taken.update((id(node), k) for k in range(lo, hi))
    picked: list[Node | str | None] = []  # None ends a line
    walk: list[tuple[Node | str | None, bool]] = [(root, False)]
    while walk:
        x, whole = walk.pop()
        if whole or x is None or id(x) in marked:
            picked.append(x)
        elif isinstance(x, Node):
            ends = [(None, True)] if x.tag in BLOCK else []
            inside = [(y, (id(x), k) in taken) for k, y in enumerate(x.items)]
            walk.extend([*ends, *((y, whole) for y, whole in reversed(inside) if whole or isinstance(y, Node)), *ends])
    return picked


def _blocks(nodes: list[Node | str | None]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            out.append(line)
        run.clear()

    todo: list[tuple[Node | str | None, bool]] = [(x, False) for x in reversed(nodes)]
    while todo:
        item, closing = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif closing:
            flush()
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                todo.append((item, True))
            todo.extend((x, False) for x in reversed(item.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    measured = Measured(parse(page))
    return "\n".join(_blocks(_chosen(measured))) if measured.root.chars else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
