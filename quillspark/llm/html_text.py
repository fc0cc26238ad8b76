"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density, and an element that says it is an
article starts with some. The container with the most points is the best; as long as what holds it adds prose and few links, that is
taken instead. It is kept with those of its siblings that are prose, lists or headings and hardly linked, whatever their points, and
its text is read block by block.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_array

SCHEMA = "page_id long, url string, text string, n_chars long"
_NAME = re.compile(r"/?([a-zA-Z][^\s<>/]*+)")
#: What follows a tag's name, up to the end of the tag or the next tag; nothing is looked at twice.
_REST = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
_STOP = re.compile(r"[<>]")
_ATTRIBUTE = re.compile(r"""(?:"[^"]*+"|'[^']*+')|([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORTH = re.compile("class|id|role|hidden", re.IGNORECASE)
#: Elements of HTML by what they mean here.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option dialog menu object canvas audio video label fieldset svg template noscript annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SCOPES = frozenset("ul ol dl table article section div main body html td th blockquote aside nav footer header form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table figure figcaption".split())
#: Points that an article starts with, link density of what is prose, and the points, as a share of the best container's, that make
#: what holds it the container.
ARTICLE, LINKED, HOLDS = 5.0, 0.25, 0.2
CONTENT = frozenset("div p article section body nav main header h1 h2".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article body main figcaption".split())
CONTAINERS = frozenset("div section article body main td".split())
#: A class, id or role that is one of these words, alone or with the words after it, is not the article.
_MARKED = r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|sidebars?|side-?bar|menus?|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|top-?bar|tool-?bar|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|login|comments?|disqus|respond|replies|pagination|pager|contentinfo|complementary|shar(?:e|ing)|social)"
_AFTER = r"(?:[-_]{1,2}(?:box|banner|bar|block|slot|unit|container|wrapper|wrap|section|area|list|links?|item|items|left|right|top|bottom|main|primary|secondary|form|buttons?|policy|notice|thread|inner|outer|\d+))*"
UNWANTED = re.compile(_MARKED + _AFTER)
#: The same outside an article only.
UNWANTED_OUTSIDE = re.compile(r"(?:related|recommended|search|skip|alert|overlay|widgets?)(?:-posts|-links|-articles|-content)?" + _AFTER)


class Node:
    __slots__ = ("tag", "parent", "dropped", "in_link", "inside", "block", "parts", "score", "chars", "commas", "linked", "own")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped, self.parts = tag, parent, dropped, []
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.inside = tag in ("article", "main") or parent is not None and parent.inside  # an article
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.score, self.chars, self.commas, self.linked, self.own = 0.0, 0, 0, 0, None


def _unwanted(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":  # a page's, not an article's
        return not parent.inside
    if tag in ("body", "html", "article", "main") or not _WORTH.search(attributes):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                if UNWANTED.fullmatch(word) or not parent.inside and UNWANTED_OUTSIDE.fullmatch(word):
                    return True
    return False


class _Stack:
    """The open elements, and by scope how many of each name are open in it: no end tag searches for its element in vain."""

    def __init__(self, root: Node) -> None:
        self.open, self.scopes, self.all = [root], [(root, {})], {}

    @property
    def top(self) -> Node:
        return self.open[-1]

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.all[node.tag] = self.all.get(node.tag, 0) + 1
        if node.tag in SCOPES:
            self.scopes.append((node, {}))
        else:
            held = self.scopes[-1][1]
            held[node.tag] = held.get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.open.pop()
        self.all[node.tag] -= 1
        if node.tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][1][node.tag] -= 1
        return node

    def close(self, *names: str) -> None:
        """Close up to the nearest of these in the scope, if one is open there."""
        held = self.scopes[-1][1]
        if any(held.get(n) for n in names):
            while self.pop().tag not in names:
                pass

    def close_scope(self, *names: str) -> None:
        """Close the scope that all stands in, if it is one of these."""
        node = self.scopes[-1][0]
        if node.tag in names:
            while self.pop() is not node:
                pass

    def end(self, name: str) -> None:
        if name not in SCOPES:  # a stray end tag does not close what it stands in
            self.close(name)
        elif self.all.get(name):
            while self.pop().tag != name:
                pass

    def before(self, name: str) -> None:
        """What a start tag closes."""
        if name in ENDS_P:
            self.close("p")
        if name == "li":
            self.close("li")
        elif name in ("dt", "dd"):
            self.close("dt", "dd")
        elif name == "option":
            self.close("option")
        elif name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            self.close_scope("td", "th")
            if name not in ("td", "th"):
                self.close("tr")
            if name in ("tbody", "thead", "tfoot"):
                self.close("tbody", "thead", "tfoot")
        if name in CONTENT:
            self.close("head")


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all nodes in page order; a node's parts are texts and nodes. One pass, in time linear in the page.

    A tag that the page's end cuts off is dropped with what is in it; one that the next tag cuts off is dropped.
    """
    root = Node("html", None, False)
    nodes, stack, at, size = [root], _Stack(root), 0, len(page)

    def text(a: int, b: int) -> None:
        top = stack.top
        if b > a and not top.dropped:
            top.parts.append(entities.unescape(page[a:b]))

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(at, size)
            break
        name = _NAME.match(page, start + 1)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < size:
                text(at, start)
                opened, closed = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], start)), ("<", ">"))
                end = page.find(closed, start + len(opened))
                at = end + len(closed) if end >= 0 else size
            else:  # a sign, not a tag
                text(at, start + 1)
                at = start + 1
            continue
        text(at, start)
        end = _REST.match(page, name.end()).end()
        if end < size and page[end] in "\"'":  # a quote that nothing ends
            stop = _STOP.search(page, name.end())
            end = stop.start() if stop else size
        if end >= size or page[end] == "<":
            at = end
            continue
        at = end + 1
        tag = name[1].lower()
        if page[start + 1] == "/":
            stack.end(tag)
            continue
        if tag == "html" and len(nodes) < 4:
            continue
        attributes = page[name.end() : end]
        stack.before(tag)
        top = stack.top
        node = Node(tag, top, top.dropped or _unwanted(tag, attributes, top))
        top.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            found = _ENDS[tag].search(page, at)
            at = found.end() if found else size
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "math")):
            stack.push(node)
    return root, nodes


_ENDS = {name: re.compile(f"</{name}[^>]*+>", re.IGNORECASE) for name in RAW}


def _weigh(nodes: list[Node]) -> None:
    """Points of every node; a paragraph's own text counts, not that of blocks inside it."""
    blocks = []
    for node in nodes:
        if node.dropped:
            continue
        said = [p for p in node.parts if isinstance(p, str)]
        chars = sum(len(p.strip()) for p in said)
        if not chars:
            continue
        linked = chars if node.in_link else 0
        node.chars += chars
        node.linked += linked
        block = node.block
        if block.own is None:
            block.own = [0, 0, 0]
            blocks.append(block)
        block.own[0] += chars
        block.own[1] += sum(p.count(",") + p.count("，") + p.count("、") for p in said)
        block.own[2] += linked
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for block in blocks:
        chars, commas, linked = block.own
        if chars < 25 or block.tag not in PARAGRAPHS or linked > 0.5 * chars:
            continue
        points = 1 + commas + min(chars // 100, 3)
        share, up = 1.0, block if block.tag in CONTAINERS else block.parent
        for level in range(3):
            if up is None:
                break
            up.score += points * share
            share = 0.5 if level == 0 else share / 3
            up = up.parent
    for node in nodes:
        if node.tag in ("article", "main") and node.chars and not node.dropped:
            node.score += ARTICLE


def _holds_more(best: Node, density: Callable[[Node], float]) -> bool:
    """Whether the element around the best container is the container: it has hardly any links, and beyond what the best one has
    passed on to it points of its own, or of others inside it."""
    up = best.parent
    return up is not None and up.tag in CONTAINERS - {"body", "td"} and density(up) < LINKED and up.score - 0.5 * best.score >= HOLDS * best.score


def _prose(n: Node, density: float) -> bool:
    """Whether a sibling of the container belongs to the text: a heading without links, a list or a short text with few, or a
    container whose own paragraphs have points."""
    if n.tag in HEADINGS:
        return not n.linked
    if not n.chars or density >= LINKED:
        return False
    return n.tag == "p" or n.tag in LISTS or n.tag in PARAGRAPHS and n.score > 0


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by a line feed; empty if there is none."""
    if not page:
        return ""
    root, nodes = parse(page)
    _weigh(nodes)
    density = lambda n: n.linked / n.chars if n.chars else 0.0
    points = lambda n: n.score * (1 - density(n))
    live = [n for n in nodes if not n.dropped and n.score > 0]
    best = max(live, key=points) if live else root  # no points at all: all there is
    while _holds_more(best, density):
        best = best.parent
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * points(best))
        kept = [n for n in best.parent.parts if isinstance(n, Node) and (n is best or not n.dropped and (points(n) >= least or _prose(n, density(n))))]
    blocks: list[str] = []
    for n in kept:
        _read(n, blocks)
    return "\n".join(blocks)


def _read(top: Node, blocks: list[str]) -> None:
    """Append the blocks of text under a node, in page order; not recursive, as trees can be very deep."""
    line: list[str] = []

    def flush() -> None:
        said = " ".join("".join(line).split())
        line.clear()
        if said:
            blocks.append(said)

    todo: list = [top]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif not part.dropped:
            if part.tag == "br":
                line.append(" ")
            elif part.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(part.parts)
    flush()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html; one pass, no shuffle.

    Elements whose whole class, id or role marks them as advert, menu, notice, sidebar or comments are dropped wherever they are,
    paragraphs and headings too; formulas and captions stay. So are forms, those around a whole page among them, and what is
    shown only without scripts. Malformed and very deep pages are read in linear time.
    A null or empty html has an empty text; a null page_id or url stays null; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.record_batch([as_array(part.column("page_id")), as_array(part.column("url")), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
