"""Semantic paper HTML to rows: typed blocks, bibliography, images and links.

A small tree is built by the standard library's parser inside Arrow-batched functions; only flat rows leave them. One document
is held at a time. Columns read: doc_id, html (a null html gives no rows).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.protect import translation_text
from quillspark.functions.text import DISPLAYED, INLINE, SEARCH_PAGES
from quillspark.operators.tables import fold_header, header_rows, to_markdown
from quillspark.shared import spread

META = ("html_id", "section", "label", "src", "local_src", "caption", "table_md", "listing_md", "listing_raw", "text_box_md")
BLOCKS = "doc_id string, block_idx int, kind string, level int, text string, raw string, " + ", ".join(f"{m} string" for m in META)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: Elements that stand in lines of their own, those whose text is not shown, and containers that get a number.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul document".split())
HIDDEN_TAGS = frozenset("script style head title template".split())
NUMBERED = frozenset("p h1 h2 h3 h4 h5 h6 li table figure blockquote".split())
#: What a start tag closes, and where the search for it ends.
ENDS_P = BLOCK_TAGS - frozenset("td th tr tbody thead tfoot body html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
BARRIERS = {"li": frozenset("ul ol".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "p": frozenset("td th table foreignobject object button caption li".split())}


NO_CLASSES: frozenset[str] = frozenset()


class Element:
    """An element; of a numbered tree (see numbered) also its place in page order, where its inside ends, and the page's index."""

    __slots__ = ("tag", "attrs", "children", "parent", "classes", "holds_block", "number", "at", "till", "index")

    def __init__(self, tag: str, attrs: dict, parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        named = attrs.get("class")
        self.classes = frozenset(named.split()) if named else NO_CLASSES
        self.holds_block, self.number, self.index = False, "", None

    def walk(self) -> Iterable[Element]:
        return self._walked() if self.index is None else self.index.nodes[self.at : self.till]

    def _walked(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Element)]

    def all(self, *classes: str, tag: str | None = None) -> Iterator[Element]:
        """Elements inside, in page order, of that tag and of at least one of the classes."""
        if self.index is None:
            return (n for n in self.walk() if n is not self and (tag is None or n.tag == tag) and (not classes or not n.classes.isdisjoint(classes)))
        if not classes:
            return iter(self.index.inside(self, self.index.tags.get(tag, ())) if tag else self.index.nodes[self.at + 1 : self.till])
        if len(classes) == 1:
            found = self.index.inside(self, self.index.classes.get(classes[0], ()))
        else:
            found = sorted({n.at: n for c in classes for n in self.index.inside(self, self.index.classes.get(c, ()))}.values(), key=lambda n: n.at)
        return (n for n in found if tag is None or n.tag == tag)

    def first(self, *classes: str, tag: str | None = None) -> Element | None:
        return next(self.all(*classes, tag=tag), None)

    def direct(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self) -> str:
        return folded(self)


class Index:
    """The elements of a page in page order, all of them, by tag and by class: what is inside an element is a slice of each list."""

    def __init__(self, root: Element) -> None:
        self.nodes: list[Element] = list(root._walked())
        self.tags: dict[str, list[Element]] = {}
        self.classes: dict[str, list[Element]] = {}
        for i, node in enumerate(self.nodes):
            node.at, node.till, node.index = i, i + 1, self
            self.tags.setdefault(node.tag, []).append(node)
            for c in node.classes:
                self.classes.setdefault(c, []).append(node)
        for node in reversed(self.nodes):
            if node.parent is not None and node.parent.till < node.till:
                node.parent.till = node.till

    @staticmethod
    def inside(node: Element, found: list[Element]) -> list[Element]:
        if not found:
            return []
        begin = bisect_left(found, node.at + 1, key=_place)
        return found[begin : bisect_left(found, node.till, begin, key=_place)]


def _place(node: Element) -> int:
    return node.at


def folded(node: Element | str, text: Callable[[str], str] = str, begin: Callable[[Element], str | None] = lambda n: None, end: Callable[[Element, str], str] = lambda n, inner: inner) -> str:
    """A string made bottom-up without recursion, however deep the tree: of a text, of an element that begin answers for at
    once, and else of an element and what its children have given, joined."""
    if isinstance(node, str):
        return text(node)
    frames: list[tuple[Element, Iterator, list[str]]] = [(node, iter(node.children), [])]
    while True:
        top, children, parts = frames[-1]
        for c in children:
            told = text(c) if isinstance(c, str) else begin(c)
            if told is None:
                frames.append((c, iter(c.children), []))
                break
            parts.append(told)
        else:
            frames.pop()
            if not frames:
                return "".join(parts)
            frames[-1][2].append(end(top, "".join(parts)))


#: A start tag whose values stand in double quotes and hold no reference, one of its attributes, an end tag; and
#: elements whose text may be read otherwise, which are left to the parser.
PLAIN_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_:.-]*=\"[^\"&]*\")*)[ \t\n\r\f]*>")
PLAIN_ATTRIBUTE, PLAIN_END = re.compile(r"([a-zA-Z][a-zA-Z0-9_:.-]*)=\"([^\"]*)\""), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
RAW_TEXT = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())


class _Builder(HTMLParser):
    """Paragraphs, list items and cells end where HTML says; other elements where the page says; a stray end tag is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("document", {}, None)
        self.open: dict[str, int] = {}
        self.written = ""

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not asked for here."""
        return j

    def parse_starttag(self, i: int) -> int:
        """Tags as most pages have them are read at once; the parser's own way does all others."""
        plain = PLAIN_TAG.match(self.rawdata, i)
        tag = plain[1].lower() if plain else ""
        if plain is None or tag in RAW_TEXT:
            self.written = ""
            return super().parse_starttag(i)
        self.lasttag, self.written = tag, plain[0]
        self.handle_starttag(tag, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(plain[2])] if plain[2] else [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def get_starttag_text(self) -> str | None:
        return self.written or super().get_starttag_text()

    def shut(self, names: tuple[str, ...], barriers: frozenset[str] = frozenset()) -> None:
        """Close up to the nearest of these that no barrier hides."""
        node, held = self.top, self.open
        if held.get(names[0]) or len(names) > 1 and any(held.get(n) for n in names):
            while node is not self.root and node.tag not in names and node.tag not in barriers:
                node = node.parent
            if node.tag in names:
                while self.top is not node.parent:
                    self.open[self.top.tag] -= 1
                    self.top = self.top.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.open.get("p"):
            self.shut(("p",), BARRIERS["p"])
        if tag in CLOSES:
            self.shut(CLOSES[tag], BARRIERS.get(tag, frozenset(["table"])))
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.top)
        self.top.children.append(node)
        if tag in BLOCK_TAGS:
            up = self.top
            while up is not None and not up.holds_block:
                up.holds_block, up = True, up.parent
        if tag not in VOID:
            self.top = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open[tag] -= 1
            self.top = self.top.parent

    def handle_endtag(self, tag):
        self.shut((tag,))

    def finish(self) -> None:
        super().close()

    def handle_data(self, data):
        if self.top.tag not in ("script", "style"):
            self.top.children.append(data)


def tree(html: str) -> Element:
    """The page as a tree; outermost paragraphs, headings, list items, tables, figures and quotes are numbered zh-1, zh-2, ...
    in page order, and all that is inside one has its number."""
    builder = _Builder()
    builder.feed(html or "")
    builder.finish()
    return numbered(builder.root)


def numbered(root: Element) -> Element:
    n = 0
    for node in Index(root).nodes:
        if node.parent is not None and node.parent.number:
            node.number = node.parent.number
        elif node.tag in NUMBERED:
            n += 1
            node.number = f"zh-{n}"
    return root


def tex_of(math: Element) -> str:
    note = next((n for n in math.walk() if n.tag == "annotation" and n.attrs.get("encoding") == "application/x-tex"), None)
    return re.sub(r"^\s*\\displaystyle\s*", "", (note.text() if note else math.attrs.get("alttext", "")).strip())


def bibliography(root: Element) -> dict[str, str]:
    """Title by anchor: the last block without an address and a year, else the last one."""
    out = {}
    for item in root.all("ltx_bibitem", tag="li"):
        key = item.attrs.get("id", "")
        blocks = [b for b in (" ".join(x.text().split()) for x in item.all("ltx_bibblock")) if b and "http" not in b]
        if key.startswith("bib.") and blocks:
            plain = [b for b in blocks if not re.search(r"\b(?:19|20)\d{2}\b", b)]
            out["#" + key] = (plain or blocks)[-1].strip(". ")
    return out


def _footnote(node: Element) -> str:
    mark = node.first("ltx_note_mark")
    return f"[{mark.text().strip()}]" if mark else ""


def plain_text(node: Element | str, wrap: bool = False) -> str:
    """Text with formulas as TeX, in dollars if wrapped."""

    def begin(n: Element) -> str | None:
        if n.tag == "math":
            tex = tex_of(n)
            return f"${tex}$" if wrap and tex else tex
        return _footnote(n) if "ltx_role_footnote" in n.classes else None

    def end(n: Element, inner: str) -> str:
        if n.tag in ("sub", "sup"):
            sign = "_" if n.tag == "sub" else "^"
            return f"${sign}{{{inner}}}$" if wrap else f"{sign}{{{inner}}}"
        return inner

    return folded(node, begin=begin, end=end)


#: The last steps of rich text, in this order: (pattern, replacement).
RICH_STEPS = (
    (re.compile(r"[ \t]+\n"), "\n"), (re.compile(r"\n{2,}"), "\n"), (re.compile(r" +"), " "),
    (re.compile(r"\*\*([A-Za-z0-9_]{1,3})\*\*\$([\\_{}^\{][^$\n]+?)\$"), r"**$\1\2$**"),
)
#: The steps after the second of these that the literal reading has; they also put spaces inside formulas.
LITERAL_STEPS = ((re.compile(r"\s*\$(\s|\$)"), r" $\1"), (re.compile(r"(\$|\s)\$\s*"), r"\1$ "))
#: Commands that only displayed formulas have.
_DISPLAYED = re.compile(DISPLAYED)


def rich_text(node: Element, bib: dict[str, str], engine: str = "bing", mode: str = "short", literal: bool = False) -> str:
    """Markdown of an inline fragment; literal: with the spacing of formulas as it was coded, not as it was meant."""
    from urllib.parse import quote

    def begin(n: Element) -> str | None:
        if "ltx_role_footnote" in n.classes:
            return _footnote(n)
        if n.tag == "math":
            tex = tex_of(n)
            shown = n.attrs.get("display") == "block" and not (len(tex) <= INLINE and not _DISPLAYED.search(tex))
            return (f"$${tex}$$" if shown else f"${tex}$") if tex else ""
        return "\n" if n.tag == "br" else None

    def end(n: Element, inner: str) -> str:
        href = n.attrs.get("href", "")
        if n.tag == "a" and href.startswith("#bib"):
            title = re.sub(r",\s*\d{4}[a-z]?\s*$", "", n.attrs.get("title") or bib.get(href, ""))
            name = title if mode == "title" and title else inner.strip()
            page = SEARCH_PAGES.get(engine, SEARCH_PAGES["bing"]) + quote(title or inner.strip())
            return f'[{name}]({page} "{title}")' if title else f"[{name}]({page})"
        if n.tag == "a" and href:
            return f"[{inner.strip()}]({href})"
        if n.tag in ("sub", "sup"):
            return f"${'_' if n.tag == 'sub' else '^'}{{{inner.strip()}}}$"
        if inner.strip() and (n.tag in ("b", "strong") or "ltx_font_bold" in n.classes):
            return f"**{inner.strip()}**"
        if inner.strip() and (n.tag in ("em", "i") or "ltx_font_italic" in n.classes):
            return f"*{inner.strip()}*"
        return f"\n{inner}\n" if n.tag in ("p", "div", "li", "tr") else inner

    out = folded(node, lambda t: re.sub(r"\s+", " ", t), begin, end)
    for pattern, by in (*RICH_STEPS[:2], *(LITERAL_STEPS if literal else ()), *RICH_STEPS[2:]):
        out = pattern.sub(by, out)
    return out.strip()


def _absolute(src: str, base: str) -> str:
    return src if src.startswith("http") else f"https://arxiv.org{src}" if src.startswith("/") else base + src


class _Walk:
    """Blocks of one document, in order."""

    def __init__(self, root: Element, base: str) -> None:
        self.base, self.bib, self.rows = base, bibliography(root), []

    def add(self, kind: str, text: str, raw: str, level: int = 0, node: Element | None = None, **meta: str) -> None:
        if node is not None and (node.number or node.attrs.get("id")):
            meta.setdefault("html_id", node.number or node.attrs["id"])
        self.rows.append({"kind": kind, "level": level, "text": text, "raw": raw, **meta})

    def said(self, node: Element) -> str:
        return " ".join(translation_text(plain_text(node, True)).split())

    def prose(self, node: Element, kind: str = "paragraph", before: str = "", **meta: str) -> None:
        text = self.said(node)
        if text:
            self.add(kind, text, before + rich_text(node, self.bib), node=node, **meta)

    def document(self, root: Element) -> None:
        title = root.first("ltx_title_document")
        if title:
            self.add("title", self.said(title), rich_text(title, self.bib), 1, title)
        abstract = root.first("ltx_abstract")
        if abstract:
            head = abstract.first("ltx_title_abstract")
            if head:
                self.add("heading", self.said(head), rich_text(head, self.bib), 2, head)
            for p in abstract.direct():
                if "ltx_p" in p.classes:
                    self.prose(p, section="abstract")
        words = root.first("ltx_keywords")
        if words:
            self.prose(words, before="**Keywords** ")
        body = root.first(tag="article") or root.first("ltx_page_content") or root.first(tag="body") or root
        for part in body.direct():
            if part.tag == "section" and "ltx_section" in part.classes:
                self.section(part, 2, "ltx_title_section")

    def section(self, part: Element, level: int, name: str) -> None:
        head = next((c for c in part.direct() if name in c.classes), None)
        if head:
            self.add("heading", self.said(head), rich_text(head, self.bib), level, head)
        for c in part.direct():
            if "ltx_subsection" in c.classes:
                self.section(c, 3, "ltx_title_subsection")
            elif "ltx_subsubsection" in c.classes:
                self.section(c, 4, "ltx_title_subsubsection")
            else:
                self.parts(c)

    def parts(self, c: Element) -> None:
        """What an element holds, in order and at any depth."""
        todo = [(c, 0)]
        while todo:
            node, depth = todo.pop()
            todo += [(x, depth + 1) for x in reversed(self.part(node, depth))]

    def part(self, c: Element, depth: int) -> list[Element]:
        """Blocks of one element, or what is to be looked at in its place."""
        k = c.classes
        if "ltx_equation" in k or "ltx_equationgroup" in k:
            if depth or "ltx_equation" in k:
                self.equation(c)
        elif "ltx_itemize" in k or "ltx_enumerate" in k:
            for item in c.direct():
                if "ltx_item" in item.classes:
                    for p in item.all("ltx_p"):
                        self.prose(p, "list_item", "- ")
        elif "ltx_inline-block" in k:
            lines = [(self.said(p), rich_text(p, self.bib)) for p in c.all("ltx_p")]
            lines = [x for x in lines if x[0]]
            if lines:
                raw = "\n".join("> " + r for _, r in lines)
                self.add("text_box", "\n".join(t for t, _ in lines), raw, node=c, text_box_md=raw)
        elif "ltx_algorithm" in k or "ltx_listing" in k:
            self.listing(c)
        elif c.tag == "figure" and "ltx_table" in k or "ltx_tabular" in k:
            self.table(c)
        elif c.tag == "figure":
            self.figure(c)
        elif "ltx_p" in k or c.tag == "p":
            box = c.first("ltx_inline-block")
            if box:
                return [box]
            self.prose(c)
        elif k & {"ltx_para", "ltx_logical-block", "ltx_paragraph"} or c.tag in ("div", "section") and depth:
            for h in c.direct():
                if "ltx_title_paragraph" in h.classes:
                    self.add("heading", self.said(h), rich_text(h, self.bib), 4, h)
            return [x for x in c.direct() if "ltx_title_paragraph" not in x.classes]
        return []

    def equation(self, c: Element) -> None:
        if "ltx_equationgroup" in c.classes:
            rows = [" & ".join(t for t in (" ".join(map(tex_of, d.all(tag="math"))) for d in r.all("ltx_eqn_cell") if not d.classes & {"ltx_eqn_center_padleft", "ltx_eqn_center_padright"}) if t) for r in c.all("ltx_equation", tag="tr")]
            rows = [r for r in rows if r]
            tex = "\\begin{aligned}\n" + " \\\\\n".join(rows) + "\n\\end{aligned}" if rows else ""
        else:
            tex = " ".join(filter(None, map(tex_of, c.all(tag="math"))))
        label = c.first("ltx_tag_equation")
        name = label.text().strip() if label else ""
        if tex:
            self.add("equation", tex, f"$$\n{tex}\n$$\n{name}", node=c, label=name)

    def caption(self, c: Element) -> tuple[str, str]:
        note = c.first("ltx_caption")
        return (self.said(note), " ".join(rich_text(note, self.bib).split())) if note else ("", "")

    def figure(self, c: Element) -> None:
        image, held = c.first(tag="img"), c.first(tag="object")
        src = image.attrs.get("src", "") if image else held.attrs.get("data", "") if held else ""
        text, raw = self.caption(c)
        src = _absolute(src, self.base) if src else ""
        self.add("figure", text, f"![]({src})\n> {raw}" if raw else f"![]({src})", node=c, src=src, caption=text)

    def listing(self, c: Element) -> None:
        rows = []
        for line in c.all("ltx_listingline"):
            tag = line.first("ltx_tag_listingline")
            number = tag.text().strip() if tag else ""
            text = plain_text(line, True).strip()
            text = text.removeprefix(number).strip() if number else text
            named = re.match(r"^([A-Za-z][A-Za-z ]*?):\s*(.*)$", text) if not number else None
            rows.append((named[1], named[2]) if named and len(named[1]) <= 12 else (number, text))
        text, raw = self.caption(c)
        table = to_markdown(["\u200b", "\u200b"], [[a, b.replace("|", "\\|")] for a, b in rows])
        self.add("listing", text, f"{table}\n> {raw}" if raw else table, node=c, listing_md=table, listing_raw="\n".join(b for _, b in rows), caption=text)

    def table(self, c: Element) -> None:
        rows = []
        for r in c.all(tag="tr"):
            head = "ltx_thead" in r.classes or "ltx_row_header" in r.classes or r.parent is not None and "ltx_thead" in r.parent.classes
            cells = [d for d in r.direct() if d.tag in ("td", "th")]
            rows.append([{"text": self.cell(d), "colspan": _span(d, "colspan"), "rowspan": _span(d, "rowspan"), "is_header": head} for d in cells])
        rows = [r for r in rows if r]
        text, raw = self.caption(c)
        if any(x["colspan"] > 1 or x["rowspan"] > 1 for r in rows for x in r):
            table = _outer(c.first(tag="table") or c) + "\n"
        elif rows:
            width = max(map(len, rows))
            grid = [[x["text"] for x in r] + [""] * (width - len(r)) for r in rows]
            table = to_markdown(*fold_header(grid, header_rows(rows)))
        else:
            table = "(表格)"
        self.add("table", f"{text}\n{table}", f"{table}\n> {raw}" if raw else table, node=c, table_md=table, caption=text)

    def cell(self, d: Element) -> str:
        lines = (x.strip().replace("\u00a0", " ") for x in rich_text(d, self.bib).split("\n"))
        text = "<br>".join(filter(None, lines)).replace("|", "\\|")
        for pattern, by in CELL_STEPS:
            text = pattern.sub(by, text)
        return text


#: The last steps of a cell's text, in this order: (pattern, replacement).
CELL_STEPS = (
    (re.compile(r"\$([^$\n|]+?)\$\*\*"), r"$ \1$ **"), (re.compile(r"\*\*\$([^$\n|]+?)\$"), r"** $ \1$"),
    (re.compile(r"[ \t]{2,}"), " "), (re.compile(r"\*\*([^*\n|]+?)\*\*"), r"<strong>\1</strong>"),
)


def _span(d: Element, name: str) -> int:
    return int(d.attrs[name]) if d.attrs.get(name, "").strip().isdigit() else 1


def _outer(node: Element | str) -> str:
    """The element as HTML."""
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def end(n: Element, inner: str) -> str:
        attrs = "".join(f' {k}="{escaped(v).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
        return f"<{n.tag}{attrs}>" + ("" if n.tag in VOID else f"{inner}</{n.tag}>")

    return escaped(node) if isinstance(node, str) else end(node, folded(node, escaped, end=end))


def _everything(walk: _Walk, root: Element) -> None:
    """Every text of a page once, in order: what stands in a line between two blocks is one block, of the kind of what holds it."""

    def flush(holder: Element, line: list) -> None:
        if line:
            part = Element("span", {}, None)
            part.children, part.number = list(line), holder.number
            said = walk.said(part)
            if said and holder.tag in HEADINGS:
                walk.add("heading", said, rich_text(part, {}), int(holder.tag[1]), part)
            elif said:
                item = holder.tag == "li"
                walk.add("list_item" if item else "paragraph", said, ("- " if item else "") + rich_text(part, {}), node=part)
            line.clear()

    todo: list[tuple[Element, Iterator, list]] = [(root, iter(root.children), [])]
    while todo:
        holder, children, line = todo[-1]
        for c in children:
            if isinstance(c, str) or c.tag not in BLOCK_TAGS and not c.holds_block:
                if isinstance(c, str) or c.tag not in HIDDEN_TAGS:
                    line.append(c)
            elif c.tag not in HIDDEN_TAGS:
                flush(holder, line)
                todo.append((c if c.tag in BLOCK_TAGS else _as(holder, c), iter(c.children), []))
                break
        else:
            flush(holder, line)
            todo.pop()


def _as(holder: Element, inner: Element) -> Element:
    """An element in a line that holds blocks counts as what it stands in."""
    out = Element(holder.tag, {}, None)
    out.number = inner.number or holder.number
    return out


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def blocks_of(html: str, base: str = "") -> list[dict]:
    """Typed blocks of a paper; of any other page its headings, list items and all other text as paragraphs."""
    root = tree(html)
    walk = _Walk(root, base)
    walk.document(root)
    if not walk.rows:
        _everything(walk, root)
    return walk.rows


def _rows(pages: DataFrame, make: Callable[[str], list[dict]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                columns: dict[str, list] = {n: [] for n in names}
                for doc, html in zip(*(batch.slice(a, 256).column(c).to_pylist() for c in ("doc_id", "html"))):
                    for row in make(html) if html else []:
                        for n in names:
                            columns[n].append(doc if n == "doc_id" else row.get(n))
                yield pa.record_batch([pa.array(columns[n], fields.field(n).type) for n in names], schema=fields)

    return spread(pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html"), "doc_id", "html").mapInArrow(run, schema)


def with_local_images(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """blocks with local_src from files (doc_id, src, local): where an image has been stored, else where it is."""
    told = files.select("doc_id", "src", F.col("local").alias("_local"))
    return blocks.join(told, ["doc_id", "src"], "left").withColumn("local_src", F.coalesce("_local", "src")).select(*blocks.columns)


def parse_blocks(pages: DataFrame, base: str = "") -> DataFrame:
    return _rows(pages, lambda h: [{"block_idx": i, **r} for i, r in enumerate(blocks_of(h, base))], BLOCKS)


def parse_bibliography(pages: DataFrame) -> DataFrame:
    return _rows(pages, lambda h: [{"anchor": a, "title": t} for a, t in bibliography(tree(h)).items()], "doc_id string, anchor string, title string")


def images(pages: DataFrame, base: str = "https://arxiv.org/html/") -> DataFrame:
    """Images and then objects of each page: ord, src, url, name."""

    def make(html: str) -> list[dict]:
        root = tree(html)
        found = [n.attrs.get("src", "") for n in root.all(tag="img")] + [n.attrs.get("data", "") for n in root.all(tag="object")]
        return [{"ord": i, "src": s} for i, s in enumerate(s for s in found if s and not s.startswith("data:"))]

    from quillspark.functions.text import absolute_url, last_segment

    rows = _rows(pages, make, "doc_id string, ord int, src string").withColumn("url", absolute_url(F.col("src"), F.lit(base)))
    return rows.withColumn("name", last_segment(F.col("url"))).where("name <> ''")


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of the first table of each page: r, cells (their texts, every piece of text trimmed)."""

    def words(node: Element) -> str:
        return folded(node, str.strip)

    def make(html: str) -> list[dict]:
        table = tree(html).first(tag="table")
        found = [[words(c) for c in row.walk() if c.tag in ("td", "th")] for row in table.all(tag="tr")] if table else []
        return [{"r": i, "cells": cells} for i, cells in enumerate(found) if cells]

    return _rows(pages, make, "doc_id string, r int, cells array<string>")


def latest_versions(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Where to read each paper: paper (as asked for), url, base.

    Of the links in pages (doc_id: a paper without its version, html: its abstract's page) to a version of that paper the one
    with the highest number; without any, and for papers without a page, what was asked for.
    """
    from quillspark.functions.text import PAPERS, without_version

    site = PAPERS.removesuffix("/html/")
    number = F.regexp_extract("href", r"v(\d+)$", 1)
    found = links(pages).where((number != "") & F.contains("href", F.concat(F.lit("/html/"), "doc_id", F.lit("v"))))
    whole = F.when(F.col("href").startswith("/"), F.concat(F.lit(site), "href")).otherwise(F.col("href"))
    best = found.groupBy("doc_id").agg(F.max_by(whole, F.struct(number.cast("long"), -F.col("ord"))).alias("_url"))
    told = asked.select("paper").distinct().withColumn("doc_id", without_version(F.col("paper"))).join(best, "doc_id", "left")
    return told.select("paper", F.coalesce("_url", F.concat(F.lit(PAPERS), "paper")).alias("url"), F.lit(PAPERS).alias("base"))


def links(pages: DataFrame) -> DataFrame:
    """Links of each page in order, natively: ord, href."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("doc_id", F.posexplode(found).alias("ord", "href"))
