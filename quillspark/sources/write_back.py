"""Translations put back into a page: its texts by place and parent, and answers spliced into the page as it was.

A leaf is a text between two tags, with the places in the page where it begins and ends. Texts of one element are translated
together, and the answer takes the place of the first of them; so words in a coloured span get an answer of their own and stay
coloured. Everything between leaves, spelling and white space of tags among it, stays as it is, but for regions that are no part
of a paper, which are cut out.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.shared import written
from quillspark.sources.html import VOID, Element, _Builder, _rows, numbered

#: Classes of regions that are not written back.
SKIPPED = frozenset("ltx_page_navbar ltx_bibliography ltx_page_footer ltx_appendix ltx_errors ltx_ERROR ltx_page_logo".split())
#: Elements whose texts are no words, and those that hold a caption.
WORDLESS, CAPTIONS = frozenset("math annotation script style svg textarea title".split()), frozenset("caption figcaption".split())
LEAVES = "doc_id string, leaf int, parent int, html_id string, role string, begins int, ends int, text string"


class _Places(_Builder):
    """Builds the tree and notes where texts and elements begin and end in the page."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.size, self.lines = len(html), [0]
        while (at := html.find("\n", self.lines[-1])) >= 0:
            self.lines.append(at + 1)
        self.begins: dict[Element, int] = {}
        self.ends: dict[Element, int] = {}
        self.leaves: list[list] = []  # parent, begin, end, text
        self.waiting = False
        self.html = html
        self.feed(html)
        self.finish()
        self._here(self.size)
        node = self.top
        while node is not None:
            self.ends[node], node = self.size, node.parent
        self.begins[self.root] = 0

    updatepos = HTMLParser.updatepos

    def _here(self, at: int | None = None) -> int:
        """Where the parser is; a text that waits for its end ends here."""
        if at is None:
            line, column = self.getpos()
            at = self.lines[line - 1] + column
        if self.waiting:
            self.leaves[-1][2], self.waiting = at, False
        return at

    def shut(self, names, barriers=frozenset()):
        here, node = self._here(), self.top
        super().shut(names, barriers)
        while node is not self.top:
            self.ends[node], node = here, node.parent

    def handle_starttag(self, tag, attrs):
        here, told = self._here(), self.get_starttag_text() or ""
        super().handle_starttag(tag, attrs)
        node = self.top.children[-1] if tag in VOID else self.top
        self.begins[node], self.ends[node] = here, here + len(told)

    def handle_endtag(self, tag):
        here, node = self._here(), self.top
        super().handle_endtag(tag)
        last = None
        while node is not self.top:
            last, node = node, node.parent
        if last is not None:
            self.ends[last] = self.html.find(">", here) + 1 or self.size

    def handle_data(self, data):
        here = self._here()
        if self.top.tag in ("script", "style"):
            return
        super().handle_data(data)
        if self.leaves and self.leaves[-1][0] is self.top and self.leaves[-1][2] == here:
            self.leaves[-1][3] += data
        else:
            self.leaves.append([self.top, here, here, data])
        self.waiting = True

    def handle_comment(self, data):
        self._here()

    def handle_decl(self, decl):
        self._here()

    def handle_pi(self, data):
        self._here()

    def unknown_decl(self, data):
        self._here()


def leaves_of(html: str) -> list[dict]:
    """Leaves with words, in page order, and regions to be cut out, as rows without a text."""
    page = _Places(html)
    number, role = {}, {}
    out = []
    for i, node in enumerate(numbered(page.root).walk()):
        number[node] = i
        above = role.get(node.parent, "text")
        if above in ("region", "none"):
            role[node] = above
        elif node.tag == "nav" or not node.classes.isdisjoint(SKIPPED):
            role[node] = "region"
            out.append({"parent": i, "role": "region", "begins": page.begins[node], "ends": page.ends[node]})
        elif node.tag in WORDLESS:
            role[node] = "none"
        elif node.tag in CAPTIONS or "ltx_caption" in node.classes:
            role[node] = "caption"
        else:
            role[node] = "cell" if node.tag in ("td", "th") and above != "caption" else above
    for node, begin, end, text in page.leaves:
        if role[node] not in ("region", "none") and text.strip():
            out.append({"parent": number[node], "html_id": node.number or None, "role": role[node], "begins": begin, "ends": end, "text": text})
    out.sort(key=lambda r: r["begins"])
    return [{"leaf": i, **r} for i, r in enumerate(out)]


def text_leaves(pages: DataFrame) -> DataFrame:
    """The texts of pages (doc_id, html) as rows of LEAVES: parent is the number of the element that holds a text, html_id that of the
    block (see blocks), role text, cell or caption; a region to be cut out has the role region and no text. A null page has none.

    They are written to the shared folder, as several steps read them and each would parse the pages again."""
    return written(_rows(pages, leaves_of, LEAVES), "leaves")


def leaf_groups(leaves: DataFrame) -> DataFrame:
    """What is to be translated for itself: the texts of one element, joined in their order, unless they are Chinese already.

    doc_id, parent, html_id, role, text. Captions are their blocks' own and are left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct("leaf", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    told = leaves.where(F.col("role").isin("text", "cell")).groupBy("doc_id", "parent", "html_id", "role").agg(joined.alias("text"))
    return told.where(~X.has_cjk(F.col("text")))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def write_back(pages: DataFrame, leaves: DataFrame, translations: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """pages (doc_id, html) with translations (doc_id, parent, translation) and captions (doc_id, html_id, translation) put in.

    The first text of an element, or of a caption that is not Chinese, takes the answer between its own white space; the others
    go. Blank answers and keys that are there twice after the first change nothing. Leaves are rows: a page's cuts are put
    together by one aggregate, and a page is held once while it is made. A null page stays null.
    """

    def first_takes(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
        given = told.where(X.has_text(F.col("translation"))).groupBy(F.col("doc_id").cast("string").alias("doc_id"), key).agg(F.min("translation").alias("translation"))
        place = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("leaf"))
        around = lambda pattern: F.regexp_extract("text", pattern, 0)
        said = F.concat(around(r"\A\s*"), _escaped(F.col("translation")), around(r"\s*\z"))
        return rows.join(given, ["doc_id", key]).select("doc_id", "begins", "ends", F.when(place == 1, said).otherwise("").alias("said"))

    cuts = leaves.where("role = 'region'").select("doc_id", "begins", "ends", F.lit("").alias("said"))
    cuts = cuts.unionByName(first_takes(leaves.where(F.col("role").isin("text", "cell")), translations, "parent"))
    if captions is not None:
        held = leaves.where("role = 'caption'")
        chinese = held.where(X.has_cjk(F.col("text"))).select("doc_id", "html_id").distinct()
        cuts = cuts.unionByName(first_takes(held.join(chinese, ["doc_id", "html_id"], "left_anti"), captions, "html_id"))
    own = cuts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begins", "ends", "said"))).alias("cuts"))
    both = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html").join(own, "doc_id", "left")

    def spliced(html: str | None, told: list | None) -> str | None:
        parts, at = [], 0
        for cut in told or []:
            parts += [html[at : cut["begins"]], cut["said"]]
            at = cut["ends"]
        return html if html is None or not parts else "".join([*parts, html[at:]])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                html = [spliced(h, c) for h, c in zip(part.column("html").to_pylist(), part.column("cuts").to_pylist())]
                yield pa.record_batch([part.column("doc_id"), pa.array(html, pa.string())], names=["doc_id", "html"])

    return both.mapInArrow(run, "doc_id string, html string")
