"""Grids of cells with spans, and translations spliced into pages, against plain Python on made-up pages."""

import html
import random
import re

from pyspark.sql import functions as F

from quillspark.operators import tables
from quillspark.sources import html as H
from quillspark.sources import write_back as W


def test_span_grid_against_one_table_at_a_time(spark):
    rng, rows, want, widths = random.Random(4), [], {}, {}
    for t in range(60):
        told = []
        for r in range(rng.randint(1, 5)):
            row = [{"text": rng.choice(["a", "b|c", "", None]), "colspan": rng.choice([1, 1, 2, 3, 0]), "rowspan": rng.choice([1, 1, 2, 4, 0]), "is_header": r == 0} for _ in range(rng.randint(1, 4))]
            told.append(row)
            rows += [(f"t{t}" if t else None, r, i, c["text"], c["colspan"] or None, c["rowspan"] or None, c["is_header"], "x") for i, c in enumerate(row)]
        grid = tables.expand_grid([[{**c, "text": c["text"] or ""} for c in row] for row in told])
        want |= {(f"t{t}" if t else None, r): texts for r, texts in enumerate(grid)}
        below = [sum(max(1, c["colspan"]) for c in row) for row in told]
        widths[f"t{t}" if t else None] = max(below[1:], default=below[0])
    cells = spark.createDataFrame(rows, "table_id string, r int, ord int, text string, colspan int, rowspan int, is_header boolean, c2 string").repartition(5)
    keyed = cells.where("table_id is not null")
    got = {(r["table_id"], r["r"]): r["texts"] for r in tables.span_grid(keyed).collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None}
    assert {r["table_id"]: r["width"] for r in tables.table_width(cells).collect()} == widths
    told = tables.placed_cells(cells)
    assert told.columns == [*cells.columns, "c"] and told.count() == len(rows)


def test_spans_that_meet_and_that_never_end(spark):
    assert tables.expand_grid([[{"text": "a", "colspan": 1, "rowspan": 1}, {"text": "b", "colspan": 1, "rowspan": 2}], [{"text": "x", "colspan": 2, "rowspan": 1}]]) == [["a", "b"], ["x", "b"]]
    rows = [("t", 0, 0, "a", 1, 1), ("t", 0, 1, "b", 1, 10**9), ("t", 1, 0, "x", 2, 1), ("t", 3, 0, "y", 1, 1), ("t", None, 0, "lost", 1, 1)]
    cells = spark.createDataFrame(rows, "table_id string, r int, ord int, text string, colspan int, rowspan int")
    grid = tables.span_grid(cells)
    assert {r["r"]: r["texts"] for r in grid.collect()} == {0: ["a", "b"], 1: ["x", "b"], 2: ["", "b"], 3: ["y", "b"]}
    assert tables.grid_markdown(grid, headers=2).first()["table_md"] == "| a<br>x | b |\n| --- | --- |\n|  | b |\n| y | b |"
    wide = spark.createDataFrame([("t", 0, 0, "a", 10**9, 1)], cells.schema)
    assert len(tables.span_grid(wide).first()["texts"]) == tables.MOST_SPAN


PIECES = ["<p>", "</p>", "<p class='a b'>", "<span style=\"color:red\">", "</span>", "<b>", "</b>", "<div>", "</div>", "word ", "a &amp; b", "x < y", "&nbsp;", "é\n", "中文", "<br/>", "<IMG SRC=x>", "<!-- c -->", "<ul><li>", "</ul>", "<table><tr><td>", "</table>", "<figcaption>", "</figcaption>", "<nav>", "</nav>", "<math>", "</math>", "<script>if(a<b)</script>", "<h2>", "</h2>", "\r\n", "&lt;", "<?pi ?>", "</x>", "<footer class=ltx_page_footer>", "</footer>"]


def test_leaves_and_splices_of_any_page(spark):
    rng = random.Random(9)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(400)]
    for page in pages:
        found = W.leaves_of(page)
        assert [r["leaf"] for r in found] == list(range(len(found)))
        assert all(a["ends"] <= b["begins"] for a, b in zip(found, found[1:]))
        for r in found:
            part = page[r["begins"] : r["ends"]]
            if r["role"] != "region":
                assert html.unescape(part) == r["text"] and r["text"].strip() and not re.match(r"<[a-zA-Z/!?]", part)
    data = spark.createDataFrame([(f"d{i}", p) for i, p in enumerate(pages)] + [("n", None)], "doc_id string, html string").repartition(3)
    leaves = W.text_leaves(data)
    same = leaves.where("role in ('text', 'cell')").groupBy("doc_id", "parent").agg(F.count("*").alias("n"), F.first("text").alias("translation")).where("n = 1")
    regions = {(r["doc_id"], r["begins"], r["ends"]) for r in leaves.where("role = 'region'").collect()}
    got = {r["doc_id"]: r["html"] for r in W.write_back(data, leaves, same.withColumn("translation", F.trim("translation"))).collect()}
    assert got.pop("n") is None
    for i, page in enumerate(pages):
        kept, at = "", 0
        for _, begin, end in sorted(x for x in regions if x[0] == f"d{i}"):
            kept, at = kept + page[at:begin], end
        kept += page[at:]
        assert html.unescape(got[f"d{i}"]).split() == html.unescape(kept).split()


def test_colours_stay_and_nothing_else_moves(spark):
    page = """<article><h1 Class = 'x'>T</h1>\n<p>Plain <span style="color:red">red words</span> tail</p><p>已译 done</p>
    <figure><img src=a><figcaption>Cap <b>bold</b></figcaption></figure><figure><figcaption>图 Cap</figcaption></figure><table><tr><td rowspan=2>cell</table><footer class="ltx_page_footer">f</footer></article>"""
    data = spark.createDataFrame([("d", page)], "doc_id string, html string")
    leaves = W.text_leaves(data)
    groups = {r["text"]: r for r in W.leaf_groups(leaves).collect()}
    assert set(groups) == {"T", "Plain  tail", "red words", "cell"} and groups["cell"]["role"] == "cell"
    blocks = {r["text"]: r["html_id"] for r in H.parse_blocks(data).collect()}
    assert groups["T"]["html_id"] == blocks["T"]
    said = {"T": "题", "Plain  tail": "a<b & c", "red words": "红", "cell": " "}
    told = spark.createDataFrame([("d", r["parent"], said[t]) for t, r in groups.items()] + [("d", 999, "none")], "doc_id string, parent int, translation string")
    captions = leaves.where("role = 'caption'").select("doc_id", "html_id", F.lit("图注").alias("translation")).distinct()
    made = W.write_back(data, leaves, told, captions).first()["html"]
    want = page.replace(">T<", ">题<").replace("Plain ", "a&lt;b &amp; c ").replace(" tail", "").replace("red words", "红").replace("Cap <b>bold</b>", "图注 <b></b>").replace('<footer class="ltx_page_footer">f</footer>', "")
    assert made == want
    assert W.write_back(data, leaves, told.limit(0)).first()["html"] == page.replace('<footer class="ltx_page_footer">f</footer>', "")
