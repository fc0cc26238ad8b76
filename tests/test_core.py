"""Functions and operators on small cases, and every registered query against its SQL."""

import json

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import protect as P
from quillspark.functions import text as X
from quillspark.operators import tables, units
from quillspark.plans import registry
from quillspark.sources import html as H

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    show = lambda d: sorted(map(tuple, d[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))
    assert len(mine) and show(mine) == show(theirs)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "made, said",
    [
        (lambda: X.model_key(F.lit(" DeepSeek-V4-Flash-0731")), "deepseek-v4-flash"),
        (lambda: X.price(F.lit("0.02元")), 0.02),
        (lambda: X.price(F.lit("0.5 USD")), None),
        (lambda: X.space_cjk(F.lit("使用A方法")), "使用 A方法"),
        (lambda: X.colour(F.lit("#ff8000")), [255, 128, 0]),
        (lambda: X.colour(F.lit("nothing")), None),
        (lambda: X.css_width(F.lit("width: 50%")), 0.5),
        (lambda: X.is_cell_translatable(F.lit("GPT-4o")), False),
        (lambda: X.is_cell_translatable(F.lit("History Order")), True),
        (lambda: X.author_marks(F.lit("A^{*}")), "A（共同一作）"),
        (lambda: X.strip_markdown(F.lit("**a** `b` [c](d)")), "a b c"),
        (lambda: X.quoted(F.lit("a b/~*+")), "a%20b/~%2A%2B"),
    ],
)
def test_columns(spark, made, said):
    assert one(spark, made()) == said


@given(st.text(alphabet="a$[]()1,\\{} \n↑A", max_size=60))
def test_protection_is_reversible(text):
    held, entries = P.protect_text(text)
    assert P.restore_text(held, entries) == text


def test_text_for_translation():
    assert P.translation_text("H$_{\\text{tok}}$") == "$H_{\\text{tok}}$"
    assert P.translation_text("area$_{X}$") == "area$_{X}$"
    assert P.translation_text("使用$T=0.8$个") == "使用 $T=0.8$ 个"
    assert P.split_row("| a \\| b | $x|y$ |") == ["a | b", "$x|y$"]


def test_units_partition_blocks(spark):
    rows = [("d", i, "paragraph" if i % 5 else "heading", "x" * (i * 97 % 700)) for i in range(60)]
    blocks = spark.createDataFrame(rows, "doc_id string, block_idx int, kind string, text string")
    ids = [r["unit_id"] for r in units.pack_units(blocks).orderBy("block_idx").collect()]
    assert len(ids) == 60 and ids == sorted(ids) and set(ids) == set(range(max(ids) + 1))


def test_grid():
    cell = lambda t, cs=1, rs=1, h=False: {"text": t, "colspan": cs, "rowspan": rs, "is_header": h}
    assert tables.expand_grid([[cell("a", rs=2), cell("b", cs=2)], [cell("c"), cell("d")]]) == [["a", "b", "b"], ["a", "c", "d"]]
    assert tables.header_rows([[cell("Method"), cell("x")], [cell("1"), cell("2")]]) == 1


def test_paper_blocks():
    page = """<article><h1 class="ltx_title_document">T</h1><div class="ltx_abstract"><h6 class="ltx_title_abstract">Abstract</h6><p class="ltx_p">An <em>a</em>.</p></div>
    <section class="ltx_section"><h2 class="ltx_title_section">1 Intro</h2><div class="ltx_para"><p class="ltx_p">See <a href="#bib.b1">[1]</a> <math display="inline"><annotation encoding="application/x-tex">x</annotation></math>.</p>
    <table class="ltx_equation"><tr><td><math><annotation encoding="application/x-tex">\\displaystyle y</annotation></math></td></tr></table><p class="ltx_p">End.</p></div></section></article>
    <ul><li class="ltx_bibitem" id="bib.b1"><span class="ltx_bibblock">A. 2020</span><span class="ltx_bibblock">Title.</span></li></ul>"""
    found = H.blocks_of(page)
    assert [b["kind"] for b in found] == ["title", "heading", "paragraph", "heading", "paragraph", "equation", "paragraph"]
    assert "[[1]](https://www.bing.com/search?q=Title \"Title\")" in found[4]["raw"] and "$x$" in found[4]["raw"]
    assert found[5]["text"] == "y"


def test_stream(spark, tmp_path):
    from quillspark.streaming.ingest import html_stream, store_blocks

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/p{i}.html").write_text(f"<h1>T{i}</h1><p>one</p><p>two</p>")
    store_blocks(html_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 9 and got.select("doc_id").distinct().count() == 3


def test_translation(spark):
    from quillspark.operators import translate as T

    rows = [("d", 0, 0, "a probe $x$ of [1]"), ("d", 0, 1, " "), ("d", 1, 2, "Probe")]
    data = spark.createDataFrame(rows, "doc_id string, unit_id int, block_idx int, text string")
    terms = spark.createDataFrame([("d", "probe", "探针")], "doc_id string, en_key string, zh string")
    got = {r["block_idx"]: r["translation"] for r in T.translate_units(data, terms, T.DictionaryBackend).collect()}
    assert got == {0: "a 探针 $x$ of [1]", 2: "探针"}
    assert T.parse_reply('ok {"translation": "t", "terms": 3} end') == ("t", []) and T.parse_reply("plain") == ("plain", [])


def test_price_table_errors(spark):
    from quillspark.operators.pricing import price_table

    head, hit = ["模型版本", "A", "", "B"], ["价格", "输入（缓存命中）", "1元"]
    rows = lambda *cells: spark.createDataFrame([("d", i, c) for i, c in enumerate(cells)], "doc_id string, r int, cells array<string>")
    assert price_table(rows(head)).count() == 0 and price_table(rows(["x"])).count() == 0
    with pytest.raises(Exception, match="1 prices for 2 models"):
        price_table(rows(head, hit)).collect()
    got = price_table(rows(head, [*hit, "2元"], ["输入（缓存未命中）", "3元", "4元"], ["百万tokens输出", "5元", "-", "6元"])).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in got] == [("a", 1.0, 3.0, 5.0), ("b", 2.0, 4.0, 6.0)]


def test_price_pages_of_long_versions(spark, tmp_path):
    """A version of four digits or more is no date: two models that differ in it alone are two."""
    import duckdb

    from quillspark.operators.pricing import price_table
    from quillspark.plans import registry

    keys = [0, 7, 999, 1000, 1001, 60_000, 20_250_730, 1_234_567_890]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    said = con.execute(registry.ORACLES["price_pages"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["price_pages"](spark, str(tmp_path)).collect())) == sorted(said) and len(said) == 13

    cells = [["模型版本", "M-V1000", "m-v1001-0731"], ["输入（缓存命中）", "1元", "2元"], ["输入（缓存未命中）", "3元", "4元"], ["百万tokens输出", "5元", "6元"]]
    rows = spark.createDataFrame([("d", i, c) for i, c in enumerate(cells)], "doc_id string, r int, cells array<string>")
    assert sorted(tuple(r)[2:] for r in price_table(rows).collect()) == [("m-v", 1.0, 3.0, 5.0), ("m-v1001", 2.0, 4.0, 6.0)]
    names = [("chat20250731", "chat", "chat"), ("m-240731", "m", "m"), ("gptv2024", "gptv", "gptv"), ("v60000", "v", "v60000"), ("m-v4-0731", "m-v4", "m-v4"), ("deepseek-v20250731", "deepseek-v", "deepseek-v20250731")]
    got = spark.createDataFrame(names, "name string, key string, version string").select(X.model_key(F.col("name")), "key", X.model_key(F.col("name"), versions=True), "version").collect()
    assert all(a == b and c == d for a, b, c, d in got)


@pytest.mark.parametrize(
    "made, said",
    [
        (lambda: X.strip_markdown(F.lit("*a* **b** `` *")), "a b `` *"),
        (lambda: X.colour(F.lit("#ff800080")), [255, 128, 0]),
        (lambda: X.tex_to_unicode(F.lit("\\mathcal{L}_{max} \\leq \\mathbf{x}^{2} \\foo")), "ℒmax <= X2"),
        (lambda: X.tex_to_unicode(F.lit("\\foo")), "\\foo"),
        (lambda: X.is_pure_math(F.lit("**$x_1$**")), True),
        (lambda: X.is_pure_math(F.lit("$x$ and $y$")), False),
        (lambda: X.content_hash(F.lit("a")), "0cc175b9c0f1"),
        (lambda: X.block_markdown(F.lit("title"), F.lit(1), F.lit("T"), F.lit(""), F.lit("题目⟦NEWPAR⟧。")), "# 题目\n"),
        (lambda: X.block_markdown(F.lit("paragraph"), F.lit(0), F.lit("t"), F.lit(""), F.lit("一⟦NEWPAR⟧ [newpar]二")), "一\n\n二\n"),
        (lambda: X.block_markdown(F.lit("heading"), F.lit(2), F.lit("Introduction"), F.lit(""), F.lit("x")), "## 引言\n"),
        (lambda: X.block_markdown(F.lit("text_box"), F.lit(0), F.lit("t"), F.lit(""), F.lit("a\n\nb")), "> a\n> \n> b\n"),
        (lambda: P.space_protected(F.lit("使用A[一a](b二c)`一a`$一a$x一")), "使用 A[一a](b二c)`一a`$一a$x 一"),
        (lambda: P.space_protected(F.lit("")), ""),
    ],
)
def test_more_columns(spark, made, said):
    assert one(spark, made()) == said


def test_sanitizing_leaves_formulas():
    assert P.sanitize_text("a \\thicksim $\\uparrow$ {}_{a} \\downarrow \\textsc{X}") == "a \\sim $\\uparrow$ $_{a}$ $\\downarrow$ \\text{X}"
    held, entries = P.protect_text("$\\textsc{a}$ [1]", 5)
    assert held == "⟦MATH_5⟧ ⟦REF_X6⟧" and P.restore_text(held, entries) == "$\\text{a}$ [1]"


@pytest.mark.parametrize(
    "page, said",
    [
        ("<p>one<p>two<p>three", ["one", "two", "three"]),
        ("<p>" + "<b>" * 3000 + "x", ["x"]),
        ("<div>" * 3000 + "deep", ["deep"]),
        ("<h1>T</h1>x<b>y</b><div>z</div>w<script>no</script>", ["T", "xy", "z", "w"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f</table>", ["a", "b", "c", "d", "e", "f"]),
        ("", []),
    ],
)
def test_pages_keep_every_text_once(page, said):
    assert [b["text"] for b in H.blocks_of(page)] == said


def test_deep_papers():
    page = '<article><section class="ltx_section"><h2 class="ltx_title_section">A</h2>' + "<div class=ltx_para>" * 40 + '<p class="ltx_p">deep</p>'
    assert [b["text"] for b in H.blocks_of(page)] == ["A", "deep"]


def test_bibliography_and_images(spark):
    page = """<article><h1>T</h1><p>One <span style="color:red">two</span></p><nav>x</nav><figure><img src="a.png"></figure><ul><li class="ltx_bibitem" id="bib.b1">
    <span class="ltx_bibblock">A. 2020</span><span class="ltx_bibblock">Title.</span></li></ul></article>"""
    data = spark.createDataFrame([("d", page), ("e", None), ("f", "")], "doc_id string, html string")
    assert [tuple(r) for r in H.parse_bibliography(data).collect()] == [("d", "#bib.b1", "Title")]
    assert [(r["src"], r["name"]) for r in H.images(data).collect()] == [("a.png", "a.png")]
    blocks = H.parse_blocks(data)
    ids = {r["text"]: r["html_id"] for r in blocks.collect()}
    assert ids["T"] == "zh-1" and ids["One two"] == "zh-2"
    files = spark.createDataFrame([("d", "a.png", "images/a.png")], "doc_id string, src string, local string")
    shown = blocks.withColumn("src", F.lit("a.png"))
    assert {r["local_src"] for r in H.with_local_images(shown, files).collect()} == {"images/a.png"}


def test_header_rows_of_tables():
    row = lambda *texts, **more: [{"text": t, "colspan": 1, "rowspan": 1, "is_header": False, **more} for t in texts]
    assert tables.header_rows([row("**Method**", "x"), row("1", "2")]) == 1
    assert tables.header_rows([row("Our Model size", "x")]) == 1 and tables.header_rows([row("a model " * 10, "x")]) == 0
    assert tables.header_rows([row("Task", "a", "b", "c"), row("left", "right", "up", "down"), row("1.0", "b", "c", "d")]) == 2
    assert tables.header_rows([row("a", is_header=True), row("ACC", "b", "c", "d")]) == 1 and tables.header_rows([]) == 0


def test_tables(spark):
    from quillspark.operators import translate as T

    table = "| Method | History probe |\n| --- | --- |\n| $x$ | a probe \\| more |\nno row"
    data = spark.createDataFrame([("d", 3, table), ("d", 4, "<table><tr></table>")], "doc_id string, block_idx int, table_md string")

    class Backend(T.IdentityBackend):
        def translate(self, texts, glossary, cell=False):
            return super().translate([t.replace("probe", "探针") for t in texts], glossary, cell)

    got = {r["block_idx"]: r["table_zh"] for r in T.translate_tables(data, Backend).collect()}
    assert got[3] == "| Method | History 探针 |\n| --- | --- |\n| $x$ | a 探针 \\| more |\nno row" and got[4] == "<table><tr></table>"
    assert tuple(T.table_counts(data).first()) == ("d", 1, 1, 2)
    cells = spark.createDataFrame([("t", 0, 0, "$x$", 3), ("t", 1, 0, "$y$", 1), ("t", 0, 1, "word", 1)], "table_id string, r int, c int, text string, rowspan int")
    assert {r["c"]: (r["weight"], round(r["share"], 3)) for r in tables.column_weights(cells).collect()} == {0: (1.2, 0.286), 1: (3.0, 0.714)}
    assert sorted(map(tuple, tables.occupied(cells).collect())) == [("t", 1, 0), ("t", 2, 0)]


def test_prompts_groups_and_store(spark, tmp_path):
    from quillspark.operators import translate as T

    told = one(spark, T.system_prompt(F.lit("about x"), F.lit(""), cell=True))
    assert "4. What the paper is about: about x" in told and "5. The text is a table cell" in told and "Terms" not in told
    assert T.parse_group('ok {"blocks": [{"id": 0, "translation": "a"}, {"id": 7, "translation": "b"}, {"id": "1"}]}', 2) == {0: "a"} and T.parse_group("plain", 2) == {}

    class Moves(T.IdentityBackend):  # puts the first block's reference into the second
        def translate(self, texts, glossary, cell=False):
            return super().translate([texts[0].split("⟦REF")[0], *(t + " ⟦REF_X0⟧" for t in texts[1:])], glossary, cell)

    units = spark.createDataFrame([("d", 0, 0, "see [1]"), ("d", 0, 1, "more")], "doc_id string, unit_id int, block_idx int, text string")
    assert {r["block_idx"]: r["translation"] for r in T.translate_units(units, None, Moves).collect()} == {0: "see ", 1: "more [1]"}
    path = str(tmp_path / "store")
    first = T.translate_stored(units.where("block_idx = 0"), None, T.IdentityBackend, path, 1)
    assert first.count() == 1

    class Fails(T.IdentityBackend):
        def translate(self, texts, glossary, cell=False):
            assert "see" not in texts[0]
            return super().translate(texts, glossary, cell)

    again = T.translate_stored(units, None, Fails, path, 1)
    assert {r["block_idx"]: r["translation"] for r in again.collect()} == {0: "see [1]", 1: "more"}
    assert T.stored(spark, path, 2).count() == 0 and T.stored(spark, path, 1, "never").count() == 0
    terms = spark.createDataFrame([("d", "more", "更多")], "doc_id string, en_key string, zh string")
    mended = T.repaired(again, units, terms, T.DictionaryBackend)
    assert {r["block_idx"]: r["translation"] for r in mended.collect()} == {0: "see [1]", 1: "更多"}


def test_settings(tmp_path, monkeypatch):
    from quillspark.settings import resolve

    (tmp_path / "env").write_text("# x\nQUILL_THREADS=3\nQUILL_USE_SUMMARY='off'\nQUILL_MODEL=a\n")
    monkeypatch.setenv("QUILL_MODEL", "b")
    told = resolve(str(tmp_path / "env"), threads=5)
    assert (told.threads, told.model, told.use_summary, told.retries) == (5, "b", False, 3)


def test_prices_by_equi_joins(spark):
    from quillspark.operators import pricing

    prices = spark.createDataFrame([(0, "alpha", 1.0, 1.0, 1.0), (1, "alpha-pro-20250101", 2.0, 2.0, 2.0), (2, "beta-large", 3.0, 3.0, 3.0)], "ord int, model string, cache_hit_price double, cache_miss_price double, output_price double")
    models = spark.createDataFrame([("alpha",), ("Alpha-Pro",), ("alpha-mini",), ("beta",), ("gamma",)], "model string")
    assert {r["model"]: r["priced"] for r in pricing.price_lookup(models, prices).collect()} == {"alpha": "alpha", "Alpha-Pro": "alpha-pro-20250101", "alpha-mini": "alpha", "beta": "beta-large"}
    cache = spark.createDataFrame([("a", 100), ("b", 10)], "model string, fetched_at int")
    assert pricing.fresh_prices(cache, 150, 60).count() == 1 and pricing.fresh_prices(cache, 1000, 60).count() == 2


def test_html_tables_summaries_and_prewarming(spark):
    from quillspark.operators import html_tables as HT
    from quillspark.operators import paper
    from quillspark.operators import translate as T

    class Backend(T.DictionaryBackend):
        def translate(self, texts, glossary, cell=False):
            self.told = dict(glossary)
            said = [t.replace("History probe", "历史 <探针>") for t in texts]
            terms = [{"en": "LLM", "zh": "大模型"}, {"en": "LLM", "zh": "<KEEP>"}, {"en": "", "zh": "x"}, "odd"]
            return [json.dumps({"translation": f"{len(glossary)} {s}" if not cell else s, "terms": terms}, ensure_ascii=False) for s in said]

        def summarise(self, title, abstract):
            if title == "bad":
                raise ValueError
            return f"about {title}" if title else ""

    held = "<table><thead><tr><th>Method<td id='a'><b>History</b>\n probe</td></tr></thead><!-- <td> --><tr><td>12 < 3</td><td></td></tr></table>"
    data = spark.createDataFrame([("d", 1, held), ("d", 2, None), ("d", 3, "| History probe |")], "doc_id string, block_idx int, table_md string")
    got = {r["block_idx"]: r["table_zh"] for r in HT.translate_all_tables(data, Backend).collect()}
    assert got == {1: held.replace("<b>History</b>\n probe", "历史 &lt;探针&gt;"), 2: None, 3: "| 历史 <探针> |"}
    assert HT.translate_all_tables(data.limit(0), Backend).count() == 0

    blocks = [("a", 0, "title", None, "T {abstract}"), ("a", 1, "paragraph", None, "x" * 700), ("b", 0, "title", None, "bad"), ("c", 0, "paragraph", "abstract", "only"), ("e", 0, "figure", None, None)]
    blocks = spark.createDataFrame(blocks, "doc_id string, block_idx int, kind string, section string, text string")
    said = {r["doc_id"]: r["summary"] for r in paper.summaries(blocks, Backend, 10).collect()}
    assert said["a"] == "about T {abstract}" and said["b"].startswith("本文标题：《bad》。翻译") and said["c"] == said["e"] == paper.ANCHORS["none"]
    fallback = {r["doc_id"]: r["summary"] for r in paper.summaries(blocks, T.IdentityBackend).collect()}
    assert fallback["a"].startswith("本文标题：《T {abstract}》。摘要要点：" + "x" * 600 + "…。")

    rows = [("a", 0, "figure", None, "LLM = large model"), ("a", 1, "paragraph", "none here", None), ("a", 2, "paragraph", "SNR: noise ratio", None), ("a", 3, "table", None, " "), ("b", 0, "listing", None, "code")]
    made = paper.prewarm(spark.createDataFrame(rows, "doc_id string, block_idx int, kind string, text string, caption string"), spark.createDataFrame([("a", "probe", "探针")], "doc_id string, en_key string, zh string"), Backend)
    assert {(r["doc_id"], r["block_idx"]): r["translation"] for r in made.collect()} == {("a", 0): "1 LLM = large model", ("a", 2): "2 SNR: noise ratio", ("b", 0): "0 code"}
    assert {(r["doc_id"], r["en_key"], r["zh"]) for r in paper.learned_terms(made).collect()} == {("a", "llm", "大模型"), ("b", "llm", "大模型")}
