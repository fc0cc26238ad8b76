"""Steps that have to grow no faster than their input: how work is dealt out, what is read again, what is sent to the driver."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspark.plans import registry
from quillspark.sources import html as H

PLAIN = "<article><section class='ltx_section'><h2 class=\"ltx_title_section\">T</h2><p class=\"ltx_p\">a &amp; b</p></section></article>"


def partitions(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("made", [H.parse_blocks, H.parse_bibliography, H.images])
def test_pages_of_one_file_are_parsed_by_many_tasks(spark, made):
    page = PLAIN + '<img src="/i.png"><li class="ltx_bibitem" id="bib.b1"><span class="ltx_bibblock">On x.</span></li>'
    pages = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.lit(page).alias("html"))
    assert partitions(made(pages)) == 4 and made(pages).select("doc_id").distinct().count() == 200


def test_pages_of_the_table_function_are_parsed_by_many_tasks(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1)
    part.write.parquet(str(tmp_path / "part.parquet"))
    for name in ("blocks_by_sql", "blocks_of_all_shapes"):
        assert partitions(registry.QUERIES[name](spark, str(tmp_path))) == 4


def test_leaves_are_made_once(spark, tmp_path):
    spark.range(0, 8, 1, 1).selectExpr("id as p_partkey", "'B' as p_brand", "'T' as p_type", "1 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    made = registry.QUERIES["papers_written_back"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and made.count() == 8


@pytest.mark.parametrize("name", ["translated_papers", "page_markdown"])
def test_papers_are_put_together_without_sending_tables_whole(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("MapInPandas") <= 1


@pytest.mark.parametrize("name", ["translate_tables", "chat_tables"])
def test_lines_of_tables_are_dealt_out_and_meet_no_join(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("Join") <= 2


def test_python_holds_a_slice_of_a_batch():
    import pyarrow as pa

    from quillspark.functions import protect as P

    held = []
    texts = pa.array([None, "a $x$", *["b"] * 998])
    out = P.in_slices(lambda part: held.append(len(part)) or part, pa.string(), texts)
    assert out.equals(texts) and max(held) == P.SLICE and sum(held) == 1000 and P.in_slices(list, pa.string(), texts.slice(0, 0)).equals(pa.array([], pa.string()))


@pytest.mark.parametrize("text", [None, "", "a $x$ [1] [t](u)", "⟦MATH_0⟧ $$y$$"])
def test_protection_by_slices_is_that_of_a_text(spark, text):
    from quillspark.functions import protect as P

    got = spark.createDataFrame([(text,)] * 300, "t string").coalesce(1).select(P.protect("t").alias("p")).distinct().collect()
    said, entries = P.protect_text(text)
    assert len(got) == 1 and got[0].p.text == said and [e.asDict() for e in got[0].p.entries] == entries


def test_cells_of_span_grids_are_placed_once(spark):
    plan = registry.QUERIES["span_grids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_price_pages_name_all_versions_alone(spark, tmp_path):
    """The digits of a version stand at the end of the second model's name too, from four of them on as well (F5)."""
    spark.createDataFrame([(k,) for k in (4, 998, 1000, 60_000)], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = registry.QUERIES["price_pages"](spark, str(tmp_path)).collect()
    assert sorted(r.model for r in rows) == sorted(f"m{o}-v{k}" for k in (4, 998, 1000, 60_000) for o in (0, 1))


class _Own(H._Builder):
    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


@pytest.mark.parametrize("page", [
    PLAIN, "<p a='x' b c=\"y\">t</p >", "<P Class=\"A b\"\n id=\"\" class=\"c\" >t</P>u", "<script>if (a<b) </p></script><title>x<b>y</b></title>", "<a href=\"x&amp;y\">z</a><br/><math/>t",
    "<p\x0bq=\"1\">t", "<ul><li>a<li>b<!-- c --></ul></x></p>", "<td a=\">\" b=\"<\">c</td><", "<p a=\"1\"b=\"2\">", "</ p>x</p\n>y</>z",
])
def test_plain_tags_are_read_as_the_parser_reads_them(page):
    def told(kind):
        builder = kind()
        builder.feed(page)
        builder.finish()
        return [(n.tag, n.attrs, n.classes, [c if isinstance(c, str) else c.tag for c in n.children]) for n in builder.root.walk()]

    assert told(H._Builder) == told(_Own)


def test_what_is_inside_by_index_and_by_walk():
    page = "<div class='a'><p class='a b'>x<i class='b'>y</i></p><p>z</p></div><p class='b a'>w</p>"
    root = H.tree(page)
    for node in root.walk():
        for classes, tag in (((), None), ((), "p"), (("a",), None), (("a", "b"), None), (("b", "c"), "p"), (("c",), None)):
            walked = [n for n in node._walked() if n is not node and tag in (None, n.tag) and (not classes or not n.classes.isdisjoint(classes))]
            assert list(node.all(*classes, tag=tag)) == walked
        assert list(node.walk()) == list(node._walked())


def test_terms_of_a_document_pass_together(spark, tmp_path, monkeypatch):
    """A glossary's terms are gathered before they meet texts; a term that is a word needs no automaton; rows of terms and gathered ones say the same."""
    from quillspark.functions import text as X
    from quillspark.operators import automaton, glossary

    text = "concat('Alphabet gammaray42\\nτέλειος_9 ', repeat('deltoid', int(id)), ' the (块) MATH_ MATH_1> epsilon') as text"
    spark.range(0, 20, 1, 1).selectExpr("id as doc_id", text, "'en' as lang").write.parquet(str(tmp_path / "documents.parquet"))
    made = registry.QUERIES["needs_repair_by_glossary"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Aggregate [doc_id" in plan and "en_key#" not in plan.split("MapInArrow")[0]
    monkeypatch.setattr(automaton, "ENTRIES", 2)
    said = registry.paragraphs(spark, str(tmp_path)).select("doc_id", "block_idx", "text", F.expr("replace(text, 'a', 'A 的')").alias("translation"))
    rows = said.select("doc_id", F.explode(F.split("text", " ")).alias("en_key")).distinct().withColumn("zh", F.when(F.length("en_key") % 2 == 0, "<KEEP>").otherwise("那"))
    gathered = rows.groupBy("doc_id").agg(F.collect_list(F.struct("en_key", "zh")).alias("entries")).unionByName(spark.sql("select 99L as doc_id, cast(array() as array<struct<en_key string, zh string>>) as entries"))
    want = sorted(map(tuple, glossary.needs_repair(said, rows).collect()))
    assert want and sorted(map(tuple, glossary.needs_repair(said, gathered).collect())) == want
    words = automaton.Automaton(["alpha", "be_ta", "Σ"])
    assert words.machine is None and set(words.found("Alpha-be_ta alphaς ς")) == {0, 1, 2}
    texts = ["", "x", "(块)", "块", "MATH_ 1", "MATH_1>", "⟦MATH_1⟧", "⟦REF_X2⟧", "⟦REF_X⟧", "<math", "< math", "锐利边界", "锐利", "以...机制运行", "以abc机制运行", "一副产物", "探测分析", "探针", None]
    column = F.col("t")
    rule = X.residue(column) | X.awkward(column) | F.greatest(*(column.contains(p) for p in X.WRONG_VARIANTS))
    assert all(r[0] == r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.suspect(column), rule).collect())
