"""The streaming glossary against the rules of a batch, with repeated, late and odd events; table functions in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import glossary as G
from quillspark.operators.store import ResultStore
from quillspark.sources import html as H
from quillspark.sources import udtf
from quillspark.streaming import glossary as S

EVENTS = "doc_id string, ord long, en string, zh string, en_full string, note string"


def test_a_stream_gives_the_glossary_of_a_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["Probe", "probe ", "LLM", "", None]), rng.choice([G.KEEP, "甲", "乙", "", None]), rng.choice([None, " ", "Full"]), rng.choice([None, "n1", "n2"])) for i in range(60)]
    late = rows[:]
    rng.shuffle(late)
    parts = [late[:20], late[20:40], late[:20], late[40:]]  # one batch comes twice
    store = ResultStore(spark, str(tmp_path / "store"), 1, S.TERMS, ("doc_id", "en_key"))
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for part in parts[:3]:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    S.store_terms(stream(), store, checkpoint).awaitTermination(120)
    assert len(store.runs()) == 3
    spark.createDataFrame(parts[3], EVENTS).coalesce(1).write.mode("append").parquet(source)
    S.store_terms(stream(), store, checkpoint).awaitTermination(120)  # goes on where it ended
    want = G.ingest_terms(spark.createDataFrame(rows, EVENTS))
    names = ["doc_id", "en_key", "ord", "zh", "en_full", "note", "seen"]
    show = lambda df: sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    assert show(store.latest()) == show(want) and want.count() == 6


@pytest.mark.parametrize("page", [None, "", "<h1>T</h1><p>one <b>two</b></p><ul><li>x</li></ul>"])
def test_table_functions(spark, page):
    udtf.register(spark)
    pages = spark.createDataFrame([("d", page)], "doc_id string, html string")
    got = spark.sql("select doc_id, b.* from {pages}, lateral parse_blocks(html) b", pages=pages)
    assert sorted(map(str, got.collect())) == sorted(map(str, H.parse_blocks(pages).collect())) and got.columns == H.parse_blocks(pages).columns
    leaves = spark.sql("select doc_id, count(*) as n from {pages}, lateral text_leaves(html) group by doc_id", pages=pages).collect()
    assert [r["n"] for r in leaves] == ([4] if page else [])
    assert spark.sql("select * from {pages}, lateral parse_bibliography(html)", pages=pages).where(F.col("anchor").isNotNull()).count() == 0
