"""Requests to a chat model: pool, retries, usage, groups, cells, stored results and rendering."""

import collections
import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillspark.operators import glossary as G
from quillspark.operators import paper, requests
from quillspark.operators import translate as T
from quillspark.operators.requests import Reply
from quillspark.operators.store import ResultStore
from quillspark.settings import Settings
from quillspark.sources.files import read_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
UNITS = "doc_id string, unit_id int, block_idx int, text string"


class Model:
    """Answers single and group requests with what say(text, system) gives; None leaves a block out."""

    def open(self, settings):
        self.lock, self.seen = threading.Lock(), collections.Counter()

    def answer(self, system, user, timeout):
        asked = json.loads(user)
        with self.lock:
            self.seen[user] += 1
        if self.fails(user):
            raise TimeoutError("no answer")
        if "blocks" in asked:
            told = {"blocks": [{"id": b["id"], "translation": self.say(b["text"], system)} for b in asked["blocks"] if self.say(b["text"], system) is not None], "terms": [{"en": "g", "zh": "组"}]}
        else:
            told = {"translation": self.say(asked["text"], system) or "", "terms": [{"en": "s", "zh": "单"}]}
        return Reply(json.dumps(told, ensure_ascii=False), len(system), len(user), 2)

    def fails(self, user):
        return False

    def say(self, text, system):
        return text.replace("e", "3")

    def close(self):
        pass


def no_wait(seconds):
    pass


def test_usage_agrees_with_retries(spark):
    class Flaky(Model):
        def fails(self, user):
            return self.seen[user] < 3 if "odd" in user else "never" in user

    texts = ["even one", "odd two", "never three", "even four"]
    asked = spark.createDataFrame([("s" * i, json.dumps({"text": t})) for i, t in enumerate(texts)], "system string, user string").coalesce(1)
    observation = Observation()
    rows = requests.observed(requests.ask(asked, Flaky, Settings(retries=2, threads=2), no_wait), observation).collect()
    assert [r["error"] for r in rows] == [None, None, "TimeoutError: no answer", None] and [r["requests"] for r in rows] == [1, 1, 0, 1]
    told = observation.get
    assert told == {"requests": 3, "prompt": 0 + 1 + 3, "completion": sum(len(r["user"]) for r in rows if r["requests"]), "cache_hit": 6, "errors": 1}
    assert json.loads(rows[1]["reply"])["translation"] == "odd two" and rows[2]["reply"] is None

    class Bare(Model):
        def answer(self, system, user, timeout):
            return " plain " if timeout == 5 else None

    bare = requests.ask(asked, Bare, Settings(timeout=5), no_wait).collect()
    assert {(r["reply"], r["requests"], r["prompt"]) for r in bare} == {("plain", 0, 0)}


def test_waits_between_attempts():
    class Never(Model):
        def fails(self, user):
            return True

    model, waited = Never(), []
    model.open(Settings())
    assert requests.answered(model, "", "{}", Settings(retries=6), waited.append)[0] is None and waited == [1, 2, 4, 8, 16, 30]


def test_a_sleeping_backend_is_asked_side_by_side(spark):
    class Sleeps(Model):
        def say(self, text, system):
            time.sleep(0.1)
            return text

    asked = spark.createDataFrame([("", json.dumps({"text": f"t{i}"})) for i in range(32)], "system string, user string").coalesce(1)
    requests.ask(asked.limit(1), Sleeps).collect()
    took = {}
    for threads in (1, 8):
        began = time.time()
        rows = requests.ask(asked, Sleeps, Settings(threads=threads)).collect()
        took[threads] = time.time() - began
        assert [json.loads(r["reply"])["translation"] for r in rows] == [f"t{i}" for i in range(32)]
    assert took[8] < 0.45 * took[1]


def test_groups_gaps_and_what_is_given_up(spark):
    class Gaps(Model):
        def say(self, text, system):
            if "late" in text:
                self.tries = getattr(self, "tries", 0) + 1
                return "spät" if "Answer with JSON: {\"translation\"" in system else None
            if "lost" in text:
                return " "
            return f"{text} ⟦REF_X1⟧^{{*}}" if "first" in text else text

    rows = [("d", 0, 0, "first $x$"), ("d", 0, 1, "see [7] late"), ("d", 0, 2, "lost"), ("d", 0, 3, " "), ("d", 1, 4, "alone $y$ [3]"), ("e", 0, 0, "late"), (None, 0, 0, "null doc"), ("f", 0, 0, None)]
    prompts = spark.createDataFrame([("d", "S", "- g"), ("e", None, None)], "doc_id string, summary string, glossary string")
    told = requests.translate_blocks(spark.createDataFrame(rows, UNITS), prompts, Gaps, sleep=no_wait)
    got = {(r["doc_id"], r["block_idx"]): (r["translation"], r["status"]) for r in told.results.collect()}
    assert got == {
        ("d", 0): ("first $x$ [7]（共同一作）", "group"),
        ("d", 1): ("spät", "single"),
        ("d", 2): ("", "given up"),
        ("d", 4): ("alone $y$ [3]", "single"),
        ("e", 0): ("spät", "single"),
        (None, 0): ("null doc", "single"),
    }
    usage = told.usage.collect()
    assert collections.Counter(r["round"] for r in usage) == {0: 4, 1: 2} and sum(r["requests"] for r in usage) == 6
    terms = {(r["doc_id"], r["block_idx"]): json.loads(r["terms"]) for r in told.results.collect()}
    assert terms[("d", 0)] == [{"en": "g", "zh": "组"}] and terms[("d", 1)] == [{"en": "s", "zh": "单"}]
    more = requests.translate_blocks(spark.createDataFrame(rows, UNITS), None, Gaps, rounds=3, sleep=no_wait)
    assert more.usage.agg(F.max("round")).first()[0] == 3 and more.results.where("status = 'given up'").count() == 1
    assert requests.translate_blocks(spark.createDataFrame([], UNITS), None, Gaps).results.count() == 0


def test_prompts_reach_the_backend(spark):
    class Told(Model):
        def say(self, text, system):
            return system

    units = spark.createDataFrame([("d", 0, 0, "a"), ("d", 1, 1, "b"), ("d", 1, 2, "c")], UNITS)
    prompts = spark.createDataFrame([("d", "about {n}", "- a → 【甲】")], "doc_id string, summary string, glossary string")
    got = {r["block_idx"]: r["translation"] for r in requests.translate_blocks(units, prompts, Told).results.collect()}
    assert "4. What the paper is about: about {n}" in got[0] and "5. Terms:\n- a → 【甲】" in got[0] and '"blocks"' not in got[0] and '"blocks"' in got[1] and got[1] == got[2]


def test_stored_results_are_not_asked_again(spark, tmp_path):
    class Once(Model):
        def say(self, text, system):
            assert text != "done", "asked again"
            return None if text == "hopeless" else "neu"

    class First(Model):
        def say(self, text, system):
            return "alt"

    store = ResultStore(spark, str(tmp_path / "s"), 1, requests.RESULT)
    units = spark.createDataFrame([("d", 0, 0, "done"), ("d", 0, 1, "fresh"), ("d", 1, 2, "hopeless")], UNITS)
    requests.translate_new(units.where("block_idx = 0"), None, First, store)
    told = requests.translate_new(units, None, Once, store, sleep=no_wait)
    assert {r["block_idx"]: r["translation"] for r in told.results.collect()} == {0: "alt", 1: "neu"}
    again = requests.translate_new(units.where("block_idx < 2"), None, Once, store)
    assert again.usage.count() == 0 and again.results.count() == 2


def test_cells(spark):
    class Cells(Model):
        def say(self, text, system):
            assert "table cell" in system
            self.asked = getattr(self, "asked", [])
            return T.SKIP if "skip" in text else "" if "blank" in text else f"译 {text} {'about: S' in system}"

    cells = [("d", 0, "the $x$ rate"), ("d", 1, "the $x$ rate"), ("d", 2, "1.0"), ("d", 3, "please skip this"), ("d", 4, "a blank one"), (None, 5, "some more words"), ("e", 6, None)]
    prompts = spark.createDataFrame([("d", "S", None)], "doc_id string, summary string, glossary string")
    got = {r["c"]: r["translation"] for r in requests.ask_cells(spark.createDataFrame(cells, "doc_id string, c int, text string"), prompts, Cells).collect()}
    assert got == {0: "译 the $x$ rate True", 1: "译 the $x$ rate True", 2: "1.0", 3: "please skip this", 4: "a blank one", 5: "译 some more words False", 6: None}


@pytest.mark.parametrize(
    "raw, said",
    [
        ('{"summary": "a", "text": "b"}', "a"),
        ('{"text": 3, "result": "r"}', "r"),
        ('{"x": "a", "y": 2, "z": "b"}', "a\nb"),
        ('"quoted"', "quoted"),
        ("plain", "plain"),
        ('{"x": 1}', '{"x": 1}'),
        ("[1]", "[1]"),
        ("", ""),
        ('{"summary": ""}', ""),
    ],
)
def test_summary_replies(spark, raw, said):
    assert spark.createDataFrame([(raw,)], "r string").select(T.summary_text(F.col("r"))).first()[0] == said


def test_a_key_that_is_there_twice(spark):
    units = spark.createDataFrame([("a", 0, 0, "a probe")], UNITS)
    terms = spark.createDataFrame([("a", "probe", "乙", 2), ("a", "probe", "甲", 1), ("a", None, "x", 0)], "doc_id string, en_key string, zh string, ord int")
    assert [r["translation"] for r in T.translate_units(units, terms, T.DictionaryBackend).collect()] == ["a 甲"]
    blocks = spark.createDataFrame([("a", 0, "figure", "x", "a probe")], "doc_id string, block_idx int, kind string, text string, caption string")
    assert [r["translation"] for r in paper.prewarm(blocks, terms.drop("ord"), T.DictionaryBackend).collect()] == ["a 乙"]


def test_papers_as_files(spark, tmp_path):
    blocks = spark.createDataFrame(
        [("d", 0, "title", 1, "T", None, None, None, None, None, None), ("d", 1, "figure", 0, "", "r", "s.png", None, "Cap", None, None), ("d", 2, "table", 0, "", "r", None, None, "C2", "| a |", None), ("e", 0, "paragraph", 0, "Text", None, None, None, None, None, None)],
        "doc_id string, block_idx int, kind string, level int, text string, raw string, src string, local_src string, caption string, table_md string, listing_md string",
    )
    results = spark.createDataFrame([("d", 0, "题: 一"), ("d", 1, "图注"), ("d", 2, "表注")], "doc_id string, block_idx int, translation string")
    tables = spark.createDataFrame([("d", 2, "| 甲 |")], "doc_id string, block_idx int, table_zh string")
    papers = T.render_markdown(blocks, results, tables, source="src/", notice="Made by machine.")
    glossaries = G.glossary_json(spark.createDataFrame([("d", 0, "k", "中", None, None, True)], "doc_id string, ord int, en_key string, zh string, en_full string, note string, seen boolean"))
    T.write_papers(papers, str(tmp_path / "out"), "title_zh", glossaries)
    got = {r["name"]: r["content"].decode() for r in read_files(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"题： 一.zh.md", "题： 一.glossary.json", "e.zh.md"}
    assert got["题： 一.zh.md"] == "# 题: 一\n\n> 原文: src/d\n> Made by machine.\n\n---\n\n![figure](s.png)\n\n> 图注\n\n| 甲 |\n\n> 表注\n\n"
    assert got["e.zh.md"] == "# e\n\n> 原文: src/e\n> Made by machine.\n\n---\n\nText\n\n" and json.loads(got["题： 一.glossary.json"]) == {"k": {"zh": "中", "en_full": None, "note": None, "seen": True}}


def test_seed_glossary(spark):
    class Seeds(Model):
        def answer(self, system, user, timeout):
            text = json.loads(user)["text"]
            assert "- probe → 【探针】" in system and text == "T\n\none\n\ntwo\n\nthree"
            return json.dumps({"translation": "x", "terms": [{"en": "Probe", "zh": "探头"}, {"en": "LLM", "zh": "<KEEP>", "note": "n"}, {"en": "", "zh": "y"}]}, ensure_ascii=False)

    rows = [("d", i, k, t) for i, (k, t) in enumerate([("title", "T"), ("heading", "H"), ("paragraph", "one"), ("list_item", "two"), ("paragraph", " "), ("paragraph", "three"), ("paragraph", "four")])] + [("e", 0, "figure", "")]
    got = {(r["doc_id"], r["en_key"]): (r["zh"], r["seen"], r["note"]) for r in requests.seed_glossary(spark.createDataFrame(rows, "doc_id string, block_idx int, kind string, text string"), Seeds).collect()}
    assert got[("d", "probe")][0] == "探头" and got[("d", "llm")] == ("<KEEP>", True, "n") and got[("d", "split")][:2] == ("数据集划分", False)
    assert len(got) == 2 * len(G.SEEDS) + 1 and got[("e", "probe")][0] == "探针"


def test_known_abbreviations_are_left_out(spark):
    texts = spark.createDataFrame([("d", "SNR = signal noise, LM (language model)."), ("e", "SNR = signal noise.")], "doc_id string, text string")
    known = spark.createDataFrame([("d", "snr"), ("d", "snr"), ("f", "lm")], "doc_id string, en_key string")
    assert sorted((r["doc_id"], r["en"]) for r in G.abbreviations(texts, known=known).collect()) == [("d", "LM"), ("e", "SNR")]


def test_latest_versions(spark):
    from quillspark.sources.html import latest_versions

    page = '<a href="/html/2603.00001v2">x</a> <a href="https://arxiv.org/html/2603.00001v10">y</a> <a href="/html/2603.00001v3">z</a> <a href="/html/2603.00001">w</a> <a href="/html/2603.00009v99">other</a>'
    pages = spark.createDataFrame([("2603.00001", page), ("2603.00002", None)], "doc_id string, html string")
    asked = spark.createDataFrame([("2603.00001v1",), ("2603.00002v4",), ("2603.00003",)], "paper string")
    got = {r["paper"]: r["url"] for r in latest_versions(pages, asked).collect()}
    assert got == {"2603.00001v1": "https://arxiv.org/html/2603.00001v10", "2603.00002v4": "https://arxiv.org/html/2603.00002v4", "2603.00003": "https://arxiv.org/html/2603.00003"}


def test_table_rows(spark):
    tables = spark.createDataFrame([("d", 0, "| a | b\\|c |\n| --- | :-: |\n\n| - | x |\n| 1 | $|x|$ |\nno row")], "doc_id string, block_idx int, table_md string")
    assert [(r["r"], r["cells"]) for r in T.table_rows(tables).collect()] == [(0, ["a", "b|c"]), (1, ["-", "x"]), (2, ["1", "$|x|$"])]


def test_a_glossary_reaches_every_part_and_no_other_document(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 2)
    units = spark.createDataFrame([("a", u, u, "probe") for u in range(5)] + [("b", 0, 0, "probe"), (None, 0, 0, "probe"), ("c", 1, 1, "probe")], UNITS)
    terms = spark.createDataFrame([("a", "probe", "甲"), ("c", "probe", "乙"), ("z", "probe", "x")], "doc_id string, en_key string, zh string")
    got = {(r["doc_id"], r["block_idx"]): r["translation"] for r in T.translate_units(units.repartition(3), terms, T.DictionaryBackend, tasks=1).collect()}
    assert got == {**{("a", u): "甲" for u in range(5)}, ("b", 0): "probe", (None, 0): "probe", ("c", 1): "乙"}
