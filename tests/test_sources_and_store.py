"""Fetching, files with a two-phase commit, the result store and the automaton of terms, against plain Python."""

import os
import random
import re
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import glossary as G
from quillspark.operators.automaton import Automaton
from quillspark.operators.pool import in_order
from quillspark.operators.store import ResultStore
from quillspark.settings import Settings
from quillspark.sources import fetch, files


def test_in_order_and_bounded():
    import threading

    at_once, most, lock, taken = 0, 0, threading.Lock(), []

    def call(x):
        nonlocal at_once, most
        with lock:
            at_once += 1
            most = max(most, at_once)
        time.sleep(0.02 * (5 - x % 5))
        with lock:
            at_once -= 1
        return -x

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    began, out = time.time(), []
    for item, answer in in_order(call, items(), 8):
        out.append((item, answer))
        assert len(taken) - len(out) <= 16
    assert out == [(i, -i) for i in range(40)] and 4 <= most <= 8
    assert time.time() - began < 0.5 * sum(0.02 * (5 - i % 5) for i in range(40))
    with pytest.raises(ZeroDivisionError):
        list(in_order(lambda x: 1 // (3 - x), range(100), 4))


class Script:
    """Statuses by attempt; None is no answer, and a body may break off."""

    def __init__(self, statuses, breaks=0):
        self.statuses, self.breaks = list(statuses), breaks

    def get(self, url, timeout):
        assert timeout == 7
        status = self.statuses.pop(0)
        if status is None:
            raise TimeoutError(url)
        return status, self.body()

    def body(self):
        yield b"half"
        if self.breaks:
            self.breaks -= 1
            raise ConnectionResetError
        yield b" whole"


@pytest.mark.parametrize(
    "statuses, breaks, ok, status, attempts, waits",
    [
        ([200], 0, True, 200, 1, []),
        ([404, 200], 0, False, 404, 1, []),
        ([429, 500, 200], 0, True, 200, 3, [1, 2]),
        ([None, 301, None, 200], 0, False, None, 3, [1, 2]),
        ([200, 200], 1, True, 200, 2, [1]),
        ([500] * 9, 0, False, 500, 3, [1, 2]),
    ],
)
def test_attempts(statuses, breaks, ok, status, attempts, waits):
    waited = []
    got = fetch.attempted(Script(statuses, breaks), "u", 2, 7, waited.append)
    assert got == ("u", ok, status, attempts, sum(waits), b"half whole" if ok else None) and waited == waits


def test_waits_are_bounded():
    waited = []
    fetch.attempted(Script([500] * 9), "u", 7, 7, waited.append)
    assert waited == [1, 2, 4, 8, 16, 30, 30]


def test_a_mirror_as_data_source(spark, tmp_path):
    for name, text in (("a.org/x", "one"), ("a.org/y/z.html", "two é"), ("b.org/x", "")):
        os.makedirs(os.path.dirname(tmp_path / "mirror" / name), exist_ok=True)
        (tmp_path / "mirror" / name).write_text(text)
    urls = ["http://a.org/x", "http://a.org/y/z.html?q=1#f", "https://b.org/x", "http://a.org/none", "http://a.org/../a.org/x", "http://a.org/x", None]
    fetch.write_url_list(spark.createDataFrame([(u,) for u in urls], "url string"), f"file://{tmp_path}/urls", files=3)
    fetch.register(spark)
    told = {"urls": f"file://{tmp_path}/urls", "transport": "quillspark.sources.fetch:FolderTransport", "transport_args": f'{{"root": "file://{tmp_path}/mirror"}}'}
    got = {r["url"]: (r["ok"], r["status"], r["attempts"], r["content"] and r["content"].decode()) for r in spark.read.format("fetched").options(**told).load().collect()}
    assert got == {urls[0]: (True, 200, 1, "one"), urls[1]: (True, 200, 1, "two é"), urls[2]: (True, 200, 1, b""), urls[3]: (False, 404, 1, None), urls[4]: (False, 404, 1, None)}


def test_cached(spark, tmp_path):
    calls = []

    def made(value, fails=False):
        def make():
            calls.append(value)
            if fails:
                raise OSError("no page")
            return spark.createDataFrame([(value,)], "v int")

        return make

    path = str(tmp_path / "cache")
    with pytest.raises(OSError):
        fetch.cached(spark, path, made(0, True), 1000)
    tell = lambda *a, **k: [tuple(r) for r in fetch.cached(spark, path, *a, **k).collect()]
    assert tell(made(1), 1000) == [(1, 1000)] and tell(made(2), 1100, ttl=100) == [(1, 1000)]
    assert tell(made(3), 1101, ttl=100) == [(3, 1101)] and tell(made(4), 1101, force=True, ttl=100) == [(4, 1101)]
    assert tell(made(5, True), 9999, ttl=100) == [(4, 1101)] and calls == [0, 1, 3, 4, 5]


def test_file_names(spark, tmp_path):
    rows = [("a", "T", None), ("b", "T", "题"), ("c", "", "题"), ("d/1", None, " "), ("e", "很" * 100, None), ("f", "很" * 100, "x: y?"), ("d、1", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, title string, title_zh string")
    by = {m: {r["doc_id"]: r["stem"] for r in files.file_names(docs, m).collect()} for m in ("id", "title", "title_zh")}
    mark = lambda d: "  " + __import__("hashlib").sha1(d.encode()).hexdigest()[:16]
    assert by["id"] == {"a": "a", "b": "b", "c": "c", "e": "e", "f": "f", "d/1": "d、1" + mark("d/1"), "d、1": "d、1" + mark("d、1")}
    assert by["title"]["a"] == "T" + mark("a") and by["title"]["c"] == "c" and by["title"]["e"] == "很" * 40 + mark("e")
    assert by["title_zh"]["b"] == "题" + mark("b") and by["title_zh"]["a"] == "T" and by["title_zh"]["f"] == "x： y？"
    for names in by.values():
        assert len(set(names.values())) == len(rows) and all(len(n.encode()) <= 240 for n in names.values())
    out = files.file_names(docs, "title_zh").select(F.concat("stem", F.lit(".md")).alias("name"), F.col("doc_id").alias("content"))
    files.write_files(out, str(tmp_path / "out"))
    assert {r["name"][:-3]: r["content"].decode() for r in files.read_files(spark, str(tmp_path / "out")).collect()} == {v: k for k, v in by["title_zh"].items()}


def test_runs_of_files(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, b"x") for n in names], "name string, content binary").repartition(2)
    seen = lambda: sorted(r["name"] for r in files.read_files(spark, path).collect())
    path = str(tmp_path / "out")
    files.write_files(rows("a", "b", "c +%20"), path)
    files.write_files(rows("d"), path)
    assert seen() == ["a", "b", "c +%20", "d"]
    with pytest.raises(Exception, match="no name of a file"):
        files.write_files(rows("e", "f", "../g"), path)
    assert seen() == ["a", "b", "c +%20", "d"] and len(os.listdir(path)) == 2
    files.write_files(rows("h"), path, "overwrite")
    files.write_files(rows(), path)
    assert seen() == ["h"]


def test_a_killed_task_leaves_whole_files_only(tmp_path):
    """Workers die in the midst of their first attempt; what the second writes is all there is."""
    code = f"""
        import os, pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from quillspark.sources import files
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    if i == 20 and TaskContext.get().attemptNumber() == 0:
                        os._exit(1)
                    yield batch.slice(i, 1)
        rows = spark.range(0, 90, 1, 3).selectExpr("concat('f', id) as name", "cast(repeat(cast(id as string), 1000) as binary) as content")
        files.write_files(rows.mapInArrow(run, rows.schema), {str(tmp_path / "out")!r})
        got = {{r["name"]: bytes(r["content"]) for r in files.read_files(spark, {str(tmp_path / "out")!r}).collect()}}
        assert got == {{f"f{{i}}": str(i).encode() * 1000 for i in range(90)}}, len(got)
        print("all", len(got))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "all 90" in done.stdout, done.stderr[-3000:]
    assert [d for d in os.listdir(tmp_path / "out") if d.startswith(".")] == []


RESULTS = "doc_id string, block_idx int, translation string, n int"


def test_store_against_a_dictionary(spark, tmp_path):
    rng, truth = random.Random(3), {}
    store = ResultStore(spark, str(tmp_path / "store"), 4, RESULTS)
    assert store.latest().count() == 0 and store.compact() is None and store.damaged().count() == 0
    for step in range(7):
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), rng.choice([None, "x", f"t{step}"]), rng.choice([None, step])) for _ in range(12)]
        store.add(spark.createDataFrame([(*r, "more") for r in rows], RESULTS + ", other string").repartition(3))
        best = {}
        for r in rows:
            order = tuple((v is not None, v or 0) for v in (r[3],))
            order = ((r[2] is not None, r[2] or ""), *order)
            best[r[:2]] = max(best.get(r[:2], (order, r)), (order, r), key=lambda x: x[0])
        truth |= {k: r for k, (_, r) in best.items()}
        if step in (2, 5):
            store.compact(files=1)
            assert len(store.runs()) == 1
        assert sorted(map(str, (tuple(r) for r in store.latest().collect()))) == sorted(map(str, truth.values()))
    assert store.count() == len(truth) and ResultStore(spark, str(tmp_path / "store"), 5, RESULTS).count() == 0
    store.clear()
    store.clear()
    assert store.count() == 0
    store.add(spark.createDataFrame([("z", 1, "t", 1)], RESULTS))
    assert [tuple(r) for r in store.latest().collect()] == [("z", 1, "t", 1)]


def test_store_after_a_crash_and_with_a_broken_file(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), 1, RESULTS)
    store.add(spark.createDataFrame([("a", i, "t", i) for i in range(40)], RESULTS).coalesce(1))
    spark.createDataFrame([("crashed", 0, "t", 0)], RESULTS).write.parquet(f"{store.path}/runs/{'0' * 32}")  # written, never recorded
    assert store.count() == 40
    late = store.add(spark.createDataFrame([("b", i, "t", i) for i in range(40)], RESULTS).repartition(2))
    folder = tmp_path / "store" / "version=1" / "runs" / late
    broken = sorted(p for p in folder.iterdir() if p.suffix == ".parquet")[0]
    broken.write_bytes(broken.read_bytes()[:-20])
    (folder / f".{broken.name}.crc").unlink()
    assert [r["file"].split("/")[-1] for r in store.damaged().collect()] == [broken.name]
    with pytest.raises(Exception):
        store.latest().collect()
    assert 40 < store.latest(skip_damaged=True).count() < 80


def test_automaton_against_patterns():
    rng = random.Random(1)
    letters = "abAB _1é中ßİ-."
    for _ in range(300):
        terms = list({"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(8)}) + ["ΣΑΣ"]
        text = "".join(rng.choices(letters, k=40)) + rng.choice([" σας ", "ΣΑΣ", "xσας"])
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text).replace("ς", "σ")
        plain = set()
        for i, t in enumerate(terms):
            t = "".join(x if len(x := c.lower()) == 1 else c for c in t).replace("ς", "σ")
            if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", low):
                plain.add(i)
        assert set(Automaton(terms).found(text)) == plain, (terms, text)
    assert list(Automaton([]).found("a")) == [] and list(Automaton(["", "a"]).found("A")) == [1] and list(Automaton(["a"]).found(None)) == []


@pytest.mark.parametrize("mode", ["intended", "as_coded"])
def test_needs_repair_against_pairs(spark, mode, monkeypatch):
    from quillspark.operators import automaton

    monkeypatch.setattr(automaton, "PART", 2)
    rng = random.Random(7)
    words = ["probe", "Split", "LLM", "a.b", "探针", "划分", "the", "", "副产物", "锐利边界", "⟦MATH_1⟧", "llm2"]
    make = lambda: " ".join(rng.choices(words, k=rng.randrange(6)))
    rows = [(rng.choice(["d", "e", None]), rng.choice([None, *range(8)]), rng.choice([None, make()]), rng.choice([None, " ", make()])) for _ in range(150)]
    terms = [("d", "probe", "探针"), ("d", "probe", "划分"), ("d", "llm", G.KEEP), ("d", "split", None), ("d", "", "x"), ("e", "a.b", "划分"), ("e", "the", G.KEEP), (None, "probe", "x"), ("f", "probe", "x")]
    has = lambda t, s: s is not None and re.search(rf"(?i)(?<!\w){re.escape(t)}(?!\w)", s) is not None
    want = {}
    for doc, idx, text, said in rows:
        if said is None or not said.strip():
            continue
        rules = [r for r, hit in (("residue", "⟦MATH_1⟧" in said), ("awkward", "锐利边界" in said and "⟦MATH_1⟧" not in said), ("variant", "副产物" in said and "⟦MATH_1⟧" not in said and "锐利边界" not in said)) if hit]
        for d, en, zh in terms:
            if d == doc and d is not None and en:
                if zh == G.KEEP and (has(en, text) and not has(en, said) if mode == "intended" else has(en, said)):
                    rules.append("term")
                if zh not in (G.KEEP, "", None) and has(en, said) and zh not in said:
                    rules.append("term")
        if rules:
            want[(doc, idx)] = min([*rules, want.get((doc, idx), "z")])
    data = spark.createDataFrame(rows, "doc_id string, block_idx int, text string, translation string")
    got = G.needs_repair(data, spark.createDataFrame(terms, "doc_id string, en_key string, zh string"), mode)
    assert {(r["doc_id"], r["block_idx"]): r["rule"] for r in got.collect()} == want


def test_has_text(spark):
    rows = [(t,) for t in [None, "", " ", "\t\n　 ", "\x1c\x85", " x ", "​"]]
    got = spark.createDataFrame(rows, "t string").select(X.has_text(F.col("t")) == (X.strip(F.col("t")) != "")).collect()
    assert [r[0] for r in got] == [None, *[True] * 6]

