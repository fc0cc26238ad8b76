"""Requests to a chat model: prompts, answers with what they cost, groups whose gaps are asked again.

A backend is opened once a task and gets a system prompt and a message; a bounded number of its answers is awaited at a time, in
order. What fails is tried again after waiting; what fails for good is an error in its row and no failure of the job. Answers are
written before they are used, so that no request is made twice because its answer is read twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X
from quillspark.functions.protect import ENTRIES, ENTRY, in_slices, protect_text, restore, sanitize
from quillspark.operators.glossary import SEEDS, ingest_terms, prompt_lines, seed_terms
from quillspark.operators.pool import in_order
from quillspark.operators.store import ResultStore
from quillspark.operators.translate import PROMPT, SKIP, parse_group, parse_reply, system_prompt
from quillspark.operators.units import seed_texts
from quillspark.settings import Settings
from quillspark.shared import large, written

#: What a request adds to its row.
ANSWER = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("requests", "prompt", "completion", "cache_hit"))])
RESULT = "doc_id string, block_idx int, translation string, terms string, status string"
#: The longest wait between two attempts, in seconds; rows that are answered before any is passed on.
LONGEST, AT_ONCE = 30.0, 256


class Reply(NamedTuple):
    """A reply and the usage that came with it; None where none came."""

    text: str
    prompt: int | None = None
    completion: int | None = None
    cache_hit: int | None = None


class ChatBackend(Protocol):
    """open once a task; answer may be called by several threads at once, and raises what made it fail."""

    def open(self, settings: Settings) -> None: ...

    def answer(self, system: str, user: str, timeout: float) -> Reply | str: ...

    def close(self) -> None: ...


def answered(model: ChatBackend, system: str, user: str, settings: Settings, sleep: Callable[[float], None]) -> tuple:
    """A row of ANSWER. Only replies with usage count as requests, as usage is what is paid."""
    for attempt in range(settings.retries + 1):
        try:
            reply = model.answer(system or "", user or "", settings.timeout)
        except Exception as e:  # whatever a client raises: tried again, and told in the end
            error = f"{type(e).__name__}: {e}"[:500]
            if attempt < settings.retries:
                sleep(min(2.0**attempt, LONGEST))
            continue
        reply = Reply(reply) if isinstance(reply, str) or reply is None else reply
        used = [int(x or 0) for x in reply[1:]]
        return (reply.text or "").strip(), None, int(any(x is not None for x in reply[1:])), *used
    return None, error, 0, 0, 0, 0


def ask(requests: DataFrame, backend: Callable[[], ChatBackend], settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (any columns, system, user) with the columns of ANSWER: reply null and error set where all attempts failed."""
    schema = T.StructType([*requests.schema.fields, *ANSWER.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend()
        model.open(settings)
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(a, AT_ONCE)
                    pairs = zip(part.column("system").to_pylist(), part.column("user").to_pylist())
                    rows = [row for _, row in in_order(lambda p: answered(model, *p, settings, sleep), pairs, settings.threads)]
                    told = [pa.array(x, pa.string() if i < 2 else pa.int64()) for i, x in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *told], names=[*part.schema.names, *ANSWER.names])
        finally:
            model.close()

    return requests.mapInArrow(run, schema)


def observed(answers: DataFrame, observation: Observation) -> DataFrame:
    """answers, whose usage the observation tells once an action has read them all: requests, prompt, completion, cache_hit, errors."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "prompt", "completion", "cache_hit")]
    return answers.observe(observation, *sums, F.count("error").alias("errors"))


_PART = T.StructType([T.StructField("block_idx", T.IntegerType()), T.StructField("sent", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY))])
_PARTS = pa.list_(pa.struct([("block_idx", pa.int32()), ("sent", pa.string()), ("entries", ENTRIES)]))
_SINGLE = pa.struct([("translation", pa.string()), ("terms", pa.string())])


@F.arrow_udf(T.ArrayType(_PART))
def _protected(units: pa.Array) -> pa.Array:
    """Blocks of a unit with placeholders, numbered on from block to block."""

    def held(blocks: list) -> list[dict]:
        out, n = [], 0
        for b in blocks:
            sent, entries = protect_text(b["text"], n)
            n += len(entries)
            out.append({"block_idx": b["block_idx"], "sent": sent, "entries": entries})
        return out

    return in_slices(lambda part: [None if u is None else held(u) for u in part], _PARTS, units)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _by_place(replies: pa.Array, sizes: pa.Array) -> pa.Array:
    """Translations of a group's reply by place; null where it has none."""

    def told(reply: str | None, n: int) -> list[str | None]:
        found = parse_group(reply or "", n)
        return [found.get(i) for i in range(n)]

    return in_slices(lambda *part: [told(r, n) for r, n in zip(*part)], pa.list_(pa.string()), replies, sizes)


@F.arrow_udf(T.StructType([T.StructField("translation", T.StringType()), T.StructField("terms", T.StringType())]))
def _single(replies: pa.Array) -> pa.Array:
    def told(reply: str | None) -> dict:
        text, terms = parse_reply(reply or "")
        return {"translation": text, "terms": json.dumps(terms, ensure_ascii=False)}

    return in_slices(lambda part: [told(r) for r in part], _SINGLE, replies)


def _formulas(entries: Column) -> Column:
    """What a request tells of formulas: for the model to read, not to answer with."""
    return F.transform(F.filter(entries, lambda e: ~e["is_ref"]), lambda e: F.struct(e["id"].alias("id"), e["src"].alias("latex"), e["display"].alias("display")))


def group_message(parts: Column) -> Column:
    blocks = F.transform(parts, lambda p, i: F.struct(i.alias("id"), p["sent"].alias("text")))
    return F.to_json(F.struct(blocks.alias("blocks"), F.flatten(F.transform(parts, lambda p: _formulas(p["entries"]))).alias("formulas")))


def single_message(sent: Column, entries: Column) -> Column:
    return F.to_json(F.struct(sent.alias("text"), _formulas(entries).alias("formulas")))


def _prompted(rows: DataFrame, prompts: DataFrame | None, single: Column, words: dict, cell: bool = False) -> DataFrame:
    """rows (doc_id) with system, from prompts (doc_id, summary, glossary: lines), one row a document."""
    if prompts is None:
        rows = rows.withColumns({"_summary": F.lit(""), "_glossary": F.lit("")})
    else:
        told = prompts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("summary").alias("_summary"), F.col("glossary").alias("_glossary"))
        rows = rows.join(large(told), "doc_id", "left")
    given = [F.coalesce(c, F.lit("")) for c in ("_summary", "_glossary")]
    system = F.when(single, system_prompt(*given, cell=cell, words=words)).otherwise(system_prompt(*given, group=True, cell=cell, words=words))
    return rows.withColumn("system", system).drop("_summary", "_glossary")


class Translated(NamedTuple):
    """results: see RESULT, status group, single or given up; usage: doc_id, unit_id, round, error and counters, a row a request."""

    results: DataFrame
    usage: DataFrame


def translate_blocks(units: DataFrame, prompts: DataFrame | None, backend: Callable[[], ChatBackend], settings: Settings = Settings(), rounds: int = 1, words: dict = PROMPT, sleep: Callable[[float], None] = time.sleep) -> Translated:
    """units (doc_id, unit_id, block_idx, text) translated: each unit by one request, and each block that it left open by its own.

    A unit of several blocks is asked for by ids; replies that are no JSON, ids that are absent or none of the unit's, and blank
    translations leave blocks open. These are asked one by one, ``rounds`` times at most, and the loop ends when nothing is open;
    what is open then is given up, with an empty translation. A reference that a reply puts into another block of its unit is
    restored there; marks of authors get their meaning. Blank blocks are left out. prompts: doc_id, summary, glossary.
    Units are of bounded size (see units.pack_units); repeated blocks are asked for each.
    """
    rows = units.where(X.has_text(F.col("text"))).select(F.col("doc_id").cast("string").alias("doc_id"), "unit_id", F.col("block_idx").cast("int").alias("block_idx"), "text")
    grouped = rows.groupBy("doc_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("blocks"))
    asked = grouped.select("doc_id", "unit_id", _protected("blocks").alias("parts"))
    alone = F.size("parts") == 1
    user = F.when(alone, single_message(F.get("parts", F.lit(0))["sent"], F.get("parts", F.lit(0))["entries"])).otherwise(group_message(F.col("parts")))
    first = written(ask(_prompted(asked.withColumn("user", user), prompts, alone, words), backend, settings, sleep), "group_answers")

    refs = F.filter(F.flatten(F.transform("parts", lambda p: p["entries"])), lambda e: e["is_ref"])
    by_place = F.when(alone, F.array(_single("reply")["translation"])).otherwise(_by_place("reply", F.size("parts")))
    terms = F.when(alone, _single("reply")["terms"]).otherwise(F.coalesce(F.get_json_object("reply", "$.terms"), F.lit("[]")))
    told = first.select("doc_id", "unit_id", refs.alias("refs"), by_place.alias("told"), terms.alias("terms"), F.when(alone, "single").otherwise("group").alias("status"), F.posexplode("parts").alias("place", "part"))
    state = told.select("doc_id", "unit_id", "place", "part", "refs", F.get("told", F.col("place")).alias("reply_text"), F.when(F.col("place") == 0, F.col("terms")).otherwise(F.lit("[]")).alias("terms"), "status")
    state = written(state, "round")
    usage = [first.select("doc_id", "unit_id", F.lit(0).alias("round"), "error", *ANSWER.names[2:])]
    filled = F.coalesce(X.has_text(F.col("reply_text")), F.lit(False))
    for n in range(1, rounds + 1):
        open_ = state.where(~filled)
        if open_.isEmpty():
            break
        request = open_.withColumn("user", single_message(F.col("part.sent"), F.col("part.entries")))
        again = written(ask(_prompted(request, prompts, F.lit(True), words), backend, settings, sleep), "single_answers")
        usage.append(again.select("doc_id", "unit_id", F.lit(n).alias("round"), "error", *ANSWER.names[2:]))
        said = again.withColumn("x", _single("reply")).select(*(c for c in state.columns if c not in ("reply_text", "terms", "status")), F.col("x.translation").alias("reply_text"), F.col("x.terms").alias("terms"), F.lit("single").alias("status"))
        state = written(state.where(filled).unionByName(said), "round")
    whole = restore("reply_text", F.concat("part.entries", "refs"))
    done = F.when(filled, X.author_marks(sanitize(whole))).otherwise(F.lit(""))
    results = state.select("doc_id", "part.block_idx", done.alias("translation"), "terms", F.when(filled, F.col("status")).otherwise("given up").alias("status"))
    out = usage[0]
    for more in usage[1:]:
        out = out.unionByName(more)
    return Translated(results, out)


def translate_new(units: DataFrame, prompts: DataFrame | None, backend: Callable[[], ChatBackend], store: ResultStore, settings: Settings = Settings(), **more) -> Translated:
    """As translate_blocks, but only what the store has no result for; results are the store's for all of these units.

    What was given up is not kept, so that another call asks for it again. The store's schema is RESULT.
    """
    keyed = units.withColumns({"doc_id": F.col("doc_id").cast("string"), "block_idx": F.col("block_idx").cast("int")})
    told = translate_blocks(keyed.join(store.latest().select("doc_id", "block_idx"), ["doc_id", "block_idx"], "left_anti"), prompts, backend, settings, **more)
    store.add(told.results.where("status <> 'given up'"))
    wanted = keyed.select("doc_id", "block_idx").distinct()
    return Translated(store.latest().join(wanted, ["doc_id", "block_idx"], "left_semi"), told.usage)


def ask_cells(cells: DataFrame, prompts: DataFrame | None, backend: Callable[[], ChatBackend], settings: Settings = Settings(), words: dict = PROMPT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Table cells (doc_id, text, any more columns) with translation: those that hold English are asked for, each distinct text of a
    document once, with its summary and glossary and the rule for cells; what cannot be translated, fails or comes back blank stays."""
    marked = cells.withColumn("_send", X.is_cell_translatable(F.col("text")))
    texts = marked.where("_send").select(F.col("doc_id").cast("string").alias("doc_id"), "text").distinct()
    held = texts.select("doc_id", "text", F.get(_protected(F.array(F.struct(F.lit(0).alias("block_idx"), "text"))), F.lit(0)).alias("part"))
    request = held.withColumn("user", single_message(F.col("part.sent"), F.col("part.entries")))
    answers = written(ask(_prompted(request, prompts, F.lit(True), words, cell=True), backend, settings, sleep), "cell_answers")
    said = F.trim(restore(_single("reply")["translation"], "part.entries"))
    told = answers.select("doc_id", "text", said.alias("_said")).where((F.col("_said") != "") & (F.col("_said") != SKIP)).withColumnRenamed("doc_id", "_doc")
    met = (F.col("doc_id").cast("string").eqNullSafe(F.col("_doc"))) & (F.col("text") == F.col("_text"))
    both = marked.join(large(told.withColumnRenamed("text", "_text")), met, "left")
    return both.withColumn("translation", F.coalesce("_said", "text")).drop("_send", "_doc", "_text", "_said")


def seed_glossary(blocks: DataFrame, backend: Callable[[], ChatBackend], settings: Settings = Settings(), most: int = 4, words: dict = PROMPT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The glossary that every document of blocks (doc_id, block_idx, kind, text) starts with: doc_id, en_key, ord, zh, en_full, note, seen.

    The fixed first terms, and what the model tells of the first texts of a document, which are asked for at once with these terms
    as its glossary; by the rules of ingest_terms, the fixed terms first. A document without texts, or whose request fails, has
    the fixed terms alone.
    """
    fixed = blocks.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().select("doc_id", F.inline(seed_terms()))
    lines = prompt_lines(fixed).select("doc_id", F.lit(None).cast("string").alias("summary"), F.col("prompt").alias("glossary"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "\n\n")
    texts = seed_texts(blocks, most).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(first.alias("text"))
    units = texts.select("doc_id", F.lit(0).alias("unit_id"), F.lit(0).alias("block_idx"), "text")
    told = translate_blocks(units, lines, backend, settings, rounds=0, words=words, sleep=sleep).results
    terms = F.from_json("terms", "array<struct<en string, zh string, en_full string, note string>>")
    learned = told.select("doc_id", F.posexplode(terms).alias("ord", "x")).select("doc_id", (F.col("ord") + len(SEEDS)).alias("ord"), "x.*")
    known = fixed.select("doc_id", "ord", F.col("en_key").alias("en"), "zh", "en_full", "note")
    return ingest_terms(known.unionByName(learned)).withColumn("seen", F.col("ord") >= len(SEEDS))


def usage_of(usage: DataFrame, *keys: str) -> DataFrame:
    """Usage summed by keys: requests, prompt, completion, cache_hit."""
    return usage.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("requests", "prompt", "completion", "cache_hit")))
