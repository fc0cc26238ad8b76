"""Translation of units by a pluggable backend, with resume, repair and reassembly.

A backend is opened once a partition and translates batches; nothing here needs a network. Formulas and references are
protected before and restored after, with ids of their own in a unit, so that a reference which a reply puts into another
block of the unit is restored there. ``store`` keeps results by version, each run seen whole or not at all; ``stored`` reads the
latest of them and ``resume`` leaves out what it holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.protect import protect_text, restore_text, sanitize_text, split_cells
from quillspark.operators.glossary import needs_repair
from quillspark.operators.store import ResultStore
from quillspark.shared import large, spread

RESULT = "doc_id string, block_idx int, translation string, terms string, prompt_tokens long, completion_tokens long"
SKIP = "⟦SKIP⟧"
#: Units of a document that share a row with its glossary.
PART = 64


class TranslatorBackend(Protocol):
    """open once a partition; translate gets protected texts with the document's glossary and gives replies, summarise a reply or nothing."""

    def open(self) -> None: ...

    def translate(self, texts: list[str], glossary: dict[str, str], cell: bool = False) -> list[str]: ...

    def summarise(self, title: str, abstract: str) -> str: ...

    def close(self) -> None: ...


class IdentityBackend:
    """Gives back what it gets, as a reply."""

    def open(self) -> None:
        pass

    def translate(self, texts: list[str], glossary: dict[str, str], cell: bool = False) -> list[str]:
        return [json.dumps({"translation": t, "terms": []}, ensure_ascii=False) for t in texts]

    def summarise(self, title: str, abstract: str) -> str:
        return ""

    def close(self) -> None:
        pass


class DictionaryBackend(IdentityBackend):
    """Replaces the glossary's terms; deterministic, for tests and dry runs."""

    def translate(self, texts: list[str], glossary: dict[str, str], cell: bool = False) -> list[str]:
        out = []
        for t in texts:
            for en, zh in glossary.items():
                if zh and zh != "<KEEP>":
                    t = re.sub(rf"(?<!\w){re.escape(en)}(?!\w)", zh, t, flags=re.IGNORECASE)
            out.append(t)
        return super().translate(out, glossary, cell)


def parse_reply(raw: str) -> tuple[str, list[dict]]:
    """Translation and terms of a reply: JSON, JSON inside other text, or plain text; terms that are no objects are left out."""
    for part in [raw, *re.findall(r"\{(?:[^{}]|\{[^{}]*\})*\}", raw or "", re.DOTALL)]:
        try:
            told = json.loads(part)
        except (TypeError, ValueError):
            continue
        if isinstance(told, dict) and "translation" in told:
            terms = told.get("terms")
            return str(told["translation"] or ""), [t for t in terms if isinstance(t, dict)] if isinstance(terms, list) else []
    return raw or "", []


def summary_text(raw: Column) -> Column:
    """The summary in a reply: a JSON string; of an object the first known key that holds a string, else all its strings, a line
    each; any other reply as it is."""
    told = F.try_parse_json(raw)
    kind = F.schema_of_variant(told)
    values = F.from_json(raw, "map<string,variant>")
    is_string = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    known = [F.when(is_string(F.try_element_at(values, F.lit(k))), F.try_variant_get(F.try_element_at(values, F.lit(k)), "$", "string")) for k in ("summary", "摘要", "translation", "text", "result")]
    strings = F.transform(F.filter(F.map_values(values), is_string), lambda v: F.try_variant_get(v, "$", "string"))
    every = F.when(F.size(strings) > 0, F.array_join(strings, "\n"))
    return F.when(kind == "STRING", F.try_variant_get(told, "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(*known, every, raw)).otherwise(raw)


def text_to_translate(kind: Column, text: Column, caption: Column) -> Column:
    return F.when(kind.isin("equation", "figure", "table", "listing"), F.coalesce(caption, F.lit(""))).otherwise(text)


def _whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that no unit lies in two: the last unit of each waits for the next."""
    left = None
    for batch in batches:
        batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
        last = batch.iloc[-1] if len(batch) else None
        if last is not None:
            open_ = (batch["doc_id"] == last["doc_id"]) & (batch["unit_id"] == last["unit_id"])
            left = batch[open_]
            if not open_.all():
                yield batch[~open_]
    if left is not None and len(left):
        yield left


def glossary_maps(glossary: DataFrame) -> DataFrame:
    """doc_id (string) and terms, a map from key to Chinese; of a key that is there twice the first by ord counts, or without an
    ord the least Chinese."""
    keyed = glossary.select(F.col("doc_id").cast("string").alias("doc_id"), "en_key", F.coalesce("zh", F.lit("")).alias("zh"), (F.col("ord") if "ord" in glossary.columns else F.lit(0)).alias("ord"))
    one = keyed.where(F.col("en_key").isNotNull()).groupBy("doc_id", "en_key").agg(F.min(F.struct("ord", "zh"))["zh"].alias("zh"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("en_key", "zh"))).alias("terms"))


def translate_units(units: DataFrame, glossary: DataFrame | None, backend: Callable[[], TranslatorBackend], tasks: int | None = None) -> DataFrame:
    """units (doc_id, unit_id, block_idx, text) to results (see RESULT); blank texts are dropped before any Python runs.

    glossary: doc_id, en_key, zh; it is collected per document (a paper's own terms) and sent once for each PART units. tasks
    bounds how many backends are open.
    """
    rows = units.where(X.has_text(F.col("text"))).select(F.col("doc_id").cast("string").alias("doc_id"), F.floor(F.col("unit_id") / PART).alias("part"), "unit_id", "block_idx", "text")
    terms = F.lit(None).cast("map<string,string>").alias("terms")
    both = rows.select("*", terms, F.lit(1).alias("kind"))
    if glossary is not None:  # a row of its own before the units of each part, no column of all
        held = glossary_maps(glossary).join(rows.select("doc_id", "part").distinct(), "doc_id")
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("unit_id", "block_idx", "text")]
        both = both.unionByName(held.select("doc_id", "part", *none, "terms", F.lit(0).alias("kind")))
    dealt = both.repartition(tasks, "doc_id", "part") if tasks else both.repartition("doc_id", "part")
    rows = dealt.sortWithinPartitions("doc_id", "part", "kind", "unit_id", "block_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        model.open()
        try:
            now, known = None, {}
            for batch in _whole_units(batches):
                out = []
                for key, unit in batch.groupby(["doc_id", "part", "kind", "unit_id"], sort=False, dropna=False):
                    if key[:2] != now:
                        now, known = key[:2], {}
                    if key[2] == 0:
                        known = dict(unit["terms"].iloc[0])
                        continue
                    held, every = [], []
                    for t in unit["text"]:
                        held.append(protect_text(t, len(every)))
                        every += held[-1][1]
                    replies = model.translate([t for t, _ in held], known)
                    replies += [None] * (len(held) - len(replies))  # a short answer: ask for the rest one by one
                    for doc, idx, (sent, entries), reply in zip(unit["doc_id"], unit["block_idx"], held, replies):
                        reply = reply if reply is not None else model.translate([sent], known)[0]
                        said, found = parse_reply(reply)
                        salvaged = [e for e in every if e["is_ref"] and e not in entries]
                        said = sanitize_text(restore_text(said, entries + salvaged))
                        out.append((doc, int(idx), said, json.dumps(found, ensure_ascii=False), len(sent) // 4 + 1, len(said) // 4 + 1))
                yield pd.DataFrame(out, columns=["doc_id", "block_idx", "translation", "terms", "prompt_tokens", "completion_tokens"])
        finally:
            model.close()

    return rows.mapInPandas(run, RESULT)


def translate_cells(cells: DataFrame, backend: Callable[[], TranslatorBackend]) -> DataFrame:
    """Table cells (doc_id, table_idx, r, c, text) with translation: only cells that hold English are sent."""
    marked = cells.withColumn("send", F.coalesce(X.is_cell_translatable(F.col("text")), F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        model.open()
        try:
            for batch in batches:
                sent, texts = batch.pop("send"), batch["text"].copy()
                held = [protect_text(t) for t in texts[sent]]
                said = [restore_text(parse_reply(r)[0], e) for r, (_, e) in zip(model.translate([t for t, _ in held], {}, cell=True), held)] if held else []
                texts[sent] = [t if s is None or s.strip() == SKIP else s for s, t in zip(said, texts[sent])]
                yield batch.assign(translation=texts)
        finally:
            model.close()

    schema = ", ".join(f"{n} {t}" for n, t in [*cells.dtypes, ("translation", "string")])
    return marked.mapInPandas(run, schema)


def table_cells(tables: DataFrame) -> DataFrame:
    """Cells of Markdown tables (doc_id, block_idx, table_md): doc_id, block_idx, r, c, text; other lines are rows without cells."""
    lines = tables.select("doc_id", "block_idx", F.posexplode(F.split("table_md", "\n")).alias("r", "line"))
    cells = lines.withColumn("cells", split_cells("line"))
    return cells.select("doc_id", "block_idx", "r", F.posexplode("cells").alias("c", "text"))


def translate_tables(tables: DataFrame, backend: Callable[[], TranslatorBackend] | None, cells: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """tables (doc_id, block_idx, table_md) with table_zh: the same table with those cells translated that hold English, by the
    backend or by cells, which gives cells (doc_id, text, ...) a translation (see requests.ask_cells).

    Separator rows and lines that are no rows stay as they are, bars in cells are escaped again. Cells are sent from any
    table; rows are put together again by one aggregate a row and one a table, and no line meets its cells in a join.
    """
    key = ["doc_id", "block_idx"]
    lines = spread(tables.select(*key, "table_md"), *key).select(*key, F.posexplode(F.split("table_md", "\n")).alias("r", "line")).withColumn("cells", split_cells("line"))
    is_row = (F.size("cells") > 0) & ~F.forall("cells", is_separator)
    sent = lines.where(is_row).select(*key, "r", F.posexplode("cells").alias("c", "text"))
    told = cells(sent) if cells else translate_cells(sent, backend)
    escaped = F.replace("translation", F.lit("|"), F.lit("\\|"))
    ordered = F.array_sort(F.collect_list(F.struct("c", escaped.alias("t"))))
    rows = told.groupBy(*key, "r").agg(F.concat(F.lit("| "), F.array_join(F.transform(ordered, lambda x: x["t"]), " | "), F.lit(" |")).alias("line"))
    both = rows.unionByName(lines.where(~is_row).select(*key, "r", "line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return tables.join(large(both.groupBy(*key).agg(whole.alias("table_zh"))), key, "left")


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows of Markdown tables (doc_id, block_idx, table_md): doc_id, block_idx, r, cells; lines that are blank or separators, or hold
    no cells, are none and have no number."""
    lines = F.filter(F.split("table_md", "\n"), lambda x: X.has_text(x) & ~X.strip(x).rlike(r"^\|?[\s:\-|]*-[\s:\-|]*$"))
    rows = tables.select("doc_id", "block_idx", F.posexplode(lines).alias("r", "line"))
    return rows.select("doc_id", "block_idx", "r", split_cells("line").alias("cells")).where(F.size("cells") > 0)


def is_separator(cell: Column) -> Column:
    """Whether a cell is dashes, as all cells of a separator row are."""
    return F.trim(cell).rlike("^:?-{3,}:?$")


def table_counts(tables: DataFrame) -> DataFrame:
    """Per document how many tables are HTML and how many Markdown, and how many cells of the latter would be sent."""
    is_html = F.lower(F.ltrim("table_md")).startswith("<table")
    kinds = tables.groupBy("doc_id").agg(F.count_if(is_html).alias("html_tables"), F.count_if(~is_html).alias("markdown_tables"))
    sent = table_cells(tables.where(~is_html)).groupBy("doc_id").agg(F.count_if(X.is_cell_translatable(F.col("text"))).alias("cells"))
    return kinds.join(sent, "doc_id", "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))


def structure_markdown(kind: Column, translation: Column, src: Column, local_src: Column, listing_md: Column, table_zh: Column) -> Column:
    """Figures, listings and tables as Markdown, the caption below."""
    caption, image = F.nullif(translation, F.lit("")), F.coalesce(F.nullif(local_src, F.lit("")), F.nullif(src, F.lit("")))
    shown = F.concat(F.lit("![figure]("), image, F.lit(")\n\n> "))
    figure = F.when(caption.isNotNull(), F.concat(F.coalesce(shown, F.lit("> ")), caption)).otherwise(F.coalesce(F.rtrim(shown), F.lit(">")))
    below = lambda body, none: F.coalesce(F.nullif(F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.concat(F.lit("> "), caption)), F.lit("")), F.lit(none))
    return F.when(kind == "figure", figure).when(kind == "listing", below(listing_md, "(伪代码)")).when(kind == "table", below(table_zh, "(表格)"))


#: Wording of prompts; another can be given.
PROMPT = {
    "intro": "You translate scientific papers from English into Chinese.",
    "rules": ("1. Leave every placeholder in ⟦ ⟧ as it is.", "2. Translate all of the text and nothing else.", "3. Keep names of models, data sets and people in English."),
    "summary": "{n}. What the paper is about: {summary}",
    "glossary": "{n}. Terms:\n{glossary}",
    "cell": "{n}. The text is a table cell; where nothing can be translated, answer {marker}.",
    "single": 'Answer with JSON: {"translation": "...", "terms": [{"en": "...", "zh": "..."}]}',
    "group": 'Answer with JSON: {"blocks": [{"id": 0, "translation": "..."}], "terms": [{"en": "...", "zh": "..."}]}',
}


def system_prompt(summary: Column, glossary: Column, group: bool = False, cell: bool = False, words: dict = PROMPT) -> Column:
    """What a backend is told: intro, rules, and by need the summary, the terms and the rule for cells, numbered on; then the form."""
    given = [F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in (summary, glossary)]
    first = len(words["rules"])

    def rule(name: str, n: Column, **values: Column) -> Column:
        out = F.replace(F.lit(words[name]), F.lit("{n}"), n.cast("string"))
        for k, v in values.items():
            out = F.replace(out, F.lit("{" + k + "}"), v)
        return out

    parts = [F.lit(words["intro"]), *map(F.lit, words["rules"]), F.lit("")]
    parts.append(F.when(given[0] == 1, rule("summary", F.lit(first + 1), summary=summary)))
    parts.append(F.when(given[1] == 1, rule("glossary", first + 1 + given[0], glossary=glossary)))
    if cell:
        parts.append(rule("cell", first + 1 + given[0] + given[1], marker=F.lit(SKIP)))
    return F.concat_ws("\n\n", *parts, F.lit(words["group" if group else "single"]))


def parse_group(raw: str, size: int) -> dict[int, str]:
    """Translations of a group's reply by place; ids that are no place, or no numbers, are left out."""
    for part in [raw, *re.findall(r"\{.*\}", raw or "", re.DOTALL)]:
        try:
            blocks = json.loads(part).get("blocks")
        except (TypeError, ValueError, AttributeError):
            continue
        if isinstance(blocks, list):
            told = ((b.get("id"), b.get("translation")) for b in blocks if isinstance(b, dict))
            return {i: str(t or "") for i, t in told if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < size}
    return {}


def store(results: DataFrame, path: str, version: int) -> None:
    """Add results under a version; what fails half-way is not seen (see store.ResultStore, which also compacts and clears)."""
    ResultStore(results.sparkSession, path, version, RESULT).add(results)


def stored(spark: SparkSession, path: str, version: int, policy: str = "auto", skip_damaged: bool = False) -> DataFrame:
    """Results of that version, the latest of each block, with the version; none where nothing is there or the policy is "never".

    A file that can't be read is an error, so that nobody pays twice unawares; with skip_damaged its results count as absent, and
    ResultStore.damaged names it.
    """
    kept = ResultStore(spark, path, version, RESULT)
    found = spark.createDataFrame([], RESULT) if policy == "never" else kept.latest(skip_damaged)
    return found.withColumn("version", F.lit(version))


def translate_stored(units: DataFrame, glossary: DataFrame | None, backend: Callable[[], TranslatorBackend], path: str, version: int, policy: str = "auto") -> DataFrame:
    """All results of the units: what is stored, and the rest translated, stored and read back. With the policy "never" all
    are translated again, and what is new counts."""
    spark, keyed = units.sparkSession, units.withColumn("doc_id", F.col("doc_id").cast("string"))
    store(translate_units(resume(keyed, stored(spark, path, version, policy), version), glossary, backend), path, version)
    return stored(spark, path, version).join(keyed.select("doc_id", "block_idx").distinct(), ["doc_id", "block_idx"], "left_semi")


def repaired(results: DataFrame, units: DataFrame, glossary: DataFrame, backend: Callable[[], TranslatorBackend], mode: str = "intended") -> DataFrame:
    """Results with those translated again, one by one, that break a rule of needs_repair; what still breaks one stays as it was."""
    keyed = units.withColumn("doc_id", F.col("doc_id").cast("string"))
    told = results.join(keyed.select("doc_id", "block_idx", "text"), ["doc_id", "block_idx"])
    terms = glossary.withColumn("doc_id", F.col("doc_id").cast("string"))
    wrong = needs_repair(told, terms, mode).select("doc_id", "block_idx")
    alone = keyed.join(wrong, ["doc_id", "block_idx"], "left_semi").withColumn("unit_id", F.col("block_idx"))
    again = translate_units(alone, glossary, backend)
    said = again.join(keyed.select("doc_id", "block_idx", "text"), ["doc_id", "block_idx"])
    still = needs_repair(said, terms, mode).select("doc_id", "block_idx")
    return merged(results, again.join(still, ["doc_id", "block_idx"], "left_anti"))


def resume(units: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """Blocks without a stored result of this version."""
    return units.join(stored.where(F.col("version") == version).select("doc_id", "block_idx"), ["doc_id", "block_idx"], "left_anti")


def merged(results: DataFrame, repaired: DataFrame) -> DataFrame:
    """Results with those that were made again in their place."""
    again = repaired.select("doc_id", "block_idx", F.col("translation").alias("_again"))
    out = results.join(again, ["doc_id", "block_idx"], "left").withColumn("translation", F.coalesce("_again", "translation"))
    return out.drop("_again")


def render_markdown(blocks: DataFrame, results: DataFrame, tables: DataFrame | None = None, source: str = "https://arxiv.org/abs/", notice: str = "") -> DataFrame:
    """Per document its Markdown: a header of title, source and notice, then its blocks in order, spaced.

    Figures show their image, stored where it has been, with the caption below; listings and tables stand above theirs. A
    caption, and a table that tables (doc_id, block_idx, table_zh) lacks, stay as they were where there is no translation. Marks
    of paragraphs become paragraphs, and none is left. Columns: doc_id, title and title_zh (for names of files), markdown.
    """
    from quillspark.functions.protect import space_protected
    from quillspark.operators.units import assembled

    told = blocks.join(large(results.select("doc_id", "block_idx", "translation")), ["doc_id", "block_idx"], "left")
    if tables is None:
        told = told.withColumn("table_zh", F.lit(None).cast("string"))
    else:
        told = told.join(large(tables.select("doc_id", "block_idx", "table_zh")), ["doc_id", "block_idx"], "left")
    filled = lambda *columns: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.lit(""))
    shown = structure_markdown(F.col("kind"), filled("translation", "caption"), F.col("src"), F.col("local_src"), F.col("listing_md"), filled("table_zh", "table_md"))
    raw = F.coalesce(shown, F.col("raw"), F.lit(""))
    shown = told.withColumn("shown", X.block_markdown(F.col("kind"), F.col("level"), F.col("text"), raw, filled("translation")))
    unmarked = lambda c: X.strip(F.regexp_replace(c, X.NEWPAR, ""))
    first = lambda c: F.min_by(F.nullif(unmarked(F.col(c)), F.lit("")), F.when(F.col("kind") == "title", F.col("block_idx")))
    # one aggregate a document, so that blocks are read and joined once
    joined = shown.groupBy("doc_id").agg(assembled("shown", F.col("kind") != "title").alias("markdown"), first("text").alias("title"), first("translation").alias("title_zh"))
    head = F.concat(F.lit("# "), F.coalesce("title_zh", "title", F.col("doc_id")), F.lit(f"\n\n> 原文: {source}"), "doc_id", F.lit(f"\n> {notice}" if notice else ""), F.lit("\n\n---\n\n"))
    text = F.regexp_replace(space_protected(F.concat("markdown", F.lit("\n"))), X.NEWPAR, "")
    return joined.select("doc_id", "title", "title_zh", F.concat(head, text).alias("markdown"))


def write_papers(papers: DataFrame, path: str, mode: str = "id", glossaries: DataFrame | None = None) -> None:
    """papers (see render_markdown) as files <name>.zh.md, with <name>.glossary.json of glossaries (doc_id, glossary_json), all of
    them or none; mode says which name: id, title or title_zh."""
    from quillspark.sources.files import file_names, write_files

    named = file_names(papers, mode)
    out = named.select(F.concat("stem", F.lit(".zh.md")).alias("name"), F.col("markdown").alias("content"))
    if glossaries is not None:
        told = named.select("doc_id", "stem").join(glossaries, "doc_id")
        out = out.unionByName(told.select(F.concat("stem", F.lit(".glossary.json")).alias("name"), F.col("glossary_json").alias("content")))
    write_files(out, path)


def export_formats(value: Column) -> Column:
    """Formats asked for: docx, pdf; docx_pdf and all mean both."""
    asked = F.transform(F.split(F.replace(value, F.lit("，"), F.lit(",")), ","), lambda x: F.lower(F.trim(x)))
    both = F.exists(asked, lambda x: x.isin("all", "docx_pdf"))
    return F.when(both, F.array(F.lit("docx"), F.lit("pdf"))).otherwise(F.filter(asked, lambda x: x.isin("docx", "pdf")))
