"""What is settled for a paper before its units are translated: its summary, and the abbreviations it defines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.protect import protect_text, restore_text, sanitize_text
from quillspark.operators.glossary import FIRST_USE, KEEP, add_terms, first_uses, ingest_terms
from quillspark.operators.translate import RESULT, TranslatorBackend, glossary_maps, parse_reply, summary_text, text_to_translate
from quillspark.operators.units import abstract_or_first

#: What stands for a summary where none was made, by what is known of a paper.
ANCHORS = {
    "both": "本文标题：《{title}》。摘要要点：{abstract}。请据此判断本文的核心任务/方法/立场（如提出新方法、理论分析或实证研究），并始终与摘要立场保持一致。",
    "title": "本文标题：《{title}》。翻译时保持全文立场与标题一致。",
    "none": "翻译时保持全文立场一致，不得引入与上下文相悖的幻觉内容。",
}


def anchor(title: Column, abstract: Column, most: int = 600) -> Column:
    """What stands for a summary: title and the first ``most`` characters of the abstract, or the title, or neither."""
    named = lambda which: F.replace(F.lit(ANCHORS[which]), F.lit("{title}"), title)
    # the abstract is put in around the title, so that braces in a title mean nothing
    before, after = ANCHORS["both"].split("{abstract}")
    both = F.concat(F.replace(F.lit(before), F.lit("{title}"), title), X.shortened(abstract, most), F.lit(after))
    return F.when((title != "") & (abstract != ""), both).when(title != "", named("title")).otherwise(F.lit(ANCHORS["none"]))


def summaries(blocks: DataFrame, backend: Callable[[], TranslatorBackend], most: int = 0) -> DataFrame:
    """blocks (doc_id, block_idx, kind, section, text) to doc_id, summary.

    The backend is asked once a paper that has a title (the last one) or an abstract (its paragraphs, else the first three);
    most shortens the abstract for it, 0 does not. A reply that is blank, or a request that fails, gives the anchor.
    """
    filled = blocks.where("text <> ''")
    named = F.col("block_idx").isNotNull() & (F.col("kind") == "title") & (F.col("text") != "")
    heads = blocks.groupBy("doc_id").agg(F.max_by("text", F.when(named, F.col("block_idx"))).alias("title"))
    told = heads.join(abstract_or_first(filled), "doc_id", "left")
    clean = lambda c: X.strip(F.coalesce(c, F.lit("")))
    asked = told.select("doc_id", clean("title").alias("title"), clean("summary").alias("abstract"))
    sent = F.when(F.length("abstract") > most, F.concat(F.rtrim(F.substring("abstract", 1, most)), F.lit("…"))).otherwise(F.col("abstract")) if most else F.col("abstract")
    asked = asked.withColumn("sent", sent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        model.open()

        def ask(title: str, abstract: str) -> str:
            if not title and not abstract:
                return ""
            try:
                return model.summarise(title, abstract) or ""
            except Exception:  # a paper without a summary is still translated
                return ""

        try:
            for batch in batches:
                yield batch.assign(raw=[ask(t, a) for t, a in zip(batch["title"], batch["sent"])])
        finally:
            model.close()

    schema = ", ".join(f"{n} {t}" for n, t in [*asked.dtypes, ("raw", "string")])
    said = F.nullif(X.strip(summary_text(F.col("raw"))), F.lit(""))
    return asked.mapInPandas(run, schema).select("doc_id", F.coalesce(said, anchor(F.col("title"), F.col("abstract"))).alias("summary"))


def _learn(known: dict[str, str], terms: list, said: str) -> None:
    """Terms of one reply into what is known; by the rules of ingest_terms, then first uses where there is no Chinese yet."""
    for t in terms:
        en, zh = (str(t.get(k) or "").strip() for k in ("en", "zh")) if isinstance(t, dict) else ("", "")
        had = known.get(en.lower(), "")
        if en and zh and had != KEEP and not (zh == KEEP and had):
            known[en.lower()] = zh
    for en, _, zh in re.findall(FIRST_USE, said):
        known[en.strip().lower()] = known.get(en.strip().lower()) or zh.strip()


def prewarm(blocks: DataFrame, glossary: DataFrame, backend: Callable[[], TranslatorBackend]) -> DataFrame:
    """Results (see RESULT) of those blocks that are likely to define abbreviations (doc_id, block_idx, kind, text, caption).

    Within a document they are translated one after the other, each with the terms of those before; documents go side by
    side, and a task holds the terms of one document at a time. Blank blocks have no result. What was learned is in
    learned_terms; resume leaves these blocks out of the units.
    """
    doc = F.col("doc_id").cast("string").alias("doc_id")
    wanted = blocks.where(X.defines_abbreviation(F.col("kind"), F.col("text"))).select(doc, "block_idx", text_to_translate(F.col("kind"), F.col("text"), F.col("caption")).alias("text"))
    rows = wanted.where(X.strip(F.col("text")) != "").join(glossary_maps(glossary), "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "block_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        model.open()
        current, known = object(), {}
        try:
            for batch in batches:
                out = []
                for doc_id, idx, text, terms in zip(batch["doc_id"], batch["block_idx"], batch["text"], batch["terms"]):
                    if doc_id != current:
                        current, known = doc_id, dict(terms or {})
                    sent, entries = protect_text(text)
                    said, found = parse_reply(model.translate([sent], dict(known))[0])
                    said = sanitize_text(restore_text(said, entries))
                    _learn(known, found, said)
                    out.append((doc_id, int(idx), said, json.dumps(found, ensure_ascii=False), len(sent) // 4 + 1, len(said) // 4 + 1))
                yield pd.DataFrame(out, columns=["doc_id", "block_idx", "translation", "terms", "prompt_tokens", "completion_tokens"])
        finally:
            model.close()

    return rows.mapInPandas(run, RESULT)


def learned_terms(results: DataFrame) -> DataFrame:
    """Glossary (doc_id, en_key, ord, zh, en_full, note, seen) of what results tell: their terms in order, blanks filled by first uses."""
    told = F.from_json("terms", "array<struct<en string, zh string, en_full string, note string>>")
    order = Window.partitionBy("doc_id").orderBy("block_idx", "n")
    events = results.select("doc_id", "block_idx", F.posexplode(told).alias("n", "x")).select("doc_id", F.row_number().over(order).alias("ord"), "x.*")
    uses = first_uses(results.select("doc_id", "block_idx", "translation")).withColumn("n", F.col("ord"))
    uses = uses.select("doc_id", X.term_key(F.col("en")).alias("en_key"), F.row_number().over(order).alias("ord"), "zh", "en_full", F.lit(None).cast("string").alias("note"), F.lit(True).alias("seen"))
    return add_terms(ingest_terms(events), uses)


def distinct_formulas(formulas: DataFrame) -> DataFrame:
    """Formulas (tex, display), one row for each that looks different: key, a hash of both, tex, display, uses."""
    key = F.when(F.col("display"), X.formula_key(F.col("tex"), True)).otherwise(X.formula_key(F.col("tex"), False))
    return formulas.groupBy("tex", "display").agg(F.count(F.lit(1)).alias("uses")).select(key.alias("key"), "tex", "display", "uses")
