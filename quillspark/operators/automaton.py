"""Many terms sought in many texts at once: those that are one word by a look at a text's words, the others by an automaton."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import large

#: Texts of a document that one automaton serves; a document with more has it built once for each such part.
PART = 4096
#: Terms of a document in a row, on their way to the task that seeks them.
ENTRIES = 512
_WORDS = re.compile(r"\w+")


def folded(text: str) -> str:
    """In lower case, character by character, so that places stay what they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("ς", "σ")


class Automaton:
    """Finds all of its terms that stand as words in a text, whatever their case, overlapping ones too.

    No letter, digit or underscore may touch a term, so a term that is made of these alone is one whole word of the text.
    """

    def __init__(self, terms: list[str]) -> None:
        self.places: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            if term:
                self.places.setdefault(folded(term), []).append(i)
        others = [term for term in self.places if not term.isalnum() and not _WORDS.fullmatch(term)]
        self.simple = len(others) < len(self.places)
        self.machine = ahocorasick.Automaton() if others else None
        for term in others:
            self.machine.add_word(term, term)
        if others:
            self.machine.make_automaton()

    def found(self, text: str | None) -> Iterator[int]:
        """Places of the terms in the list given, each once; no letter, digit or underscore may touch a term in the text."""
        if not self.places or not text:
            return
        low, done = folded(text), set()
        if self.simple:
            for term in self.places.keys() & set(_WORDS.findall(low)):
                yield from self.places[term]
        for end, term in self.machine.iter(low) if self.machine else ():
            if term not in done and not _joins(low, end + 1) and not _joins(low, end - len(term)):
                done.add(term)
                yield from self.places[term]


def _joins(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def by_glossary(texts: DataFrame, glossary: DataFrame, judge: Callable[[Automaton, list[tuple], list[str | None]], bool], columns: list[str], terms: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """The rows of texts, by doc_id and block_idx, for which judge(automaton, terms, values of columns) says yes.

    glossary: doc_id, en_key and the other columns in terms, which starts with en_key; or doc_id and entries, an array of structs of
    these, where they are gathered already. blocks: doc_id and block_idx of all texts, or of more, where these cost less to make
    than texts. Terms are gathered by document and pass in rows of ENTRIES; these and the texts are exchanged by document and part
    of PART blocks, and pass as a sorted stream, terms first: no text meets a term in a join, and a task holds one glossary at a time. Rows without a doc_id have no glossary; a document without terms has no
    automaton and none of its rows is told.
    """
    part = F.floor(F.coalesce(F.col("block_idx").cast("long"), F.lit(0)) / PART).alias("part")
    told = texts.where(F.col("doc_id").isNotNull()).select("doc_id", part, "block_idx", *columns)
    parts = (texts if blocks is None else blocks).where(F.col("doc_id").isNotNull()).select("doc_id", part).groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    named = glossary.where(F.col("doc_id").isNotNull())
    if "entries" in glossary.columns:
        named = named.select("doc_id", F.filter("entries", lambda e: e["en_key"] != "").alias("all"))
    else:
        named = named.where(F.col("en_key") != "").groupBy("doc_id").agg(F.collect_list(F.struct(*terms)).alias("all"))
    rows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(ENTRIES)), lambda i: F.slice("all", i, F.lit(ENTRIES)))
    sought = large(named).join(parts, "doc_id").select("doc_id", F.explode("parts").alias("part"), rows.alias("rows")).select("doc_id", "part", F.explode("rows").alias("entries"))
    none = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    both = sought.select("doc_id", "part", F.lit(0).alias("kind"), *none(told, ["block_idx", *columns]), "entries")
    both = both.unionByName(told.select("doc_id", "part", F.lit(1).alias("kind"), "block_idx", *columns, *none(sought, ["entries"])))
    both = both.repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "kind")
    out = told.select("doc_id", "block_idx").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, automaton = None, [], None
        for batch in batches:
            docs, numbers, kinds = (batch.column(n).to_pylist() for n in ("doc_id", "part", "kind"))
            held = batch.column("entries")
            ends, words = held.offsets.to_pylist(), [held.values.field(t).to_numpy(zero_copy_only=False).tolist() for t in terms]
            values = [batch.column(c) for c in columns]
            yes = []
            for i, key in enumerate(zip(docs, numbers)):
                if key != now:
                    now, entries, automaton = key, [], None
                if kinds[i] == 0:
                    entries += zip(*(w[ends[i] : ends[i + 1]] for w in words))
                elif entries:
                    automaton = automaton or Automaton([e[0] for e in entries])
                    if judge(automaton, entries, [v[i].as_py() for v in values]):
                        yes.append(i)
            yield batch.select(["doc_id", "block_idx"]).take(pa.array(yes, pa.int64()))

    return both.mapInArrow(run, out)
