"""Glossaries: merging of term events under conflict rules, and terms found in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip, term_key

KEEP = "<KEEP>"
#: First terms of every glossary.
SEEDS = {
    "alignment": ("对齐", "ML 领域指模型对齐，勿译“齐整/整齐”"),
    "artifacts": ("伪影", "CV/图像/信号中指非预期的结构或瑕疵，勿译“副产物”"),
    "probe": ("探针", "作为名词统一为“探针”（如线性探针），勿用动词“探测”"),
    "probes": ("探针", "probe 复数，统一为“探针”"),
    "split": ("数据集划分", "指数据集的 subset/split，译“划分”或“子集”，勿译“分割”(segmentation)"),
}
#: How definitions look.
EQUALS = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9.\-]{0,14})\s*[:=]\s*([A-Za-z][A-Za-z0-9 \-]*(?:[A-Za-z0-9]))(?=[,;.)\]\n]|\z)"
BRACKETS = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9.\-]{0,14})\s*\(([A-Za-z][A-Za-z0-9 \-]+?)\)"
FIRST_USE = r"([A-Za-z][A-Za-z0-9\-/]{1,})（([^,，]+?)[,，]\s*([^）]+?)）"


def seed_terms() -> Column:
    """The first terms as an array of structs, to be inlined for every document."""
    terms = enumerate(SEEDS.items())
    none = F.lit(None).cast("string").alias("en_full")
    return F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("en_key"), F.lit(zh).alias("zh"), none, F.lit(note).alias("note"), F.lit(False).alias("seen")) for i, (k, (zh, note)) in terms))


def seeds(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(seed_terms()))


def _first(value: Column, ord_: str) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(ord_)))


def _filled(name: str) -> Column:
    return F.nullif(strip(F.col(name)), F.lit(""))


def ingest_terms(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Terms in order (keys, ord, en, zh, en_full, note) to a glossary: a term first kept in English stays so; otherwise the
    last Chinese wins and a later wish to keep English is ignored; the first full name and note stand."""
    full = events.where(_filled("en").isNotNull() & _filled("zh").isNotNull()).withColumn("en_key", term_key(F.col("en")))
    zh = F.col("zh")
    first = F.min_by(zh, F.col("ord"))
    last = F.max_by(zh, F.when(zh != KEEP, F.col("ord")))
    return full.groupBy(*keys, "en_key").agg(
        F.min("ord").alias("ord"),
        F.when(first == KEEP, F.lit(KEEP)).otherwise(last).alias("zh"),
        _first(F.when(F.lit(True), _filled("en_full")), "ord").alias("en_full"),
        _first(_filled("note"), "ord").alias("note"),
        F.lit(True).alias("seen"),
    )


def finalize_terms(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Terms of all results to one glossary: a wish to keep English wins; otherwise the first Chinese; blanks are filled until
    the term is locked."""
    told = events.where(_filled("en").isNotNull()).withColumn("en_key", term_key(F.col("en")))
    lock = F.min(F.when(F.col("zh") == KEEP, F.col("ord"))).over(Window.partitionBy(*keys, "en_key"))
    told = told.withColumn("open", F.coalesce(F.col("ord") <= lock, F.lit(True)))
    fill = lambda c: _first(F.when(F.col("open"), _filled(c)), "ord").alias(c)
    kept = F.max(F.col("zh") == KEEP)
    return told.groupBy(*keys, "en_key").agg(F.min("ord").alias("ord"), F.when(kept, F.lit(KEEP)).otherwise(_first(_filled("zh"), "ord")).alias("zh"), fill("en_full"), fill("note"))


def add_terms(glossary: DataFrame, more: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Both glossaries; the first one's values win, blanks are filled from the second."""
    both = glossary.withColumn("_p", F.lit(0)).unionByName(more.withColumn("_p", F.lit(1)))
    order = F.struct("_p", "ord")
    pick = lambda c: F.min_by(_filled(c), F.when(_filled(c).isNotNull(), order)).alias(c)
    return both.groupBy(*keys, "en_key").agg(F.min(order)["ord"].alias("ord"), pick("zh"), pick("en_full"), pick("note"), F.max("seen").alias("seen"))


def abbreviations(texts: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Abbreviations that texts define, with full names, first definition first: the columns of texts but the text, ord, en, en_full.
    Those that known (doc_id, en_key), a glossary, has already are left out."""
    rest = [c for c in texts.columns if c != text]
    found = []
    for p in (EQUALS, BRACKETS):
        pairs = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(k)).alias(n) for k, n in ((1, "en"), (2, "en_full"))))
        found.append(F.transform(pairs, lambda x: F.struct(x["en"].alias("en"), strip(x["en_full"]).alias("en_full"))))
    rows = texts.select(*rest, F.posexplode(F.concat(*found)).alias("ord", "x")).select(*rest, "ord", "x.en", "x.en_full")
    rows = rows.where(F.length("en_full") > F.length("en"))
    first = Window.partitionBy(*rest, term_key(F.col("en"))).orderBy("ord")
    found = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if known is None:
        return found
    had = known.select("doc_id", F.col("en_key").alias("_key")).distinct()
    return found.withColumn("_key", term_key(F.col("en"))).join(had, ["doc_id", "_key"], "left_anti").drop("_key")


def first_uses(texts: DataFrame, text: str = "translation") -> DataFrame:
    """Terms that translations introduce as ABBR（full name, Chinese）."""
    rest = [c for c in texts.columns if c != text]
    pairs = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(FIRST_USE), F.lit(k)).alias(n) for k, n in ((1, "en"), (2, "en_full"), (3, "zh"))))
    return texts.select(*rest, F.posexplode(pairs).alias("ord", "x")).select(*rest, "ord", "x.en", "x.en_full", "x.zh")


def prompt_line() -> Column:
    zh, full, note = F.coalesce("zh", F.lit("")), _filled("en_full"), _filled("note")
    said = (
        F.when(zh == KEEP, F.concat(F.lit("- "), "en_key", F.lit(" → 【保留英文原文，严禁翻译】")))
        .when(full.isNotNull() & (zh == ""), F.concat(F.lit("- "), "en_key", F.lit("（"), full, F.lit("）→ 缩写，请采用其中文标准译法并与后文一致")))
        .when(full.isNotNull(), F.concat(F.lit("- "), "en_key", F.lit("（"), full, F.lit("）→ 【"), zh, F.lit("】")))
        .otherwise(F.concat(F.lit("- "), "en_key", F.lit(" → 【"), zh, F.lit("】")))
    )
    return F.concat(said, F.coalesce(F.concat(F.lit("（"), note, F.lit("）")), F.lit("")))


#: What stands around the terms in a prompt.
STRICT = (
    "【强制术语约束 — 最高优先级】\n下文术语表是本文已锁定的标准译法，你必须严格沿用，逐字使用【】内的中文，"
    "不得换用近义词、不得直译、不得省略。若你的默认翻译与下表冲突，必须以本表为准。\n",
    "\n【强制术语约束结束】",
)


def prompt_lines(glossary: DataFrame, keys: tuple[str, ...] = ("doc_id",), strict: bool = False) -> DataFrame:
    """Per key the terms as lines of a prompt, in order; strict: with an order to use them around."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", prompt_line().alias("line"))))
    lines = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return glossary.groupBy(*keys).agg((F.concat(F.lit(STRICT[0]), lines, F.lit(STRICT[1])) if strict else lines).alias("prompt"))


def known_terms(terms: DataFrame, glossary: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """terms (keys, en) with zh of the glossary by normalised key, null where it has none."""
    told = glossary.select(*keys, F.col("en_key").alias("_key"), "zh")
    return terms.withColumn("_key", term_key(F.col("en"))).join(told, [*keys, "_key"], "left").drop("_key")


def glossary_json(glossary: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    item = F.struct("ord", "en_key", F.struct("zh", "en_full", "note", "seen").alias("term"))
    made = F.map_from_entries(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["en_key"], x["term"])))
    return glossary.groupBy(*keys).agg(F.to_json(made, {"ignoreNullFields": "false"}).alias("glossary_json"))


def needs_repair(translations: DataFrame, glossary: DataFrame, mode: str = "intended") -> DataFrame:
    """Translations (doc_id, block_idx, text, translation) that should be made again, with the rule that says so.

    mode "intended": a term to be kept in English is in the text but not in the translation; "as_coded": it is in the
    translation. Another term is in the translation while its Chinese is not. A document's own terms are sought, all of them in
    one look at each text (see automaton); a key that the glossary holds twice counts with both of its translations.
    glossary: doc_id, en_key, zh; or doc_id and entries, an array of structs of en_key and zh.
    """
    from quillspark.functions.text import WRONG_VARIANTS, awkward, has_text, residue, suspect
    from quillspark.operators.automaton import Automaton, by_glossary

    if mode not in ("intended", "as_coded"):
        raise ValueError(mode)
    said = translations.where(has_text(F.col("translation")))
    wrong = F.lit(False)
    for phrase in WRONG_VARIANTS:
        wrong = wrong | F.col("translation").contains(phrase)
    # suspect says whether there is a rule: a test of the rule itself would make the translation anew for each of its parts
    rule = F.when(residue(F.col("translation")), "residue").when(awkward(F.col("translation")), "awkward").when(wrong, "variant").alias("rule")
    plain = translations.where(suspect(F.col("translation"))).select("doc_id", "block_idx", rule)

    def broken(automaton: Automaton, terms: list[tuple], values: list[str | None]) -> bool:
        text, translation = values
        used = set()
        for i in automaton.found(translation):
            used.add(i)
            zh = terms[i][1]
            if zh == KEEP and mode == "as_coded" or zh not in (KEEP, "", None) and zh not in translation:
                return True
        if mode == "as_coded" or text is None or all(zh != KEEP for _, zh in terms):
            return False
        return any(terms[i][1] == KEEP and i not in used for i in automaton.found(text))

    other = F.when(F.col("text") != F.col("translation"), F.col("text")).alias("text")  # an equal text lacks nothing: not sent twice
    by_term = by_glossary(said.select("doc_id", "block_idx", other, "translation"), glossary, broken, ["text", "translation"], ["en_key", "zh"], translations).select("doc_id", "block_idx", F.lit("term").alias("rule"))
    return plain.unionByName(by_term).groupBy("doc_id", "block_idx").agg(F.min("rule").alias("rule"))
