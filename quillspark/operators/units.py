"""Packing of blocks into translation units, and what is left to do of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import strip

TEXT_KINDS = ("paragraph", "list_item", "text_box")


def pack_units(blocks: DataFrame, least: int = 1000, most: int = 1500, compat: bool = True) -> DataFrame:
    """blocks (doc_id, block_idx, kind, text) with unit_id: neighbouring blocks of one text kind share a unit of least to most
    characters; other kinds stand alone. Each step depends on the one before, so documents are sorted in their partitions and
    folded batch by batch in one pass: nothing of a document is gathered, and the state is a few numbers.

    compat: a block that opens a unit by overflow stays alone in it. least <= 0: every block is a unit.
    """
    if least <= 0:
        return blocks.withColumn("unit_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1)
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    ordered = blocks.select(F.struct(*(F.col(f"`{c}`") for c in blocks.columns)).alias("row"), F.col("doc_id").alias("d"), F.col("block_idx").alias("i"), F.col("kind").alias("k"), size.alias("n"))
    ordered = ordered.repartition("d").sortWithinPartitions("d", "i")

    def run(batches):
        doc, begun = None, False
        unit, kind, total = -1, None, 0
        for batch in batches:
            out = []
            for d, k, n in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "n"))):
                if not begun or d != doc:
                    doc, begun, unit, kind, total = d, True, -1, None, 0
                text = k in TEXT_KINDS
                same = text and kind == k
                over = most > 0 and total + n > most
                joins = same and not over
                total = total + n if joins else n
                unit += not joins
                full = 0 < most <= total
                ripe = joins and total >= least and (most <= 0 or total + n >= most)
                kind = None if not text or full or ripe or same and over and compat else k
                out.append(unit)
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.int32())], names=["row", "unit_id"])

    schema = T.StructType([ordered.schema["row"], T.StructField("unit_id", T.IntegerType())])
    placed = ordered.mapInArrow(run, schema)
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in blocks.columns), "unit_id")


def pending_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units of which at least one block has no result yet: doc_id, unit_id."""
    told = units.join(done.select("doc_id", "block_idx", F.lit(True).alias("hit")).distinct(), ["doc_id", "block_idx"], "left")
    return told.groupBy("doc_id", "unit_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).where(~F.col("all")).select("doc_id", "unit_id")


def unit_counts(units: DataFrame) -> DataFrame:
    per = units.groupBy("doc_id", "unit_id").count()
    return per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("count") > 1).alias("merged"), F.sum("count").alias("blocks"))


def seed_texts(blocks: DataFrame, most: int = 4) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    wanted = blocks.where(F.col("kind").isin("title", "paragraph", "list_item") & (strip(F.col("text")) != ""))
    return wanted.withColumn("seed", F.row_number().over(order)).where(F.col("seed") <= most)


def abstract_or_first(blocks: DataFrame, most: int = 3) -> DataFrame:
    """Per document the abstract's paragraphs joined; without one the first few paragraphs."""
    order = Window.partitionBy("doc_id", "abstract").orderBy("block_idx")
    told = blocks.where(F.col("kind") == "paragraph").withColumn("abstract", F.coalesce(F.col("section") == "abstract", F.lit(False)))
    told = told.withColumn("n", F.row_number().over(order)).where(F.col("abstract") | (F.col("n") <= most))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("block_idx", "text")))), lambda x: x["text"]), "\n")
    return told.groupBy("doc_id").agg(F.coalesce(F.nullif(join(F.col("abstract")), F.lit("")), join(~F.col("abstract"))).alias("summary"))


def assembled(text: str, which: Column) -> Column:
    """An aggregate: the texts of which blocks in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.when(which, F.struct("block_idx", F.coalesce(F.col(text), F.lit("")).alias("t")))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")


def assemble(blocks: DataFrame, text: str = "markdown") -> DataFrame:
    """Per document its blocks in order, joined by line feeds."""
    return blocks.groupBy("doc_id").agg(assembled(text, F.lit(True)).alias("markdown"))
