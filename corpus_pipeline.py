"""The corpus pipeline: drop toxic documents, keep one of each group of near-duplicates, drop repeated passages, pack.

Each stage takes the rows that the stage before kept, and all but the last return the columns of documents. Stages are
written as Parquet in the shared folder and read again, so a lost executor costs no earlier stage. Near-duplicates have a
similarity of 0.8 or more on five-word shingles; a repeated passage has 35 words or more; a packed sequence at most 1024
tokens. Nulls, repeated rows and empty tables are handled as the operators say; a whole row that repeats stays once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, written
from quillspark.llm.near_dup import drop_near_duplicates
from quillspark.llm.packing import pack_documents
from quillspark.llm.queries import BYTE_BPE
from quillspark.llm.substrings import remove_repeats
from quillspark.llm.toxicity import drop_toxic

#: The classifier's numpy training has no SQL; tests/llm hold every stage and the whole run against plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go; rows without words stay."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, and every row without words or doc_id."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start twice go; other texts stay as they are, and n_chars follows the text."""
    told = remove_repeats(docs.select(F.struct("*").alias("doc"), "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = told.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in pieces of at most 1024 tokens, each with its sequence and offset; null texts are the end token alone."""
    return pack_documents(docs, BYTE_BPE)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
