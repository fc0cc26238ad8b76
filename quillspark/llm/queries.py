"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read
from .conversations import ORACLE as CONVERSATIONS_SQL
from .hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from .maxscore import ORACLE as MAX_SCORE_SQL
from .near_dup import ORACLE as NEAR_DUP_SQL
from .substrings import ORACLE as SUBSTRING_SQL

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(read(spark, sf_dir, "documents"), BYTE_BPE)


def op2_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import write_and_read

    return write_and_read(spark, read(spark, sf_dir, "documents"), WORD_BPE, new_path(spark, "tokens"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), 24)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeat_digests

    return repeat_digests(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


def op8_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(read(spark, sf_dir, "pages"))


def op10_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import neighbours

    return neighbours(read(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    rows = read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_digests

    return repair_digests(read(spark, sf_dir, "conversations"))


#: Rules of the registered query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_simple8b_files, op3_toxicity, op4_sharding, op5_best_fit_packing, op6_substring_dedup, op7_near_dedup, op8_max_score, op9_html_extraction, op10_vantage_point, op11_hard_negatives, op12_conversation_repair, op13_url_filters)}
ORACLES = {"op12_conversation_repair": CONVERSATIONS_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op8_max_score": MAX_SCORE_SQL, "op6_substring_dedup": SUBSTRING_SQL, "op7_near_dedup": NEAR_DUP_SQL}
