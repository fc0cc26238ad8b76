"""HTML tables translated cell by cell; everything but the text of translated cells stays as it is."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as X
from quillspark.operators.translate import TranslatorBackend, translate_cells, translate_tables

KEY = ["doc_id", "block_idx"]
#: Tags behind which no cell is open.
ENDS = ("/td", "/th", "tr", "/tr", "thead", "/thead", "tbody", "/tbody", "tfoot", "/tfoot", "/table")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def table_pieces(tables: DataFrame) -> DataFrame:
    """One row (doc_id, block_idx, i, piece, opening, text, cell) for every tag with the text behind it; cell is the i of the
    td or th that is open there. The window is over one table."""
    parts = tables.select(*KEY, F.posexplode(F.split("table_md", r"(?=<[/A-Za-z!])")).alias("i", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    opening = F.regexp_extract("piece", r"(?s)^<(?:!--.*?--|[/A-Za-z!][^>]*)>", 0)
    told = parts.withColumn("opening", opening).withColumn("text", F.expr("substring(piece, length(opening) + 1)"))
    open_ = F.last(F.when(tag.isin("td", "th"), F.col("i")).when(tag.isin(*ENDS), F.lit(-1)), True).over(Window.partitionBy(*KEY).orderBy("i"))
    return told.withColumn("cell", F.nullif(open_, F.lit(-1)))


def html_cells(pieces: DataFrame) -> DataFrame:
    """doc_id, block_idx, r, text: per cell its texts, trimmed, decoded and joined by a space; r is the i of its tag."""
    ordered = F.array_sort(F.collect_list(F.struct("i", X.strip(F.col("text")).alias("t"))))
    texts = F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != "")
    cells = pieces.where("cell is not null").groupBy(*KEY, F.col("cell").alias("r")).agg(F.array_join(texts, " ").alias("text"))
    return cells.withColumn("text", X.strip(_decoded("text")))


def translate_html_tables(tables: DataFrame, backend: Callable[[], TranslatorBackend] | None, cells: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """tables (doc_id, block_idx, table_md) with table_zh: the same HTML with those cells translated that hold English.

    A translated cell keeps its own tag and loses the markup inside; its text is escaped. A cell whose answer is blank or
    what was asked stays as it is. A null table gives null.
    """
    pieces = table_pieces(tables)
    told = html_cells(pieces)
    said = (cells(told) if cells else translate_cells(told, backend)).where((X.strip(F.col("translation")) != "") & (F.col("translation") != F.col("text")))
    escaped = F.replace(F.replace(F.replace("translation", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    both = pieces.join(said.select(*KEY, F.col("r").alias("cell"), escaped.alias("said")), [*KEY, "cell"], "left")
    piece = F.when(F.col("said").isNull(), F.col("piece")).when(F.col("i") == F.col("cell"), F.concat("opening", "said")).otherwise(F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("t"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["t"]), "")
    return tables.join(both.groupBy(*KEY).agg(whole.alias("table_zh")), KEY, "left")


def translate_all_tables(tables: DataFrame, backend: Callable[[], TranslatorBackend] | None, cells: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tables of either kind with table_zh, each translated as its kind is, by the backend or by cells (see translate_tables)."""
    is_html = F.coalesce(F.lower(F.ltrim("table_md")).startswith("<table"), F.lit(False))
    return translate_html_tables(tables.where(is_html), backend, cells).unionByName(translate_tables(tables.where(~is_html), backend, cells))
