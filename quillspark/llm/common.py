"""Shared plumbing of the training-data operators: the shared work folder, written tables and Arrow text helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 8 << 20
#: The same where a slice costs by its distinct words, which a larger slice has fewer of.
LARGE_SLICE = 24 << 20


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and what was made once is read many times."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def placed(docs: DataFrame) -> DataFrame:
    """All columns of docs in a column row, its text (if it has one) beside it, and file and at, which tell a row from all others."""
    text = [F.col("text")] if "text" in docs.columns else []
    told = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text]
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        return docs.select(*told, *place)
    except AnalysisException:  # not rows of files as they are
        return written(docs, "rows").select(*told, *place)


#: The most keys that are told apart as frequent; with them go as many rows by broadcast.
HOT_KEYS = 4096


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined, left, with a table that has one row a key. Both are written tables.

    A key that more than one in HOT_KEYS of the rows have would land in one task: there are at most HOT_KEYS of these, so
    their names go to the driver and their rows of the table by broadcast. All other keys are exchanged.
    """
    spark, counts = rows.sparkSession, rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    least = max(HOT_KEYS, total // HOT_KEYS)
    if most <= least:
        return rows.join(table.hint("merge"), key, "left")
    hot = [tuple(r) for r in counts.where(F.col("count") > least).select(key).collect()]
    names = F.broadcast(spark.createDataFrame(hot, StructType([StructField(key, rows.schema[key].dataType)])))
    often = rows.join(names, key, "left_semi").join(F.broadcast(table.join(names, key, "left_semi")), key, "left")
    return often.unionByName(rows.join(names, key, "left_anti").join(table.hint("merge"), key, "left"))


def even_keys(spark: SparkSession) -> list[int]:
    """An int for each shuffle partition that the hash of Spark's exchanges deals to it, so that numbered groups spread evenly."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(16 * n + 64).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").cast("int").alias("k"))
    return sorted(r["k"] for r in found.collect())


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls (a null counts as empty)."""
    return pc.fill_null(as_array(batch.column(name)).cast(pa.large_string()), "")


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of whole rows in a column row, with the text in them as a column of its own; nothing is copied."""
    row = as_array(batch.column("row"))
    return batch.append_column("text", row.field(row.type.get_field_index("text")))


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part but a single row has more than that many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(as_array(batch.column(name))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on and would keep the peak of every stage they have served."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: codes, offsets by text, and the distinct words."""
    parts = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    if not full.all():  # white space at an end leaves an empty part
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """coded_words with the distinct words as a list."""
    codes, offsets, words = coded_words(texts)
    return codes, offsets, words.to_pylist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
