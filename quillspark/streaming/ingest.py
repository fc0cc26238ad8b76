"""Papers as a stream: files of HTML are parsed, packed and stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.units import pack_units
from quillspark.sources.html import parse_blocks


def html_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """doc_id, html of every file that arrives; doc_id is the file's name."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+?)(?:\.html?)?$", 1).alias("doc_id"), F.decode("content", "UTF-8").alias("html"))


def store_blocks(pages: DataFrame, out: str, checkpoint: str, least: int = 1000, most: int = 1500) -> StreamingQuery:
    """Parse and pack each batch; a document is whole in one file, so nothing is kept between batches. A batch has a folder of
    its own, written over if it runs again, so a retry stores nothing twice."""

    def put(batch: DataFrame, number: int) -> None:
        blocks = parse_blocks(batch.dropDuplicates(["doc_id"]))
        pack_units(blocks, least, most).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
