"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in as many partitions as shuffles have, by keys: rows made from a small file come in few, and what Python does with them
    is by far the most of the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def large(rows: DataFrame) -> DataFrame:
    """rows that grow with the input, for a join: never sent whole through the driver to all tasks. What Spark estimates of rows made
    from a small file is too small by far, and it would send them."""
    return rows.hint("merge")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what made them, requests among it, is not done again by those who read them."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
