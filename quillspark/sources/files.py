"""One file a document, written by a data source that commits in two phases.

A task writes into a folder of its own attempt, hidden below the target, and tells its name. When all tasks have ended, folders
that none has told (attempts that failed, or ran beside others) are removed and the run becomes visible by a single rename; a job
that fails leaves nothing. Files of a task lie in one folder, so a run of very many files has many folders, and the driver handles
folders only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillspark.functions.text import safe_filename

#: Bytes of a file's name, without its ending, that every file system takes.
NAME_BYTES = 200


def file_names(docs: DataFrame, mode: str = "id", title: str = "title", title_zh: str = "title_zh") -> DataFrame:
    """docs (doc_id and, by mode, titles) with stem, the name of a file without its ending: the id, or the title or its translation
    where there is one. Names that clash, or are too long for a file system, end in a part of the id's hash behind two spaces, which
    no other name holds, so that all are distinct if ids are.

    Clashing names are found by one aggregate over names and joined; a name that a great many documents share, such as that of all
    without a title, is a skewed key of this join, which adaptive execution splits.
    """
    by = {"id": ["doc_id"], "title": [title, "doc_id"], "title_zh": [title_zh, title, "doc_id"]}[mode]
    named = docs.withColumn("_stem", safe_filename(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in by))))
    clashes = named.groupBy("_stem").count().where("count > 1").select("_stem", F.lit(True).alias("_clash"))
    told = named.join(clashes, "_stem", "left")
    mark = F.concat(F.lit("  "), F.substring(F.sha1(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 16))
    long = F.octet_length("_stem") > NAME_BYTES
    stem = F.when(long, F.concat(F.substring("_stem", 1, 40), mark)).when(F.col("_clash"), F.concat("_stem", mark)).otherwise(F.col("_stem"))
    return told.withColumn("stem", stem).drop("_stem", "_clash")


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, content) as files of a new run below path; mode "overwrite" removes older runs once the new one is seen."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").option("path", path).mode(mode).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """What is to be seen below path: name, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").load(f"{path}/run-*")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


class NamedFiles(DataSource):
    """format("named_files"), for writing: rows (name string, content binary); option path, a URI or path that executors share."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int
    size: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def places(self) -> tuple[fs.FileSystem, str, str, str]:
        """The file system, the target, and the hidden and the visible folder of this run."""
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        base = base.rstrip("/")
        return store, base, f"{base}/.run-{self.job}", f"{base}/run-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, hidden, _ = self.places()
        task = TaskContext.get()
        folder, files, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, 0
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                name = name.as_py()
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no name of a file: {name!r}")
                if not files:
                    store.create_dir(f"{hidden}/{folder}", recursive=True)
                with store.open_output_stream(f"{hidden}/{folder}/{name}") as f:
                    f.write(content.as_buffer() or b"")
                files += 1
                size += len(content.as_buffer() or b"")
        return Written(folder if files else None, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, base, hidden, seen = self.places()
        told = {m.folder for m in messages if m is not None and m.folder}
        store.create_dir(hidden, recursive=True)
        for i in store.get_file_info(fs.FileSelector(hidden)):
            if i.base_name not in told:
                store.delete_dir(i.path)
        older = [i.path for i in store.get_file_info(fs.FileSelector(base)) if i.base_name.startswith("run-")]
        store.move(hidden, seen)
        if self.overwrite:
            for path in older:
                store.delete_dir(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, hidden, _ = self.places()
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)
