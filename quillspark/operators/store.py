"""Results kept as a log of runs: added to, read at their latest, compacted, cleared.

A run is a folder of Parquet files, written by Spark's committer. It counts once the log says so: a record of one row, written
after the run, which names it and the runs that it stands for. A run whose writer died is in no record and is never read.
Compaction merges the runs that count into one with the latest row of each key, in few files, and its record takes their place;
readers see either all of the old runs or the new one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run string, number long, kind string, instead array<string>"
ADDED, COMPACTED, CLEARED = "added", "compacted", "cleared"


class ResultStore:
    """Rows of schema, a DDL string, at path (any that Spark writes), the latest of each of keys by the number of its run.

    Each version is a store of its own; one writer at a time adds to it. Of several rows of a key in one run the largest, by the
    other columns in their order, counts; null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, schema: str, keys: tuple[str, ...] = ("doc_id", "block_idx")) -> None:
        self.spark, self.path, self.keys = spark, f"{path.rstrip('/')}/version={version}", list(keys)
        self.schema = spark.createDataFrame([], schema).schema
        self.rest = [c for c in self.schema.names if c not in keys]

    def log(self) -> list:
        """Records by number: few, as compaction and clearing are what a log is kept short by."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("number", "run").collect()
        except AnalysisException:  # nothing yet
            return []

    def runs(self, log: list | None = None) -> list[tuple[str, int]]:
        """(run, number) of the runs that count."""
        log = self.log() if log is None else log
        gone = {run for record in log for run in record["instead"]}
        return [(r["run"], r["number"]) for r in log if r["kind"] != CLEARED and r["run"] not in gone]

    def _said(self, run: str, number: int, kind: str, instead: list[str]) -> None:
        self.spark.createDataFrame([(run, number, kind, instead)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _folder(self, run: str) -> str:
        return f"{self.path}/runs/{run}"

    def add(self, rows: DataFrame) -> str:
        """Keep rows (other columns are left out) as a new run."""
        log, run = self.log(), uuid.uuid4().hex
        rows.select(*self.schema.names).write.parquet(self._folder(run))
        self._said(run, 1 + max((r["number"] for r in log), default=0), ADDED, [])
        return run

    def _read(self, runs: list[tuple[str, int]], skip_damaged: bool) -> DataFrame:
        """Rows of runs with _number, the number of their run."""
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumn("_number", F.lit(0).cast("long"))
        reader = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", str(skip_damaged).lower())
        run = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([0-9a-f]{32})/", 1)
        numbers = F.create_map(*(F.lit(x) for pair in runs for x in pair))
        return reader.parquet(*(self._folder(r) for r, _ in runs)).withColumn("_number", numbers[run])

    def latest(self, skip_damaged: bool = False) -> DataFrame:
        """The latest row of each key. A file that can't be read is an error, or its rows are absent with skip_damaged: see damaged."""
        return self._latest(self.runs(), skip_damaged)

    def _latest(self, runs: list[tuple[str, int]], skip_damaged: bool = False) -> DataFrame:
        rest = F.struct(*self.rest) if self.rest else F.struct(F.lit(0).alias("_"))
        found = self._read(runs, skip_damaged).groupBy(*self.keys).agg(F.max(F.struct("_number", rest.alias("rest"))).alias("_last"))
        return found.select(*(F.col(c) if c in self.keys else F.col(f"_last.rest.`{c}`").alias(c) for c in self.schema.names))

    def count(self) -> int:
        return self.latest().count()

    def compact(self, files: int = 0) -> str | None:
        """Merge the runs that count into one, sorted by key; files: in so many, else as Spark's exchange of them has it."""
        log = self.log()
        runs = self.runs(log)
        if not runs:
            return None
        run, told = uuid.uuid4().hex, self._latest(runs)
        told = told.repartition(files, *self.keys) if files else told
        told.sortWithinPartitions(*self.keys).write.parquet(self._folder(run))
        self._said(run, max(r["number"] for r in log) + 1, COMPACTED, [r for r, _ in runs])
        return run

    def clear(self) -> None:
        """Nothing counts any longer; files stay for those who read them now."""
        log = self.log()
        if runs := self.runs(log):
            self._said(uuid.uuid4().hex, max(r["number"] for r in log) + 1, CLEARED, [r for r, _ in runs])

    def damaged(self) -> DataFrame:
        """Files of runs that count and can't be read to their end: file, error. Each file is read whole, one at a time, by some task."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "file string, error string")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([self._folder(r) for r, _ in runs])

        def run(batches):
            for batch in batches:
                wrong = []
                for path, content in zip(batch.column("path"), batch.column("content")):
                    try:
                        f = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                        for i in range(f.num_row_groups):
                            f.read_row_group(i)
                    except (pa.ArrowException, OSError) as e:
                        wrong.append((path.as_py(), str(e)[:500]))
                yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in wrong], pa.string()) for k in (0, 1)], names=["file", "error"])

        return files.select("path", "content").mapInArrow(run, "file string, error string")
