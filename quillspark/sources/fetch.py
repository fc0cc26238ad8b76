"""Documents fetched by URL, as an operator on a table of URLs and as a data source.

A transport makes one attempt; whether there is another is decided here: an answer of 200 ends them, another of the 400s but
429 does too, and anything else, an error of the transport included, is tried again after 1, 2, 4, ... seconds, 30 at most.
URLs of one host go to a few lanes at most, each of them in one task, so that a host never meets more requests at once
than lanes times threads; a host with very many URLs is spread over its lanes and over no more.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillspark.operators.pool import in_order
from quillspark.settings import Settings

FETCHED = "url string, ok boolean, status int, attempts int, waited double, content binary"
_ARROW = pa.schema([("url", pa.string()), ("ok", pa.bool_()), ("status", pa.int32()), ("attempts", pa.int32()), ("waited", pa.float64()), ("content", pa.binary())])
#: The longest wait between two attempts, and bytes of content in a batch.
LONGEST, BATCH = 30.0, 16 << 20


class Transport(Protocol):
    """One attempt: the status and the body in chunks. An error means that there was no answer."""

    def get(self, url: str, timeout: float) -> tuple[int, Iterable[bytes]]: ...


class FolderTransport:
    """A mirror in a folder that every executor reads: host/path below it; what is not there has the status 404."""

    def __init__(self, root: str) -> None:
        self.root = root

    def get(self, url: str, timeout: float) -> tuple[int, Iterable[bytes]]:
        store, base = fs.FileSystem.from_uri(self.root)
        name = url.split("://", 1)[-1].split("#")[0].split("?")[0].strip("/")
        path = f"{base}/{name}"
        if ".." in name.split("/") or store.get_file_info(path).type != fs.FileType.File:
            return 404, ()
        return 200, self.chunks(store, path)

    @staticmethod
    def chunks(store: fs.FileSystem, path: str) -> Iterator[bytes]:
        with store.open_input_stream(path) as f:
            while part := f.read(8192):
                yield part


def attempted(transport: Transport, url: str, retries: int, timeout: float, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """A row of FETCHED: what came of a URL after 1 + retries attempts at most; status is null where the last had no answer."""
    waited, attempt, status = 0.0, 0, None
    while True:
        attempt += 1
        try:
            status, chunks = transport.get(url, timeout)
            if status == 200:
                return url, True, status, attempt, waited, b"".join(chunks)
        except Exception:  # a transport's own errors, whatever they are: no answer
            status = None
        if attempt > retries or (status is not None and 400 <= status < 500 and status != 429):
            return url, False, status, attempt, waited, None
        delay = min(2.0 ** (attempt - 1), LONGEST)
        sleep(delay)
        waited += delay


def batches(transport: Transport, urls: Iterable[str], settings: Settings, sleep: Callable[[float], None]) -> Iterator[pa.RecordBatch]:
    told, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*told), _ARROW)], schema=_ARROW)
    for _, row in in_order(lambda url: attempted(transport, url, settings.retries, settings.timeout, sleep), urls, settings.threads):
        told.append(row)
        size += 256 + len(row[-1] or b"")
        if size >= BATCH:
            yield make()
            told, size = [], 0
    if told:
        yield make()


def in_lanes(urls: DataFrame, lanes: int, tasks: int | None) -> DataFrame:
    """The distinct URLs, those of a host in at most ``lanes`` tasks."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    lane = F.pmod(F.xxhash64("url"), F.lit(lanes))
    keys = [host.alias("host"), lane.alias("lane")]
    told = urls.where(F.col("url").isNotNull()).select("url").distinct().select("url", *keys)
    return (told.repartition(tasks, "host", "lane") if tasks else told.repartition("host", "lane")).select("url")


def fetch(urls: DataFrame, transport: Callable[[], Transport], settings: Settings = Settings(), lanes: int = 2, tasks: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row of FETCHED for each distinct URL of urls (url; nulls are left out).

    A task that is lost is made again, with its requests: write the result before it is used more than once.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(transport(), (u for p in parts for u in p.column("url").to_pylist()), settings, sleep)

    return in_lanes(urls, lanes, tasks).mapInArrow(run, FETCHED)


def write_url_list(urls: DataFrame, path: str, lanes: int = 2, files: int = 64) -> None:
    """The list that the data source reads: Parquet files, each read by one task, a host's URLs in at most ``lanes`` of them."""
    in_lanes(urls, lanes, files).write.mode("overwrite").parquet(path)


class FetchedSource(DataSource):
    """format("fetched"): options urls (see write_url_list), transport (module:name), transport_args (JSON), retries, timeout, threads, waits.

    waits "no" leaves the waits between attempts out, for transports that need none.
    """

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: StructType) -> FetchedReader:
        return FetchedReader(dict(self.options))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FetchedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options["urls"]
        self.module, _, self.name = options["transport"].partition(":")
        self.args = json.loads(options.get("transport_args") or "{}")
        self.settings = Settings(**{k: int(options[k]) for k in ("retries", "timeout", "threads") if k in options})
        self.waits = options.get("waits") != "no"

    def partitions(self) -> list[InputPartition]:
        """One a file of the list: their number was chosen when it was written."""
        store, base = fs.FileSystem.from_uri(self.urls)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and not os.path.basename(i.path).startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.urls)
        transport = getattr(importlib.import_module(self.module), self.name)(**self.args)
        sleep = time.sleep if self.waits else lambda seconds: None
        with store.open_input_file(partition.path) as f:
            urls = (u for b in pq.ParquetFile(f).iter_batches(columns=["url"]) for u in b.column(0).to_pylist())
            yield from batches(transport, urls, self.settings, sleep)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchedSource)


def cached(spark: SparkSession, path: str, made: Callable[[], DataFrame], now: int, ttl: int = 24 * 3600, force: bool = False) -> DataFrame:
    """What was made last, with fetched_at, if it is not older than ttl; else made() anew and kept; if that fails, what there is of any age.

    path holds one folder a time of making, each written whole before it is seen; rows of made() must be small enough to be kept so
    each time. With nothing kept and no success the error of made() is raised.
    """
    try:
        kept = spark.read.parquet(path)
    except AnalysisException:  # nothing kept yet
        kept = None
    last = kept.agg(F.max("fetched_at")).first()[0] if kept is not None else None
    newest = lambda at: spark.read.parquet(path).where(F.col("fetched_at") == at).drop("at")
    if last is not None and now - last <= ttl and not force:
        return newest(last)
    try:
        made().withColumn("fetched_at", F.lit(now).cast("long")).write.mode("overwrite").parquet(f"{path}/at={now}")
    except Exception:
        if last is None:
            raise
        return newest(last)
    return newest(now)
