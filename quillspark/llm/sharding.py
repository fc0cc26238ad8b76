"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Every input partition orders its rows by a random key: a local permutation.
2. The number of rows that partition p sends to shard s is drawn for all p and s at once, so that row sums are the
   partitions' sizes and column sums the shards' sizes, with the law that a uniform permutation of all rows gives: row by
   row multivariate hypergeometric. Consecutive runs of the permuted rows of a partition go to the shards.
3. Rows are exchanged, and each shard orders what it got by a second random key: its slots.

Rows see only DataFrame functions; the driver draws the matrix row by row from the partitions' counts, which come one partition
at a time, and passes it on in chunks, so that it holds one chunk however many partitions there are. Step 1 is written to the
shared folder, so a lost executor cannot change what the counts were taken from.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from itertools import islice, tee

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of the matrix that the driver holds at once.
CHUNK = 4096
#: Rows of a shard that are sorted at once to number its slots.
CELL_ROWS = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of the draws are good, at any size: by the inverse of the distribution, whose terms beyond twelve standard
    deviations are too small for the numbers to tell from nothing."""
    mean = draws * good / (good + bad)
    sd = math.sqrt(mean * (bad / (good + bad)) * (good + bad - draws) / max(1, good + bad - 1))
    lo = max(0, draws - bad, int(mean - 12 * sd - 12))
    hi = min(good, draws, int(mean + 12 * sd + 12))
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))])
    weights = np.exp(logs - logs.max())
    return lo + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))


def communication_matrix(sizes: Iterable[int], shards: list[int], seed: int) -> Iterator[list[int]]:
    """Counts by shard, partition after partition: each sums to the partition's size, and all of them to the shards'."""
    rng = np.random.default_rng(seed)
    room = list(shards)
    for n in sizes:
        row, rest = [0] * len(shards), sum(room)
        for s, r in enumerate(room):
            if not n:
                break
            rest -= r
            got = hypergeometric(rng, r, rest, n) if rest else n
            row[s] = got
            room[s] -= got
            n -= got
        yield row


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def uniform_shards(rows: DataFrame, shards: int, seed: int = 7, key: Column | None = None) -> DataFrame:
    """The rows with shard int and slot long: a uniform random placement, shard sizes at most one apart, slots from 0.

    key: what the random order is derived from (default: all columns; give one where a column is a map). Rows with an equal
    key are placed in any order among themselves; where the whole row is equal that changes nothing. Columns named shard or
    slot in the input are replaced. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")))
    key = F.xxhash64(F.lit(seed), key if key is not None else row)
    local = rows.select(row.alias("row"), key.alias("h")).sortWithinPartitions("h", *(["row"] if _orderable(rows) else []))
    at = F.monotonically_increasing_id()
    local = written(local.withColumn("at", at).select("row", "h", F.shiftright("at", 33).alias("p"), F.expr("at & 8589934591").alias("r")), "permuted")
    counted = written(local.groupBy("p").count(), "counts")
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    numbers, sizes = tee(counted.orderBy("p").toLocalIterator())
    matrix = communication_matrix((r["count"] for r in sizes), shard_sizes(total, shards), seed)
    rows_of = ((r["p"], np.cumsum(row)[:-1].tolist()) for r, row in zip(numbers, matrix))
    table = spark.range(0).select(F.col("id").alias("p"), F.array("id").alias("b"))
    while chunk := list(islice(rows_of, CHUNK)):
        told = json.dumps([{"p": p, "b": b} for p, b in chunk])
        part = spark.range(1).select(F.explode(F.from_json(F.lit(told), "array<struct<p:bigint,b:array<bigint>>>")).alias("x")).select("x.p", "x.b")
        table = table.unionByName(written(part, "matrix"))
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    sent = local.join(table, "p").select(
        "row", "p", "r", F.size(F.filter("b", lambda b: b <= F.col("r"))).alias("shard"), F.xxhash64(F.lit(seed + 1), "h", "p", "r").alias("h")
    )
    sent = sent.withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "cell").orderBy("h", "p", "r")
    placed = sent.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "cell"])
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("rank") + F.col("ahead")).cast("long").alias("slot"))


def _orderable(rows: DataFrame) -> bool:
    return "map<" not in rows.schema.simpleString() and "variant" not in rows.schema.simpleString()


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Where every document goes under the law ``rows``: counts of the shards at most one apart.

    Returns doc_id, size (bytes of the text plus 8; a null text has none), text_crc32, law, shard, slot, grown_shard (null).
    Only these narrow rows are exchanged. Nulls in doc_id or text, repeated rows and clashing column names are rows like
    any other; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    placed = uniform_shards(rows, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
