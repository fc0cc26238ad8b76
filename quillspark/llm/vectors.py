"""What both vector searches share: valid rows, and queries against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


#: Queries compared at once.
QUERIES = 2048


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=kind)
    size = np.diff(offsets)
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=kind)
    for i, (a, n) in enumerate(zip((offsets - offsets[0]).tolist(), size.tolist())):
        out[i, :n] = flat[a : a + n]
    return out


class TopK:
    """The k best candidates of each of some queries: highest score first, ties to smaller ids."""

    def __init__(self, query_ids: np.ndarray, k: int, kind: type) -> None:
        self.query_ids, self.k = query_ids, k
        self.nothing = -(1 << 62) if kind is np.int64 else -np.inf
        self.scores = np.full((len(query_ids), k), self.nothing, dtype=kind)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    @property
    def floor(self) -> np.ndarray:
        """What a candidate of each query has to reach."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates, each for the query in that row; a query's own id is left out."""
        ok = (self.query_ids[rows] != ids) & (scores >= self.floor[rows])
        rows, ids, scores = rows[ok], ids[ok], scores[ok]
        if not len(rows):
            return
        hit, place = np.unique(rows, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(hit)), self.k), place])
        ids, scores = np.concatenate([self.ids[hit].ravel(), ids]), np.concatenate([self.scores[hit].ravel(), scores])
        order = np.lexsort((ids, -scores, place))
        size = np.bincount(place)
        best = order[((np.cumsum(size) - size)[:, None] + np.arange(self.k)).ravel()]
        self.ids[hit], self.scores[hit] = ids[best].reshape(-1, self.k), scores[best].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = (self.ids != np.iinfo(np.int64).max).ravel()
        return np.repeat(self.query_ids, self.k)[told], self.ids.ravel()[told], self.scores.ravel()[told]


def search_in_blocks(rows: DataFrame, is_query: Column, search: Callable, k: int, score: str, shard_rows: int, block_rows: int) -> DataFrame:
    """For each query its k best candidates among all other rows: query_id, rank, vec_id, score.

    rows: vec_id, v. Candidates are dealt to shards, and queries to blocks, by hash of what they are, and stand in a task in order
    of vec_id and vector, so that neither the order nor the place of rows changes an answer. Rows that repeat are counted first, and
    no more than k of them are dealt, as no more can be among the k best. A task sees one shard and one block, so its memory
    is bounded, and it returns k candidates a query. prepared = search(ids, vectors) indexes a shard, and prepared(query ids,
    queries) gives a TopK. Candidates with the query's own vec_id are left out. Repeated rows are candidates each; rows that share
    a vec_id ask once, with the smallest of their vectors. Shorter vectors count as filled up with zeros.
    """
    rows = written(rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")), "vectors")
    told = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = max(1, -(-told["n"] // shard_rows)), max(1, -(-told["q"] // block_rows))
    kind = dict(rows.dtypes)["v"]
    element = np.int64 if "bigint" in kind else np.float64
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks)).cast("int")
    copies = rows.select("vec_id", "v", shard.alias("shard"), F.explode(F.array_repeat(F.lit(False), F.col("copies"))).alias("asks"))
    candidates = copies.select("vec_id", "v", "asks", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        vectors = matrix(table.column("v"), element)
        order = np.lexsort([*vectors.T[::-1], ids])
        asks, ids, vectors = asks[order], ids[order], vectors[order]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, element))]
        if not asks.all():
            prepared = search(ids[~asks], vectors[~asks])
            for at in range(0, int(asks.sum()), QUERIES):
                parts.append(prepared(ids[asks][at : at + QUERIES], vectors[asks][at : at + QUERIES]).rows())
        query_ids, found, scores = map(np.concatenate, zip(*parts))
        return pa.table([pa.array(query_ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores.astype(element), pa.from_numpy_dtype(element))], names=["query_id", "vec_id", "score"])

    near = candidates.unionByName(queries).groupBy("shard", "block").applyInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
