"""Exact top-k search by MaxScore with block maxima.

A vector's components are terms with integer weights. A shard's candidates are ordered so that neighbours are alike and cut
into blocks; every block knows the extremes of each term. For a query these give each term's least and what it can add to
that, and a block whose sum of both stays below the k-th score is passed over. In a block that is not, terms are taken by
falling bound: a tail of terms that cannot lift a candidate from nothing to the k-th score is non-essential, as long as it
adds no more than TAIL of that score, so that few stay competitive. The essential terms are traversed for all candidates of
the block, for all its queries in one product; the others are probed only for candidates that can still reach the k-th score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import TopK, finite, search_in_blocks

#: Candidates in a block.
BLOCK = 1024
#: What all non-essential terms may add to a score, as a share of the k-th.
TAIL = 0.25


def alike(vectors: np.ndarray, block: int) -> np.ndarray:
    """An order in which runs of ``block`` are alike: halves by the middle of the widest term, again and again."""
    todo, out = [np.arange(len(vectors))], []
    while todo:
        at = todo.pop()
        if len(at) <= block:
            out.append(at)
            continue
        half = -(-(len(at) // 2) // block) * block
        term = int(np.argmax(vectors[at].std(axis=0)))
        order = at[np.argsort(vectors[at, term], kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class Shard:
    """The postings of a shard: blocks of candidates with every term's weights, and their extremes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK) -> None:
        order = alike(vectors.astype(np.float64), block)
        self.ids, self.vectors, self.k = ids[order], vectors[order], k
        self.cuts = [(a, min(a + block, len(ids))) for a in range(0, len(ids), block)]
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in self.cuts])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in self.cuts])
        self.passed = self.probed = self.pairs = 0  # for measurements

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray) -> TopK:
        most = 2 * int(np.abs(queries).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * self.vectors.shape[1]
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object  # exact in each
        queries, low, high = queries.astype(kind), self.low.astype(kind), self.high.astype(kind)
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T  # of each block
        top = TopK(query_ids, self.k, kind)
        for b in np.argsort(-bound.mean(axis=0), kind="stable").tolist():
            live = np.flatnonzero(bound[:, b] >= top.floor)
            self.passed += len(queries) - len(live)
            if len(live):
                start, end = self.cuts[b]
                self.traverse(top, live, queries[live], low[b], high[b], self.vectors[start:end].astype(kind), self.ids[start:end])
        return top

    def traverse(self, top: TopK, live: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, ids: np.ndarray) -> None:
        a, b = queries * low, queries * high
        least, add = np.minimum(a, b), np.abs(a - b)
        base, floor = least.sum(axis=1), top.floor[live]
        order = np.argsort(-add, axis=1, kind="stable")
        tail = np.cumsum(np.take_along_axis(add, order, axis=1)[:, ::-1], axis=1)[:, ::-1]  # what this term and all after it can add
        essential = np.empty(add.shape, dtype=bool)
        np.put_along_axis(essential, order, (base[:, None] + tail >= floor[:, None]) | (tail > TAIL * floor[:, None]), axis=1)
        rest = np.where(essential, 0, least).sum(axis=1)
        room = np.where(essential, 0, add).sum(axis=1)
        part = np.where(essential, queries, 0) @ block.T + rest[:, None]
        if len(ids) > top.k and (floor == top.nothing).any():  # nothing is known yet: the k-th of the block is a floor
            mine = np.where(top.query_ids[live][:, None] == ids, top.nothing, part)
            floor = np.maximum(floor, np.partition(mine, len(ids) - top.k, axis=1)[:, len(ids) - top.k])
        rows, at = np.nonzero(part + room[:, None] >= floor[:, None])
        self.pairs += part.size
        self.probed += len(rows)
        scores = part[rows, at] - rest[rows]
        for c in range(0, len(rows), 1 << 16):
            r, p = rows[c : c + (1 << 16)], at[c : c + (1 << 16)]
            scores[c : c + (1 << 16)] += (np.where(essential[r], 0, queries[r]) * block[p]).sum(axis=1)
        top.add(live[rows], ids[at], scores)


def top_k(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64, shard_rows: int = 1 << 14, block_rows: int = 1 << 14, block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of every query with all other rows: query_id, rank, vec_id, score.

    rows: vec_id, embedding; components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``.
    Rows with a null vec_id, a null vector or a null or non-finite component take no part; other columns are ignored; ties
    go to the smaller vec_id; with fewer than k candidates all are returned; repeated rows are candidates each, and rows that
    share a vec_id ask once, with the smallest of their vectors; shorter vectors count as filled up with zeros; an empty table gives
    an empty result.
    """
    whole = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    whole = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))

    def search(ids: np.ndarray, vectors: np.ndarray) -> Callable:
        return Shard(ids, vectors, k, block)

    return search_in_blocks(whole, F.expr(f"pmod(vec_id, {every}) = 0"), search, k, "long", shard_rows, block_rows)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""
