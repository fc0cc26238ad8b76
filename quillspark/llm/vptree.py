"""Approximate nearest neighbours by vantage-point trees.

Inner products become distances: every vector gets one more component that brings all to the largest norm, so that the
nearest in Euclidean distance has the largest inner product. Each shard builds a tree: a vantage point halves a node's
vectors by their distance to it. Queries descend together, each to one leaf first, whose k best give it a limit; then again
from the root into every child that the triangle inequality leaves within the limit divided by the factor. A factor of one
gives exact search; a larger one prunes more. Unless told, a shard takes the largest factor with which a sample of its
queries keeps the wanted share of its true neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import TopK, finite, search_in_blocks

LEAF = 32
#: The share of a sample's neighbours in a shard that its factor must keep, and the queries in the sample.
RECALL, SAMPLE = 0.96, 128
_CLOSE = 1e-9


class Tree:
    """nodes: (vantage point, radii inside and outside, children); a child below zero is leaf ~child, a run of the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, k: int, factor: float | None, recall: float, leaf: int = LEAF, seed: int = 5) -> None:
        self.k, self.factor, self.recall, self.norm = k, factor, recall, norm
        rest = np.sqrt(np.maximum(0, norm - (vectors * vectors).sum(axis=1)))
        whole, rng = np.column_stack([vectors, rest]), np.random.default_rng(seed)
        self.points, self.radii, self.children, leaves = [], [], [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            if len(at) <= leaf:
                leaves.append(at)
                own = -len(leaves)
            else:
                point = whole[at[rng.integers(len(at))]]
                far = np.sqrt(((whole[at] - point) ** 2).sum(axis=1))
                order, half = np.argsort(far, kind="stable"), len(at) // 2
                own = len(self.points)
                self.points.append(point[:-1])  # a query's last component is zero
                self.radii.append((far[order[half - 1]], far[order[half]], float(point @ point)))
                self.children.append([0, 0])
                todo += [(at[order[half:]], own, 1), (at[order[:half]], own, 0)]
            if parent >= 0:
                self.children[parent][side] = own
        self.root = 0 if self.points else -1
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.cuts = np.cumsum([0, *map(len, leaves)])
        self.visited = self.asked = 0  # for measurements

    def distances(self, node: int, queries: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, square + self.radii[node][2] - 2 * (queries @ self.points[node])))

    def home(self, queries: np.ndarray, square: np.ndarray) -> np.ndarray:
        """The leaf on each query's side of every vantage point."""
        out, todo = np.zeros(len(queries), dtype=np.int64), [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                near, far, _ = self.radii[node]
                inside = self.distances(node, queries[rows], square[rows]) <= (near + far) / 2
                todo += [(self.children[node][0], rows[inside]), (self.children[node][1], rows[~inside])]
        return out

    def descend(self, queries: np.ndarray, square: np.ndarray, most: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of queries, their bounds) of all leaves whose bound is at most most(rows): none of its vectors is nearer."""
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, rows, low = todo.pop()
            ok = low <= most(rows)
            rows, low = rows[ok], low[ok]
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, low
                continue
            d = self.distances(node, queries[rows], square[rows])
            near, far, _ = self.radii[node]
            todo += [(self.children[node][1], rows, np.maximum(low, far - d)), (self.children[node][0], rows, np.maximum(low, d - near))]

    def compare(self, top: TopK, leaf: int, rows: np.ndarray, queries: np.ndarray) -> None:
        at = np.arange(self.cuts[leaf], self.cuts[leaf + 1])
        near = queries[rows] @ self.vectors[at].T
        r, p = np.nonzero(near >= top.floor[rows][:, None] - _CLOSE * self.norm)
        top.add(rows[r], self.ids[at[p]], products(queries, rows[r], self.vectors, at[p]))

    def fitted(self, query_ids: np.ndarray, queries: np.ndarray, square: np.ndarray) -> float:
        """The largest factor that keeps the wanted share of the true neighbours of a sample of these queries."""
        some = np.random.default_rng(7).permutation(len(queries))[:SAMPLE]
        low = np.zeros((len(some), len(self.cuts) - 1))
        for leaf, rows, bound in self.descend(queries[some], square[some], lambda rows: np.full(len(rows), np.inf)):
            low[rows, leaf] = bound
        said = queries[some] @ self.vectors.T
        said[query_ids[some][:, None] == self.ids] = -np.inf
        k = min(self.k, said.shape[1])
        best = np.argpartition(-said, k - 1, axis=1)[:, :k]
        told = np.take_along_axis(said, best, axis=1)
        limit = np.sqrt(np.maximum(0, square[some] + self.norm - 2 * told.min(axis=1)))
        bound = np.take_along_axis(low, np.searchsorted(self.cuts, best, side="right") - 1, axis=1)
        allowed = np.where(bound > 0, limit[:, None] / np.maximum(bound, 1e-300), np.inf)[np.isfinite(told)]
        allowed.sort()
        return max(1.0, float(allowed[int((1 - self.recall) * len(allowed))])) if len(allowed) else 1.0

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray) -> TopK:
        square = (queries * queries).sum(axis=1)
        factor = self.factor or self.fitted(query_ids, queries, square)
        top = TopK(query_ids, self.k, np.float64)
        home = self.home(queries, square)
        for leaf in np.unique(home).tolist():
            self.compare(top, leaf, np.flatnonzero(home == leaf), queries)

        def most(rows: np.ndarray) -> np.ndarray:
            limit = np.sqrt(np.maximum(0, square[rows] + self.norm - 2 * top.floor[rows]))
            return limit / factor * (1 + _CLOSE) + _CLOSE

        for leaf, rows, _ in self.descend(queries, square, most):
            self.visited += len(rows)
            self.compare(top, leaf, rows[home[rows] != leaf], queries)
        self.asked += len(queries) * (len(self.cuts) - 1)
        return top


def products(queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up in order of the components, so that equal vectors have equal products."""
    out = np.zeros(len(rows))
    for j in range(queries.shape[1]):
        out += queries[rows, j] * vectors[at, j]
    return out


def neighbours(rows: DataFrame, every: int = 20, k: int = 20, factor: float | None = None, recall: float = RECALL, shard_rows: int = 1 << 14, block_rows: int = 1 << 14) -> DataFrame:
    """About the k largest inner products of every query with all other rows: query_id, rank, vec_id, score.

    rows: vec_id, embedding. Queries are the rows whose vec_id is divisible by ``every``; every valid row is in a tree. Rows
    with a null vec_id, a null or zero vector or a null or non-finite component take no part; other columns are ignored;
    ties go to the smaller vec_id; with fewer than k candidates all are returned; repeated rows are candidates each, and rows
    that share a vec_id ask once, with the smallest of their vectors; shorter vectors count as filled up with zeros; an empty table gives
    an empty result. The answer depends on the rows alone, not on their order or place. factor: one is
    exact; none lets each shard fit it to ``recall`` on at most SAMPLE queries.
    """
    whole = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    whole = whole.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    norm = whole.agg(F.max(squares)).first()[0] or 0.0

    def search(ids: np.ndarray, vectors: np.ndarray) -> Callable:
        return Tree(ids, vectors, norm, k, factor, recall)

    return search_in_blocks(whole, F.expr(f"pmod(vec_id, {every}) = 0"), search, k, "double", shard_rows, block_rows)
