"""Hard negatives by bit-sliced integer products.

A shard's candidates are cut into bit planes: with the least component taken off, a component is a sum of powers of two, and a
score is a sum of products with planes of zeros and ones. Planes come most significant first. After each, a pair's score is
known up to what the planes to come can add: half as much as before, by the query's sum of absolute components or by the lengths
of the query and of what is left of the candidate, whichever is less. A pair whose interval misses what its query still seeks is
dropped; once few pairs of a block are left, only those are multiplied.

First every anchor seeks its positives among rows of its label: a score has to reach the k-th known so far. Then it seeks rows of
other labels within its positives' bands: a score has to lie in a band and reach the k-th known so far in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, written
from .vectors import TopK, finite, matrix

#: Candidates and queries multiplied at once.
BLOCK, QUERIES = 2048, 512
#: The share of a block's pairs below which they are multiplied one by one.
FEW = 0.05
#: Pairs multiplied one by one at once.
PAIRS = 1 << 16
_WIDER = 1 + 1e-9


class Planes:
    """Candidates of a shard in an order by label, their bit planes packed, and the length of what is left below each plane."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.base = int(vectors.min(initial=0))
        rest = (vectors[order] - self.base).astype(np.uint64)
        self.width = vectors.shape[1]
        self.bits = int(rest.max(initial=0)).bit_length()
        self.most = int(np.abs(vectors).max(initial=0))
        self.planes = [np.packbits((rest >> np.uint64(b)).astype(np.uint8) & 1, axis=1) for b in range(self.bits)]
        self.left = [np.sqrt((((rest & np.uint64((1 << b) - 1)).astype(np.float64) - ((1 << b) - 1) / 2) ** 2).sum(axis=1)) for b in range(self.bits)]
        self.products = self.pairs = 0  # pairs times planes that were multiplied, and pairs; for measurements

    def plane(self, b: int, at: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.planes[b][at], axis=1, count=self.width)

    def within(self, queries: np.ndarray, at: np.ndarray, never: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a query, candidate, score) of pairs of queries and candidates at, none of never, with a score in a band of the query.

        least, most: a column a band, infinite where there is no end; a band whose least is above its most is closed. A query seeks
        the k best of each band, so a score need not be told below the k-th highest lower end of intervals that lie in the band.
        """
        top = int(np.abs(queries).sum(axis=1).max(initial=0)) * max(self.most, 1) * 4
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object  # exact in each
        told, total = queries.astype(kind), queries.astype(object if kind is object else np.int64).sum(axis=1)
        size, length = np.abs(queries).astype(np.float64).sum(axis=1), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        part = np.repeat((total * self.base).astype(kind)[:, None], len(at), axis=1)
        shut, most = least > most, most.astype(np.float64)
        low, high = np.where(shut, np.inf, least).min(axis=1), np.where(shut, -np.inf, most).max(axis=1)
        least, rows, cols = np.where(shut, np.inf, least), None, None
        self.pairs += part.size
        for b in reversed(range(self.bits)):
            middle = ((1 << b) - 1) / 2
            if rows is None:
                part += (1 << b) * (told @ self.plane(b, at).T.astype(kind))
                self.products += part.size
                wide = np.minimum(middle * size[:, None], length[:, None] * self.left[b][at]) * _WIDER
                known = part.astype(np.float64) + middle * total.astype(np.float64)[:, None]
                bottom, known = known - wide, known + wide
                if len(at) > k and np.median(wide) < np.median(np.abs(known)):
                    for j in range(least.shape[1]):
                        sure = np.where((bottom >= least[:, j, None]) & (known <= most[:, j, None]) & ~never, bottom, -np.inf)
                        least[:, j] = np.maximum(least[:, j], np.partition(sure, len(at) - k, axis=1)[:, len(at) - k])
                    low = least.min(axis=1)
                live = (known >= low[:, None]) & (bottom <= high[:, None]) & ~never
                if live.mean() < FEW or b == 0:
                    rows, cols = np.nonzero(live)
                    part = part[rows, cols]
                elif not (some := live.any(axis=0)).all():
                    at, part, never = at[some], np.ascontiguousarray(part[:, some]), never[:, some]
                continue
            for c in range(0, len(rows), PAIRS):
                r, p = rows[c : c + PAIRS], at[cols[c : c + PAIRS]]
                part[c : c + PAIRS] += (1 << b) * (told[r] * self.plane(b, p)).sum(axis=1)
            self.products += len(rows)
            wide = np.minimum(middle * size[rows], length[rows] * self.left[b][at[cols]]) * _WIDER
            known = part.astype(np.float64) + middle * total[rows].astype(np.float64)
            live = (known + wide >= low[rows]) & (known - wide <= high[rows])
            rows, cols, part = rows[live], cols[live], part[live]
        if rows is None:  # all components alike: no planes
            rows, cols = np.nonzero((part.astype(np.float64) >= low[:, None]) & (part.astype(np.float64) <= high[:, None]) & ~never)
            part = part[rows, cols]
        return rows, at[cols], part.astype(np.int64)

    def parts(self, which: np.ndarray) -> list[np.ndarray]:
        return [which[c : c + BLOCK] for c in range(0, len(which), BLOCK)]

    def positives(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, k: int) -> TopK:
        """The k best candidates of each query's own label."""
        top = TopK(ids, k, np.int64)
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            for at in self.parts(np.arange(*np.searchsorted(self.labels, [label, label + 1]))):
                low = top.floor[mine].astype(np.float64)[:, None]
                rows, found, scores = self.within(queries[mine], at, ids[mine][:, None] == self.ids[at], low, np.full_like(low, np.inf), k)
                top.add(mine[rows], self.ids[found], scores)
        return top

    def negatives(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> TopK:
        """For each query and each of its bands, flat, the k best candidates of other labels with a score in [least, most]."""
        bands = least.shape[1]
        top = TopK(np.repeat(ids, bands), k, np.int64)
        for at in self.parts(np.arange(len(self.ids))):
            low = np.maximum(least, top.floor.reshape(-1, bands)).astype(np.float64)
            rows, found, scores = self.within(queries, at, (labels[:, None] == self.labels[at]) | (ids[:, None] == self.ids[at]), low, most, k)
            for j in range(bands):
                ok = (scores >= least[rows, j]) & (scores <= most[rows, j])
                top.add(rows[ok] * bands + j, self.ids[found[ok]], scores[ok])
        return top


def in_blocks(rows: DataFrame, anchors: DataFrame, run: Callable[[pa.Table, pa.Table], list], schema: str, shard_rows: int, block_rows: int) -> DataFrame:
    """run(candidates, anchors) for every shard of rows (vec_id, label, v, file, at) and every block of anchors (vec_id, label, v, bands).

    Rows are dealt to shards by where they lie, so that a label with many rows spreads, and anchors to blocks by hash: a task
    sees one shard and one block, so its memory is bounded. Candidates are copied once a block, anchors once a shard.
    """
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-anchors.count() // block_rows))
    shard = F.pmod(F.xxhash64("file", "at"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None).cast(anchors.schema["bands"].dataType).alias("bands")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = rows.select("vec_id", "label", "v", none, F.lit(False).alias("asks"), shard, every(blocks, "block"))
    asking = anchors.select("vec_id", "label", "v", "bands", F.lit(True).alias("asks"), every(shards, "shard"), block)
    types = [f.split()[1] for f in schema.split(", ")]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def both(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        mine, theirs = table.filter(pa.compute.invert(asks)), table.filter(asks)
        out = run(mine, theirs) if mine.num_rows and theirs.num_rows else [np.zeros(0, dtype=np.int64)] * len(names)
        return pa.table([pa.array(x, pa.int64()).cast(kinds[t]) for x, t in zip(out, types)], names=names)

    return candidates.unionByName(asking).groupBy("shard", "block").applyInArrow(both, schema)


def _columns(table: pa.Table, start: int = 0, rows: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = table.slice(start, rows)
    return part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), np.int64)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, shard_rows: int = 1 << 14, block_rows: int = 1 << 12
) -> DataFrame:
    """For each anchor and each of its positives, hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label. Components become floor(scale * x); scores are integer inner products; higher ones come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of the same label (all, if fewer).
    Negatives are the first ``negatives`` (all, if fewer) rows of other labels whose score is between least and most hundredths of
    the positive's; a negative score of a positive leaves none. Rows with a null vec_id, label or vector, or a null or non-finite
    component, take no part; shorter vectors count as filled up with zeros; other columns are ignored. Repeated rows are candidates
    each, never for an anchor with their own vec_id; rows that share a vec_id ask once, with the smallest label and then vector.
    An empty table, and an anchor without positives or negatives, give no rows.
    """
    whole = placed(rows.select("vec_id", "embedding", "label")).where(F.col("row.vec_id").isNotNull() & F.col("row.label").isNotNull() & finite(F.col("row.embedding")))
    whole = whole.select("row.vec_id", F.col("row.label").cast("long").alias("label"), F.transform("row.embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"), "file", "at")
    anchors = whole.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = written(anchors.select("vec_id", "x.label", "x.v"), "anchors")

    def seek_positives(candidates: pa.Table, asking: pa.Table) -> list:
        shard, parts = Planes(*_columns(candidates)), []
        for at in range(0, asking.num_rows, QUERIES):
            parts.append(shard.positives(*_padded(shard, _columns(asking, at, QUERIES)), positives).rows())
        return [np.concatenate(x) for x in zip(*parts)]

    near = in_blocks(whole, anchors.withColumn("bands", F.lit(None).cast("array<bigint>")), seek_positives, "vec_id long, positive_id long, score long", shard_rows, block_rows)
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "positive_id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))), lambda x: F.struct(x["positive_id"].alias("id"), x["score"].alias("score"))).alias("bands"))
    asking = written(anchors.join(best, "vec_id"), "positives")

    def seek_negatives(candidates: pa.Table, asking: pa.Table) -> list:
        shard, parts = Planes(*_columns(candidates)), []
        for at in range(0, asking.num_rows, QUERIES):
            own = _padded(shard, _columns(asking, at, QUERIES))
            score = np.full((len(own[0]), positives), -1, dtype=np.int64)  # a band of none
            for i, bands in enumerate(asking.column("bands").slice(at, QUERIES).to_pylist()):
                score[i, : len(bands)] = [b["score"] for b in bands]
            top = shard.negatives(*own, -(-least * score // 100), most * score // 100, negatives)
            told = top.ids != np.iinfo(np.int64).max
            band = np.repeat(np.arange(len(told)), negatives).reshape(told.shape)[told]
            parts.append((own[0][band // positives], band % positives, top.ids[told], top.scores[told]))
        return [np.concatenate(x) for x in zip(*parts)]

    found = in_blocks(whole, asking, seek_negatives, "anchor_id long, place int, negative_id long, negative_score long", shard_rows, block_rows)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    told = asking.select(F.col("vec_id").alias("anchor_id"), F.posexplode("bands").alias("place", "positive"))
    told = told.select("anchor_id", "place", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    return told.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _padded(shard: Planes, asking: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries as wide as the shard's candidates: components that only one side has meet zeros."""
    ids, labels, vectors = asking
    out = np.zeros((len(ids), shard.width), dtype=np.int64)
    n = min(shard.width, vectors.shape[1])
    out[:, :n] = vectors[:, :n]
    return ids, labels, out


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
         cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id
  where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same
  ) where place <= 5
), n as (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
