"""Best-fit packing of documents into sequences of bounded length.

The configuration linear program over the length histogram asks for the fewest sequences such that every length is covered
as often as it occurs, a configuration being a multiset of lengths that fit one sequence. It is solved by multiplicative
weights: a length's weight starts at its volume, a little more for long ones, and falls as it is covered. In each round a
knapsack dynamic program prices, for every length at once, the best configuration that holds it; those worth nearly the
most of all are bought, fractions of a sequence included, until a length of theirs is covered. What is near enough is
widened where a round buys little, so the last rounds cover what is hard to fit.

Rounding takes the whole part of every purchase and then, by falling fraction, one sequence more where all its pieces are
left. The few pieces that remain are placed by best fit. All of it sees only the histogram (at most ``capacity`` counts),
however large the corpus.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_SLICE, as_array, slices, texts_of, written

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """What 0, 1, ..., capacity tokens can be worth at most, and the length that ends such a filling (0: none); value: of each length."""
    worth = np.where(value > 0, value, -1.0)[1:]
    held = np.zeros(capacity + 1)  # held[capacity - c] belongs to c tokens
    last = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        told = (held[capacity - c + 1 :] + worth[:c])[::-1]  # the longest first
        k = int(told.argmax())
        held[capacity - c] = held[capacity - c + 1]
        if told[k] > held[capacity - c] + 1e-12:
            held[capacity - c], last[c] = told[k], c - k
    return held[::-1], last


def priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, list[dict[int, int]], np.ndarray, float]:
    """The lengths of positive value, the best configuration that holds each, what these are worth, and the most of all."""
    best, ends = knapsack(value, capacity)
    at = np.maximum.accumulate(np.where(ends > 0, np.arange(capacity + 1), 0)).tolist()
    last, lengths, out = ends.tolist(), np.flatnonzero(value > 0)[::-1], []
    for n in lengths.tolist():
        config, room = {n: 1}, at[capacity - n]
        while room:
            config[last[room]] = config.get(last[room], 0) + 1
            room = at[room - last[room]]
        out.append(config)
    return lengths, out, value[lengths] + best[capacity - lengths], float(best[capacity])


def program(counts: np.ndarray, capacity: int = CAPACITY, rate: float = 0.05, lean: float = 0.3, near: float = 5e-4) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution: how many sequences of each configuration ((length, copies), ...); it covers every length exactly.

    rate: by how much being covered lowers a weight; lean: how much more a long piece weighs a token; near: which share of
    the most worth is given up at first.
    """
    size = np.arange(len(counts)) / capacity
    start, enough = size * np.exp(lean * size), 0.01 * float((counts * size).sum())
    left = counts.astype(np.float64)
    out: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        value = np.where(left > 1e-9, start * np.exp(rate * (left / np.maximum(counts, 1) - 1)), 0.0)
        if not value.any():
            return out
        _, configs, worth, most = priced(value, capacity)
        rest, bought = left.tolist(), 0.0
        for i in np.flatnonzero(worth >= (1 - near) * most).tolist():
            times = min(rest[n] / k for n, k in configs[i].items())
            if times > 1e-9:
                for n, k in configs[i].items():
                    rest[n] -= k * times
                key = tuple(sorted(configs[i].items()))
                out[key] = out.get(key, 0.0) + times
                bought += times
        left = np.array(rest)
        if bought < enough:
            near = min(1.0, 2 * near)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> float:
    """Fewer sequences than that cannot do: the better of two dual solutions, the volume and the pieces over half a sequence."""
    size = np.arange(len(counts)) / capacity
    priced_volume = np.where(counts > 0, size, 0.0)
    most = knapsack(priced_volume, capacity)[0][-1]
    return max(float((counts * size).sum()) / most if most else 0.0, float(counts[capacity // 2 + 1 :].sum()))


def rounded(plan: dict[tuple[tuple[int, int], ...], float], counts: np.ndarray) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Whole sequences of a fractional solution, and how many pieces of each length they leave."""
    left, out = counts.astype(np.int64).tolist(), []

    def take(config: tuple[tuple[int, int], ...], most: int) -> None:
        times = min([most, *(left[n] // k for n, k in config)])
        if times:
            for n, k in config:
                left[n] -= k * times
            out.append(([n for n, k in config for _ in range(k)], times))

    for config, times in plan.items():
        take(config, int(times + 1e-6))
    for config, times in sorted(plan.items(), key=lambda x: -(x[1] % 1)):
        take(config, 1)
    return out, np.array(left, dtype=np.int64)


def configurations(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used; together they hold every length exactly as often as counts says."""
    out, left = rounded(program(counts, capacity), counts)
    return out + best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over a histogram: equal sequences are handled as one, so the work follows the lengths."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, config: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((config, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[n])
        while todo:
            i = bisect.bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                config, times = open_[room].pop()
                taken = min(todo, times)
                if times > taken:
                    open_[room].append((config, times - taken))
                elif not open_[room]:
                    del open_[room], rooms[i]
                put(room - n, (*config, n), taken)
                todo -= taken
            else:
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, (n,) * each, todo // each)
                if todo % each:
                    put(capacity - todo % each * n, (n,) * (todo % each), 1)
                todo = 0
    return [(list(config), times) for held in open_.values() for config, times in held]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise every whole text, append end_id, and cut what is longer than capacity; the first piece may be shorter."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from .chunks import encoded, encoder_of

        encoder = encoder_of(spec.value)
        for batch in batches:
            for part in slices(batch, most=LARGE_SLICE * 2 // 3):
                ids, at = encoded(texts_of(part), encoder, encoder.specials)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                n = np.diff(at) + 1
                begin = np.cumsum(n) - n
                first = (n - 1) % capacity + 1
                many = 1 + (n - first) // capacity
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                a = begin[row] + start
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                yield pa.record_batch([as_array(part.column("doc_id")).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan_rows(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """The configurations as ranges of ranks: piece number r of a length lies in the row with begin <= r < end."""
    taken = np.zeros(len(counts), dtype=np.int64)
    rows, base = [], 0
    full = int(counts[capacity])
    rest = counts.copy()
    rest[capacity] = 0
    plan = [([capacity], full)] * bool(full) + configurations(rest, capacity)
    for config, times in plan:
        offset = 0
        for n, a in sorted(pd.Series(config).value_counts().items(), reverse=True):
            rows.append((int(n), int(taken[n]), int(taken[n] + a * times), base, int(a), offset))
            taken[n] += a * times
            offset += n * a
        base += times
    return pd.DataFrame(rows, columns=["length", "begin", "end", "base", "each", "at"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence and an offset in it: the columns of pieces, sequence_id long, offset long.

    pieces: a written table (it is read three times) with a column length from 1 to capacity, and any others. To the driver
    go at most ``capacity`` counts. A length that many pieces have is numbered in groups of bounded share, so no task gets
    all of it; what is broadcast has at most a few thousand rows (groups) and a few ten thousand (ranges of the plan), both
    bounded by capacity and the number of rounds, not by the rows. Repeated rows are packed once each: groups go by a row's
    place in its file, not by what is in it.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = plan_rows(counts, capacity)
    share = max(256, -(-int(counts.sum()) // 8192))
    groups = F.array(*(F.lit(max(1, -(-int(n) // share))) for n in counts))
    dealt = pieces.select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_at"))
    dealt = dealt.withColumn("_g", F.pmod(F.xxhash64("_f", "_at"), groups[F.col("length").cast("int")]).cast("int"))
    ahead = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_g").count().select("length", "_g", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_g").orderBy("_f", "_at")
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["length", "_g"])
    ranked = ranked.withColumn("_r", F.col("_r") + F.col("_ahead"))
    ranges = spark.createDataFrame(plan, "length long, begin long, end long, base long, each long, at long")
    held = ranked.alias("p").join(F.broadcast(ranges).alias("c"), F.expr("p.length = c.length and p._r >= c.begin and p._r < c.end"))
    return held.select(
        *(F.col(f"p.{c}") for c in pieces.columns),
        F.expr("c.base + (p._r - c.begin) div c.each").alias("sequence_id"),
        F.expr("c.at + (p._r - c.begin) % c.each * p.length").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into as few sequences as the plan finds, cutting only those longer than capacity.

    A null or empty text is a piece of one token (the end); repeated rows are packed once each; an empty table gives an
    empty result; only doc_id and text are read.
    """
    return pack(written(pieces_of(docs, tokenizer, end_id, capacity), "pieces"), capacity)
