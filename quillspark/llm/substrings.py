"""Exact repeats of word windows, found from fixed-block anchors.

Let a window be ``window`` words and a block ``block`` = (window + 1) // 2 words. Every window holds one whole block of its
document's grid of non-overlapping blocks, so two equal windows share the text of a grid block of either document.

1. Index and probe. Each batch of documents sends the hashes of its grid blocks (the index) and of its block-long windows
   at all other places (the probes) to slots by hash, each distinct hash once. A slot returns to a batch those of its
   hashes that are anchors: indexed somewhere and seen at least twice.
2. Extend. A batch takes all windows that hold an anchor and sends the distinct hashes of the whole windows to slots; a
   slot returns those seen only once. What is left is exactly the windows that start at two places or more, and
   overlapping ones join to maximal repeats.
3. Every document drops the words that its repeated windows cover.

A group of copies costs each batch one hash a place, however many copies there are, and no pair is ever formed. Texts are
not shuffled: a batch is a run of rows of an input file, and its answers lie in a table in the shared folder under its key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_array, new_path, release, split_words, texts_of, with_text, written

#: Rows of an input file in a batch, bytes of text to a slot, and bytes of answers that are read at once.
ROWS, SLOT_BYTES, GROUP_BYTES = 2048, 8 << 20, 8 << 20
_MULTIPLIER, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SENT = "slot int, batch long, kind int, data binary"
_TOLD = "bucket int, batch long, slot int, data binary"


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(self.n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_POWERS = (Powers(_MULTIPLIER), Powers(_SECOND))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x9FB21C651E98DF25) ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS[which].upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


class Batch:
    """The words of some texts with their hashes; folded, words that differ in the case of A-Z have one hash."""

    def __init__(self, texts: pa.Array, folded: bool = False) -> None:
        self.codes, self.offsets, self.words = split_words(texts)
        raw = [w.encode().lower() for w in self.words] if folded else [w.encode() for w in self.words]
        told = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), dtype=np.uint64).reshape(-1, 2)
        self.hashes = (told[self.codes, 0], told[self.codes, 1]) if len(told) else (np.zeros(0, np.uint64),) * 2
        size = np.diff(self.offsets)
        self.start = np.repeat(self.offsets[:-1], size)
        self.end = np.repeat(self.offsets[1:], size)

    def whole(self, k: int) -> np.ndarray:
        """Which places begin k words of one document."""
        n = max(0, len(self.codes) - k + 1)
        return np.arange(n) + k <= self.end[:n]


def coded(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences of as few bytes as the largest needs."""
    steps = np.diff(values, prepend=values[:1] * 0).astype("<u4")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def uncoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    steps = np.zeros((len(raw), 4), dtype=np.uint8)
    steps[:, : data[0]] = raw
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint64)


def anchors(batch: Batch, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each place that begins a block-long run (slot and 32 bits), and whether the place is on the grid."""
    ok = batch.whole(block)
    keys = rolling(batch.hashes[0], block, 0)[ok] >> np.uint64(32 - bits)
    places = np.flatnonzero(ok)
    return keys, (places - batch.start[places]) % block == 0


def by_slot(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys with one slot."""
    slots = keys >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(slots)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)] if len(keys) else []):
        yield int(slots[a]), slice(a, b)


def located(docs: DataFrame) -> DataFrame:
    """The rows with the key of their batch: a run of rows of the file that they come from."""
    key = F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {ROWS}"))
    try:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("batch"))
    except AnalysisException:  # not rows of files as they are
        docs = written(docs, "texts")
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("batch"))


def runs(batches, most: int = 4 << 20) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one batch key at a time, cut further where their texts are long."""
    from .common import slices

    for got in batches:
        keys = got.column("batch").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)] if len(keys) else []):
            for part in slices(got.slice(a, b - a), "text", most):
                yield int(keys[a]), part


class Answers:
    """Reads what slots have told a batch. A folder's files are sorted by batch, and of these only the groups of rows are read whose
    extremes have the batch between them, so that what is read doesn't grow with the folder; the last folder's files stay open."""

    def __init__(self, path: str, buckets: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(path)
        self.buckets, self.last, self.files = buckets, None, []
        self.batch, self.told = None, []

    def of(self, batch: int) -> list[tuple[int, bytes]]:
        if batch != self.batch:  # a batch comes in several parts
            self.batch, self.told = batch, self.read(batch)
        return self.told

    def read(self, batch: int) -> list[tuple[int, bytes]]:
        bucket = batch % self.buckets
        if bucket != self.last:
            for f in self.files:
                f.close(force=True)
            found = self.store.get_file_info(fs.FileSelector(f"{self.folder}/bucket={bucket}", allow_not_found=True))
            self.last, self.files = bucket, [pq.ParquetFile(self.store.open_input_file(i.path)) for i in found if i.path.endswith(".parquet")]
        out = []
        for f in self.files:
            at = f.schema_arrow.get_field_index("batch")
            for i in range(f.num_row_groups):
                told = f.metadata.row_group(i).column(at).statistics
                if told is None or not told.has_min_max or told.min <= batch <= told.max:
                    rows = f.read_row_group(i)
                    rows = rows.filter(pc.equal(rows.column("batch"), batch))
                    out += zip(rows.column("slot").to_pylist(), rows.column("data").to_pylist())
        return out


def sent_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["slot", "batch", "kind", "data"])


def send_anchors(block: int, bits: int):
    def run(batches):
        for key, part in runs(batches):
            keys, grid = anchors(Batch(texts_of(part)), block, bits)
            order = np.argsort(keys)
            keys, grid = keys[order], grid[order]
            if not len(keys):
                continue
            first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            count = np.diff(np.concatenate([first, [len(keys)]]))
            gridded = np.add.reduceat(grid.astype(np.int64), first) > 0
            kind = np.where(gridded, np.where(count > 1, 2, 1), 0)  # probe, indexed once, indexed and seen again
            keys = keys[first]
            rows = []
            for k in (0, 1, 2):
                own = keys[kind == k]
                rows += [(slot, key, k, coded(own[r] & np.uint64(0xFFFFFFFF))) for slot, r in by_slot(own)]
            yield sent_rows(rows)

    return run


def _told(buckets: int, slot: int, values: np.ndarray, owner: np.ndarray, batches: list[int], dump) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(batches) + 1))
    rows = [(b % buckets, b, slot, dump(values[cuts[i] : cuts[i + 1]])) for i, b in enumerate(batches) if cuts[i] < cuts[i + 1]]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "batch", "slot", "data"])


def find_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        batches = table.column("batch").to_pylist()
        parts = [uncoded(d) for d in table.column("data").to_pylist()]
        kinds = np.repeat(np.array(table.column("kind").to_pylist(), dtype=np.int8), [len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        values, kinds, owner = values[order], kinds[order], owner[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
        size = np.diff(np.concatenate([first, [len(values)]]))
        top = np.maximum.reduceat(kinds, first)
        live = np.repeat((top == 2) | ((top == 1) & (size > 1)), size)
        slot = table.column("slot")[0].as_py()
        return _told(buckets, slot, values[live], owner[live], batches, lambda v: coded(np.unique(v)))

    return run


def candidates(batch: Batch, told: list[tuple[int, bytes]], block: int, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that hold an anchor, and the hashes of these windows (slot apart)."""
    none = np.zeros(0, dtype=np.int64), (np.zeros(0, dtype=np.uint64),) * 2
    ok = batch.whole(window)
    if not told or not ok.any():
        return none
    known = np.sort(np.concatenate([uncoded(d) + (np.uint64(s) << np.uint64(32)) for s, d in told]))
    keys, _ = anchors(batch, block, bits)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = np.zeros(len(batch.codes) + 1, dtype=np.int64)
    hit[1 + np.flatnonzero(batch.whole(block))[known[at] == keys]] = 1
    hits = np.cumsum(hit)
    p = np.flatnonzero(ok)
    p = p[hits[p + window - block + 1] > hits[p]]
    a, b = (rolling(batch.hashes[i], window, i) for i in (0, 1))
    return p, (a[p] >> np.uint64(64 - bits) if bits else np.zeros(len(p), np.uint64), (a[p] << np.uint64(bits)) & np.uint64(0xFFFFFFFF00000000) | (b[p] >> np.uint64(32)))


def send_windows(block: int, window: int, bits: int, anchors_at: str, buckets: int):
    def run(batches):
        answers = Answers(anchors_at, buckets)
        for key, part in runs(batches):
            told = answers.of(key)
            if not told:
                continue
            _, (slots, values) = candidates(Batch(texts_of(part)), told, block, window, bits)
            if not len(values):
                continue
            order = np.lexsort((values, slots))
            slots, values = slots[order], values[order]
            first = np.concatenate([[0], np.flatnonzero((np.diff(values) != 0) | (np.diff(slots) != 0)) + 1])
            kind = np.diff(np.concatenate([first, [len(values)]])) > 1
            slots, values = slots[first], values[first]
            rows = []
            for k in (0, 1):  # seen once here, or again
                s, v = slots[kind == k], values[kind == k]
                cuts = np.flatnonzero(np.diff(s)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)] if len(s) else []):
                    rows.append((int(s[a]), key, k, dumped(v[a:b])))
            yield sent_rows(rows)

    return run


def dumped(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: the upper halves as differences, the lower ones as they are."""
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + coded(values >> np.uint64(32)) + len(values).to_bytes(4, "little")


def loaded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    return uncoded(data[4 * n : -4]) << np.uint64(32) | np.frombuffer(data, dtype="<u4", count=n).astype(np.uint64)


def find_single(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        batches = table.column("batch").to_pylist()
        parts = [loaded(d) for d in table.column("data").to_pylist()]
        again = np.repeat(np.array(table.column("kind").to_pylist(), dtype=bool), [len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        values, again, owner = values[order], again[order], owner[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
        single = (np.diff(np.concatenate([first, [len(values)]])) == 1) & ~again[first]
        return _told(buckets, table.column("slot")[0].as_py(), values[first][single], owner[first][single], batches, lambda v: dumped(np.sort(v)))

    return run


def drop_repeats(block: int, window: int, bits: int, anchors_at: str, single_at: str, buckets: int):
    def run(batches):
        found, single = Answers(anchors_at, buckets), Answers(single_at, buckets)
        for key, part in runs(map(with_text, batches)):
            batch = Batch(texts_of(part))
            p, (slots, values) = candidates(batch, found.of(key), block, window, bits)
            if len(p):
                order = np.argsort(slots, kind="stable")
                by, again = slots[order], np.ones(len(p), dtype=bool)
                for slot, data in single.of(key):
                    mine = order[slice(*np.searchsorted(by, np.array([slot, slot + 1], dtype=np.uint64)))]
                    again[mine[np.isin(values[mine], loaded(data))]] = False  # seen once: not a repeat
                p = p[again]
            cover = np.zeros(len(batch.codes) + 1, dtype=np.int64)
            np.add.at(cover, p, 1)
            np.add.at(cover, p + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = batch.codes[~gone].tolist()
            left = np.concatenate([[0], np.cumsum(~gone)])[batch.offsets]
            texts = [" ".join([batch.words[c] for c in kept[a:b]]) for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
            n_words = np.diff(batch.offsets)
            yield pa.record_batch([as_array(part.column("row")), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(left), pa.int64())], names=["row", "kept", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Drop every word that is covered by a window of words which also starts anywhere else, in the same document or another.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; windows are judged on the input. Returns the columns of
    docs as they were, and kept (the words that stay, joined by one space), n_words, n_removed; columns of docs with one of
    these names are replaced. A null or empty text has no words; repeated rows repeat each other, so that their words go if
    there are ``window`` of them; an empty table gives an empty result. docs needs a column text.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    rows = located(docs)
    size = rows.agg(F.sum(F.octet_length("row.text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, size / SLOT_BYTES))))  # slots grow with the text: none gets more, however much there is
    buckets = 1 << ((bits + 1) // 2 + 3)  # folders of answers grow with the root of that, and what lies in each is sorted
    text = rows.select(F.col("row.text").alias("text"), "batch")

    def asked(sent: DataFrame, answer, name: str) -> str:
        path = new_path(spark, name)
        told = sent.groupBy("slot").applyInArrow(answer, _TOLD)
        told = told.repartition("bucket").sortWithinPartitions("bucket", "batch")
        told.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
        return path

    at = asked(text.mapInArrow(send_anchors(block, bits), _SENT), find_anchors(buckets), "anchors")
    once = asked(text.mapInArrow(send_windows(block, window, bits, at, buckets), _SENT), find_single(buckets), "single")
    schema = T.StructType([*rows.select("row").schema, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = rows.select("row", "batch").mapInArrow(drop_repeats(block, window, bits, at, once, buckets), schema)
    own = [c for c in docs.columns if c.lower() not in ("kept", "n_words", "n_removed")]
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in own), "kept", "n_words", "n_removed")


def repeat_digests(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    done = remove_repeats(docs.select("doc_id", "text"), window)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), p as (
  select doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) as win
  from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)
), twice as (
  select doc_id, i from p where win in (select win from p group by win having count(*) > 1)
), gone as (
  select doc_id, list(distinct i + j) as places from twice, unnest(range(35)) as t(j) group by doc_id
), kept as (
  select w.doc_id, len(words) as n_words, coalesce(len(places), 0) as n_removed,
         case when places is null then words
              else list_transform(list_filter(range(1, len(words) + 1), lambda k: not list_contains(places, k)), lambda k: words[k]) end as rest
  from w left join gone on w.doc_id = gone.doc_id
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed,
       sha256(coalesce(array_to_string(rest, ' '), '')) as kept_sha256
from kept
"""
