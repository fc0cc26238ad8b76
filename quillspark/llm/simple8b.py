"""Simple-8b word-aligned coding of token ids, and files of it.

A 64-bit word holds a selector in its top 4 bits and as many values of equal width as fit in the other 60; a value that
needs more than 60 bits is escaped: its word has selector 0 and the value stands in a tail of raw words. Values are cut
into blocks of BLOCK, each coded on its own and found by an offset, so that blocks code and decode side by side as
columns of arrays and a reader can start at any block.

A file holds documents in ascending doc_id order:
    header   magic "S8B1", then uint32 block size, uint64 documents, ids, blocks, words, escapes
    arrays   int64 doc_id, uint8 doc_id is null, uint64 ids of the document, uint64 first word of each block,
             uint64 first escape of each block, uint64 words, uint64 escapes
Files are written by the tasks of one Spark job into the shared folder under names that no other attempt uses; the index
table that the job commits names the valid ones. A retried task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_SLICE, as_array, slices, texts_of

BLOCK = 1024
#: Values in a word and their width, of selectors 1, 2, ...
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([1, *(n for n, _ in PACKS)], dtype=np.int64)
_WIDTH = np.array([0, *(b for _, b in PACKS)], dtype=np.uint64)
_HEAD = np.dtype([("magic", "S4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8"), ("words", "<u8"), ("escapes", "<u8")])

INDEX = "part int, k int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not len(values) or values.max() < 1 << 16:
        small = np.zeros(1 << 16, dtype=np.uint8)
        for b in range(16):
            small[1 << b : 1 << (b + 1)] = b + 1
        return small[values.astype(np.uint16)]
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, escaped values, first escape of each block."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none, none
    values = np.concatenate([values.astype(np.uint64), np.zeros(blocks * block - n, dtype=np.uint64)])
    widths = np.zeros((blocks, block + 60), dtype=np.uint8)
    widths[:, :block] = bit_widths(values).reshape(blocks, block)
    # the widest value in the next 1, 2, 4, ... places; two such spans cover any other length
    spans = [widths]
    while 2 ** len(spans) <= 60:
        k = 2 ** (len(spans) - 1)
        wide = spans[-1].copy()
        np.maximum(wide[:, :-k], spans[-1][:, k:], out=wide[:, :-k])
        spans.append(wide)
    best = np.zeros((blocks, block), dtype=np.uint8)
    for s in range(len(PACKS), 0, -1):  # the selector with the most values wins: it comes last
        k, b = PACKS[s - 1]
        p = k.bit_length() - 1
        span = np.maximum(spans[p][:, :block], spans[p][:, k - 2**p : k - 2**p + block]) if k > 1 else widths[:, :block]
        best[span <= b] = s
    sizes = np.full(blocks, block, dtype=np.int64)
    sizes[-1] = n - (blocks - 1) * block
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    where, chosen, owner = [], [], []
    while len(live):
        s = best[live, at[live]]
        where.append(at[live] + live * block)
        chosen.append(s)
        owner.append(live)
        at[live] += _COUNT[s]
        live = live[at[live] < sizes[live]]
    owner_, where_, chosen_ = np.concatenate(owner), np.concatenate(where), np.concatenate(chosen)
    order = np.argsort(where_, kind="stable")
    owner_, where_, chosen_ = owner_[order], where_[order], chosen_[order]
    words = chosen_.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(60, dtype=np.uint64)])
    ends = (owner_ + 1) * block
    for s in range(1, len(PACKS) + 1):
        mine = np.flatnonzero(chosen_ == s)
        k, b = PACKS[s - 1]
        for j in range(k if len(mine) else 0):
            place = where_[mine] + j
            words[mine] |= np.where(place < ends[mine], padded[place], np.uint64(0)) << np.uint64(j * b)
    escaped = chosen_ == 0
    first = np.searchsorted(owner_, np.arange(blocks)).astype(np.uint64)
    raised = np.searchsorted(owner_[escaped], np.arange(blocks)).astype(np.uint64)
    return words, first, values[where_[escaped]], raised


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values of consecutive blocks that begin with the first word."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[chosen]
    total = np.cumsum(counts) - counts
    starts = (first - first[0]).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(words)]])))
    where = total - total[starts][owner] + owner * block
    ends = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, dtype=np.uint64)
    for s in range(1, len(PACKS) + 1):
        mine = np.flatnonzero(chosen == s)
        k, b = PACKS[s - 1]
        mask = np.uint64((1 << b) - 1)
        for j in range(k if len(mine) else 0):
            place = where[mine] + j
            ok = place < ends[mine]
            out[place[ok]] = ((words[mine] >> np.uint64(j * b)) & mask)[ok]
    out[where[chosen == 0]] = escapes
    return out


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first, escapes, raised = pack(ids)
    head = np.zeros(1, dtype=_HEAD)
    head[0] = (b"S8B1", BLOCK, len(doc_ids), len(ids), len(first), len(words), len(escapes))
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    absent = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join(x.tobytes() for x in (head, named, absent, counts.astype("<u8"), first, raised, words, escapes))


class TokenFile:
    """A file of packed ids: documents, and any range of ids."""

    def __init__(self, data: bytes) -> None:
        head = np.frombuffer(data, dtype=_HEAD, count=1)[0]
        if head["magic"] != b"S8B1":
            raise ValueError("not a Simple-8b token file")
        self.block, self.n_ids, self.at, self.data = int(head["block"]), int(head["ids"]), _HEAD.itemsize, data
        docs, blocks = int(head["docs"]), int(head["blocks"])
        named, absent = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if a else d for d, a in zip(named.tolist(), absent.tolist())]
        self.counts = self._take("<u8", docs).astype(np.int64)
        self.first, self.raised = self._take("<u8", blocks), self._take("<u8", blocks)
        self.words, self.escapes = self._take("<u8", int(head["words"])), self._take("<u8", int(head["escapes"]))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype=kind, count=n, offset=self.at)
        self.at += out.nbytes
        return out

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start on, of which only the blocks that hold them are decoded."""
        if not n:
            return np.zeros(0, dtype=np.uint64)
        a, b = start // self.block, (start + n - 1) // self.block + 1
        last = b == len(self.first)
        words = self.words[int(self.first[a]) : None if last else int(self.first[b])]
        escapes = self.escapes[int(self.raised[a]) : None if last else int(self.raised[b])]
        held = min(b * self.block, self.n_ids) - a * self.block
        return unpack(words, self.first[a:b], escapes, held, self.block)[start - a * self.block :][:n]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 1, ids_per_file: int = 1 << 23) -> DataFrame:
    """Encode all documents and write their ids, each followed by end_id, in ascending doc_id order; return the index.

    docs: doc_id, text; other columns are ignored. A null text counts as empty, a null doc_id comes first; rows with one
    doc_id are ordered by text, and repeated rows are written once each. An empty table gives an empty index and no file.
    path: a folder that the driver and all executors reach (a URI that pyarrow's file systems open). tokenizer: path of a
    file of the tokenizers library on the driver. One range exchange by doc_id; a document is never held with more than
    the rest of its file.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        from .chunks import encoded, encoder_of

        encoder = encoder_of(spec.value)
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal k, held
            names = [d for x in held for d in x[0]]
            counts, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            name = f"{folder}/part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(name) as out:
                out.write(file_bytes(names, counts, ids))
            row = pa.record_batch([[part], [k], [name], [len(names)], [len(ids)]], schema=pa.schema([("part", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            k, held = k + 1, []
            return row

        total = 0
        for batch in batches:
            for piece in slices(batch, most=LARGE_SLICE):
                ids, at = encoded(texts_of(piece), encoder, encoder.specials)
                counts = np.diff(at)
                if end_id is not None:
                    ids, counts = np.insert(ids, at[1:], end_id), counts + 1
                held.append((as_array(piece.column("doc_id")).to_pylist(), counts, ids.astype(np.uint32)))
                total += len(ids)
                if total >= ids_per_file:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = f"{path.rstrip('/')}/index.parquet"
    rows.mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_token_files(index: DataFrame, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (see ROWS).

    The index has one row a file, so the running sum over it is small. Files decode block by block.
    """
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    files = index.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(name) as f:
                    told = TokenFile(f.read())
                ends = np.cumsum(told.counts)
                starts = ends - told.counts
                crcs = np.zeros(len(ends), dtype=np.int64)
                i = 0
                while i < len(ends):  # about a million ids at a time
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20))))
                    ids = told.ids(int(starts[i]), int(ends[j - 1] - starts[i])).astype("<u4")
                    for d in range(i, j):
                        crcs[d] = zlib.crc32(ids[starts[d] - starts[i] : ends[d] - starts[i]])
                    i = j
                yield pa.record_batch([pa.array(told.doc_ids, pa.int64()), pa.array(starts + base), pa.array(told.counts), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, index.count()), "path").mapInArrow(run, ROWS)


def decode_token_files(index: DataFrame, path: str) -> DataFrame:
    """Per document of the files: doc_id, ids array<long>."""

    def run(batches):
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with store.open_input_file(name) as f:
                    told = TokenFile(f.read())
                starts = np.cumsum(told.counts) - told.counts
                for i in range(0, len(starts), 256):
                    n = told.counts[i : i + 256]
                    ids = told.ids(int(starts[i]), int(n.sum())).astype(np.int64)
                    at = np.concatenate([[0], np.cumsum(n)])
                    yield pa.record_batch([pa.array(told.doc_ids[i : i + 256], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return index.select("path").repartition(max(1, index.count()), "path").mapInArrow(run, "doc_id long, ids array<long>")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, path), path)
