"""Byte-level BPE by a pair occurrence index.

All distinct chunks of a slice of a partition lie in one array of symbols. An index maps every mergeable pair, by the
rank of its merge, to all its positions; the lowest active rank is taken, merged at every position at once, and the pairs
that the merge creates to the left and right join their lists. A chunk is therefore encoded once a slice, however often
it stands in the texts, and the work on a rank is a few array operations.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import chunked
from .common import LARGE_SLICE, as_array, slices, texts_of

#: Fixed value: the pattern by which byte-level BPE splits text before it merges.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder of a byte-level vocabulary in the tokenizers library's file format."""

    def __init__(self, spec: str) -> None:
        told = json.loads(spec)
        vocab: dict[str, int] = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.specials = tuple(self.special)
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, dtype=np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.first = np.full((256, 256), -1, dtype=np.int32)
        byte_of = np.full(size, -1)
        byte_of[self.byte_id] = np.arange(256)
        for r in np.flatnonzero((byte_of[self.left] >= 0) & (byte_of[self.right] >= 0)):
            self.first[byte_of[self.left[r]], byte_of[self.right[r]]] = r
        # for each symbol the partners to its right, and to its left, in order, with the rank of the merge
        self.with_right = self._partners(self.left, self.right, size)
        self.with_left = self._partners(self.right, self.left, size)

    @staticmethod
    def _partners(key: np.ndarray, partner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((partner, key))
        return np.searchsorted(key[order], np.arange(size + 1)), partner[order], order.astype(np.int32)

    @staticmethod
    def _rank(table: tuple[np.ndarray, np.ndarray, np.ndarray], symbol: int, partners: np.ndarray) -> np.ndarray:
        at, names, ranks = table
        lo, hi = at[symbol], at[symbol + 1]
        if lo == hi:
            return np.full(len(partners), -1, dtype=np.int32)
        k = np.minimum(np.searchsorted(names[lo:hi], partners), hi - lo - 1) + lo
        return np.where(names[k] == partners, ranks[k], -1)

    def pretokens(self, chunk: str) -> list[bytes | int]:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk.encode()]
        if not any(s in chunk for s in self.specials):
            return [t.encode() for t in SPLIT.findall(chunk)]
        out: list[bytes | int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", chunk):
            out += [self.special[part]] if part in self.special else [t.encode() for t in SPLIT.findall(part)]
        return out

    def encode_chunks(self, chunks: list[str], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all used chunks, one after another, and how many each chunk has."""
        data: list[bytes | int] = []
        parts = np.zeros(len(chunks), dtype=np.int64)
        for i in np.flatnonzero(used).tolist():
            mine = self.pretokens(chunks[i])
            parts[i] = len(mine)
            data += mine
        sizes = np.fromiter((1 if isinstance(t, int) else len(t) for t in data), np.int64, len(data))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = bounds[np.cumsum(parts)]
        marks = {int(bounds[k]): t for k, t in enumerate(data) if isinstance(t, int)}
        if marks:
            data = [b"\0" if isinstance(t, int) else t for t in data]
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols = self.byte_id[raw]
        for at, i in marks.items():
            symbols[at] = i
        self.merge(symbols, raw, bounds[1:])
        live = np.concatenate([[0], np.cumsum(symbols >= 0)])
        counts = np.diff(np.concatenate([[0], live[ends]]))
        return symbols[symbols >= 0], counts

    def merge(self, symbols: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> None:
        """Merge in place; a symbol that is merged into the one before it becomes -1. ends: of pre-tokens."""
        n = len(symbols)
        if not n:
            return
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        rank = np.full(n, -1, dtype=np.int32)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[after < 0] = -1
        rank[symbols != self.byte_id[raw]] = -1
        index: dict[int, list[np.ndarray]] = {}
        self._file(index, np.flatnonzero(rank >= 0).astype(np.int32), rank[rank >= 0], heap := [])
        fresh = np.zeros(n, dtype=bool)
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            a, b, made = self.left[r], self.right[r], self.made[r]
            nxt = after[at]
            ok = (symbols[at] == a) & (nxt >= 0)
            ok &= symbols[nxt] == b  # where nxt is -1 the first test has failed
            at, nxt = at[ok], nxt[ok]
            if not len(at):
                continue
            if a == b:
                at, nxt = self._apart(at, nxt)
            symbols[at], symbols[nxt] = made, -1
            beyond = after[nxt]
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            fresh[at] = True
            p, q = at[more], beyond[more]
            found = self._rank(self.with_right, made, symbols[q])
            keep = found >= 0
            places, ranks = [p[keep]], [found[keep]]
            back = before[at]
            back = back[(back >= 0) & ~fresh[back]]
            found = self._rank(self.with_left, made, symbols[back])
            keep = found >= 0
            places.append(back[keep])
            ranks.append(found[keep])
            fresh[at] = False
            self._file(index, np.concatenate(places), np.concatenate(ranks), heap)

    @staticmethod
    def _file(index: dict[int, list[np.ndarray]], places: np.ndarray, ranks: np.ndarray, heap: list[int]) -> None:
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.concatenate([[0], cuts])].tolist()
        bounds = [0, *cuts.tolist(), len(ranks)]
        for k, r in enumerate(firsts):
            part = places[bounds[k] : bounds[k + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of overlapping pairs of one symbol, every second from the left."""
        order = np.argsort(at)
        at, nxt = at[order], nxt[order]
        runs = np.concatenate([[True], at[1:] != nxt[:-1]])
        begin = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - begin) % 2 == 0
        return at[keep], nxt[keep]

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks([text], np.ones(1, dtype=bool))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _digests(codec: PairIndexBPE, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
    codes, offsets, chunks = chunked(texts, codec.specials)
    used = np.zeros(len(chunks), dtype=bool)
    used[codes] = True
    ids, counts = codec.encode_chunks(chunks, used)
    ends = np.cumsum(counts)
    listed = ids.tolist()
    decimal = [str(i) for i in range(len(codec.bytes_of))]
    shown, plain, a = [], [], 0
    for b in ends.tolist():
        mine = listed[a:b]
        shown.append(",".join([decimal[i] for i in mine]))
        plain.append(b"".join([codec.bytes_of[i] for i in mine]))
        a = b
    totals = np.concatenate([[0], np.cumsum(counts[codes])])[offsets]
    for i in range(len(texts)):
        mine = codes[offsets[i] : offsets[i + 1]].tolist()
        said = ",".join([shown[c] for c in mine if shown[c]])
        text = b"".join([plain[c] for c in mine]).decode("utf-8", "replace")
        yield int(totals[i + 1] - totals[i]), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_CODECS: dict[int, PairIndexBPE] = {}


def codec_of(spec: str) -> PairIndexBPE:
    """One codec a worker and vocabulary."""
    return _CODECS.get(hash(spec)) or _CODECS.setdefault(hash(spec), PairIndexBPE(spec))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Every document with its token ids: columns doc_id, ids array<int>.

    vocabulary: path of the file on the driver; its content goes to the executors as a broadcast (a few MB at most).
    A null text counts as empty and gives no ids; repeated rows give a row each; other columns are ignored.
    """
    spec = _sent(docs, vocabulary)

    def run(batches):
        codec = codec_of(spec.value)
        for batch in batches:
            for part in slices(batch, most=LARGE_SLICE):
                from .chunks import encoded

                ids, at = encoded(texts_of(part), codec.encode_chunks, codec.specials)
                yield pa.record_batch([as_array(part.column("doc_id")), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded_docs: DataFrame, vocabulary: str) -> DataFrame:
    """The texts of ids: columns doc_id, text. Null ids count as none."""
    spec = _sent(encoded_docs, vocabulary)

    def run(batches):
        codec = codec_of(spec.value)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([as_array(batch.column("doc_id")), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text; return counts and digests of ids and of the decoded text (see SCHEMA).

    No shuffle: one pass over the scan. Null texts count as empty (no tokens, digests of the empty string); repeated
    rows give a row each; an empty table gives an empty result; only doc_id and text are read.
    """
    spec = _sent(docs, vocabulary)

    def run(batches):
        codec = codec_of(spec.value)
        for batch in batches:
            for part in slices(batch, most=LARGE_SLICE):
                found = list(zip(*_digests(codec, texts_of(part)))) or [(), (), ()]
                yield pa.record_batch([as_array(part.column("doc_id")), pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _sent(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
