"""Cut texts into repeated chunks that a tokenizer handles independently, so that each distinct chunk is encoded once a batch.

A space that stands before a character other than white space always begins a new pre-token in both vocabularies, so
cutting there changes no token. Texts in which a space precedes more white space are cut by a pattern instead, and
texts that hold a special token stay whole. A vocabulary whose tokens hold no white space is cut at any, into words, and of
these letters and the marks behind them are encoded apart: there are fewer of both than of words.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import coded_words, gather

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a worker: Spark's tasks are the parallelism

#: The most chunks whose ids a worker remembers from one slice to the next.
MEMO = 500_000
_CUT = re.compile(r" (?=\S)")
#: Letters, none of which changes when normalised but to lower case, and ASCII marks behind them: two pre-tokens.
PLAIN = "^(?P<body>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"
#: The steps of a vocabulary whose pre-tokens are cut at white space and hold none.
SPACE_TO_ONE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
WORDS_ONLY = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def chunked(texts: pa.Array, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the chunks of all texts, their offsets by text, and the distinct chunks; joined, they give the texts."""
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words: list[str] = coded.dictionary.to_pylist()
    odd = np.fromiter((not w or w[0].isspace() for w in words), bool, len(words))
    marked = np.fromiter((any(s in w for s in specials) for w in words), bool, len(words))
    chunks = [" " + w for w in words]
    own: dict[str, int] = {}
    n = len(texts)
    first = offsets[:-1]
    bad = odd[codes]
    bad[first] = False
    bad |= marked[codes]
    heads = codes[first]
    out = codes
    place = {}
    for code in np.unique(heads).tolist():  # the first chunk of a text has no space before it
        place[code] = own.setdefault(words[code], len(chunks) + len(own))
    out[first] = np.fromiter((place[c] for c in heads.tolist()), np.int32, n)
    rows = np.flatnonzero(np.add.reduceat(bad, first)) if n else []
    if len(rows):
        pieces, last, sizes = [], 0, np.diff(offsets)
        for i in rows.tolist():
            text = texts[i].as_py()
            cut = [text] if any(s in text for s in specials) else _CUT.split(text)
            keys = [c if not k else " " + c for k, c in enumerate(cut)]
            mine = np.fromiter((own.setdefault(k, len(chunks) + len(own)) for k in keys), np.int32, len(keys))
            pieces += [out[last : offsets[i]], mine]
            last, sizes[i] = offsets[i + 1], len(mine)
        out = np.concatenate([*pieces, out[last:]])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    return out, offsets, chunks + list(own)


def worded(texts: pa.Array, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all texts, their offsets by text, and the distinct words; a text with a special token is one word."""
    codes, offsets, words = coded_words(texts)
    marked = np.zeros(len(words), dtype=bool)
    for s in specials:
        marked |= pc.match_substring(words, s).to_numpy(zero_copy_only=False)
    if not marked.any():
        return codes, offsets, words
    before = np.concatenate([[0], np.cumsum(marked[codes])])[offsets]
    rows = np.flatnonzero(np.diff(before))
    sizes, pieces, last = np.diff(offsets), [], 0
    for k, i in enumerate(rows.tolist()):
        pieces += [codes[last : offsets[i]], np.array([len(words) + k], dtype=codes.dtype)]
        last, sizes[i] = offsets[i + 1], 1
    codes = np.concatenate([*pieces, codes[last:]])
    return codes, np.concatenate([[0], np.cumsum(sizes)]), pa.concat_arrays([words, texts.take(pa.array(rows)).cast(words.type)])


class LibraryEncoder:
    """Encodes distinct chunks with the tokenizers library, special tokens in the text included.

    A chunk that is one plain word, with at most one mark after it, goes straight to the library's model in the form that
    its normaliser and pre-tokenizer would give it; all others take the library's whole path.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        told = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        steps = (told["normalizer"] or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.spaced = not steps  # a space before a word is part of its token
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_words = self.lower and SPACE_TO_ONE in steps and cuts[:1] == [WORDS_ONLY]
        self.known: dict[str, bytes] = {}
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.marks = {c: [t.id for t in self.model.tokenize(c)] for c in ".,;:!?"}

    def plain(self, chunk: str) -> list[int] | None:
        word = chunk[1:] if chunk[:1] == " " else chunk
        tail = self.marks.get(word[-1:])
        body = word[:-1] if tail else word
        if not body.isalpha() or max(body) > "\u012f":  # beyond, letters may change when normalised
            return None
        if self.lower:
            body = body.lower()
        if self.spaced and len(word) < len(chunk):
            body = " " + body
        if self.spaced or not body.isascii():
            body = body.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(body)]
        return ids + tail if tail else ids

    def __call__(self, chunks: list[str], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has; only chunks that are used are encoded."""
        got: list[bytes] = [b""] * len(chunks)
        rest, known = [], self.known
        for i in np.flatnonzero(used).tolist():
            chunk = chunks[i]
            held = known.get(chunk)
            if held is None:
                ids = self.plain(chunk)
                if ids is None:
                    rest.append(i)
                    continue
                held = array("i", ids).tobytes()
                if len(known) < MEMO:
                    known[chunk] = held
            got[i] = held
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
                got[i] = held = array("i", e.ids).tobytes()
                if len(known) < MEMO and len(chunks[i]) < 64:
                    known[chunks[i]] = held
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), dtype=np.int32), lengths


    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has, where white space is in no token (by_words)."""
        cut = pc.extract_regex(words, PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        bodies = pc.utf8_lower(cut.field("body").filter(cut.is_valid())).dictionary_encode()
        tails = cut.field("tail").filter(cut.is_valid()).dictionary_encode()
        rest = words.filter(pc.invert(cut.is_valid())).to_numpy(zero_copy_only=False).tolist()
        known, letters, tokenize = self.known, self.letters, self.model.tokenize
        got: list[bytes] = []
        for body in bodies.dictionary.to_numpy(zero_copy_only=False).tolist():
            held = known.get(body)
            if held is None:
                told = tokenize(body if body.isascii() else body.encode().decode("latin-1").translate(letters))
                held = array("i", [t.id for t in told]).tobytes()
                if len(known) < MEMO:
                    known[body] = held
            got.append(held)
        n_bodies = len(got)
        got += [array("i", [t.id for t in tokenize(tail)]).tobytes() if tail else b"" for tail in tails.dictionary.to_pylist()]
        n_tails = len(got)
        got += [known.get(word) for word in rest]
        missed = [i for i in range(n_tails, len(got)) if got[i] is None]
        for k in range(0, len(missed), 20_000):
            part = missed[k : k + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([rest[i - n_tails] for i in part], add_special_tokens=False)):
                got[i] = held = array("i", e.ids).tobytes()
                word = rest[i - n_tails]
                if len(known) < MEMO and len(word) < 64:
                    known[word] = held
        got.append(b"")
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), dtype=np.int32)
        pieces = np.full((len(words), 2), len(got) - 1, dtype=np.int64)
        pieces[plain, 0] = bodies.indices.to_numpy(zero_copy_only=False)
        pieces[plain, 1] = tails.indices.to_numpy(zero_copy_only=False) + n_bodies
        pieces[~plain, 0] = np.arange(n_tails, len(got) - 1)
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[pieces]
        return flat[gather(starts[pieces].ravel(), sizes.ravel())], sizes.sum(axis=1)


_ENCODERS: dict[int, LibraryEncoder] = {}


def encoder_of(spec: str) -> LibraryEncoder:
    """One encoder a worker and vocabulary, with the chunks that it has met."""
    return _ENCODERS.get(hash(spec)) or _ENCODERS.setdefault(hash(spec), LibraryEncoder(spec))


def encoded(texts: pa.Array, encoder: Callable, specials: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token ids of all texts, one after another, and their offsets by text."""
    if getattr(encoder, "by_words", False):
        codes, offsets, words = worded(texts, specials)
        ids, lengths = encoder.words(words)
    else:
        codes, offsets, chunks = chunked(texts, specials)
        used = np.zeros(len(chunks), dtype=bool)
        used[codes] = True
        ids, lengths = encoder(chunks, used)
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[codes]
    return ids[gather(starts[codes], sizes)], np.concatenate([[0], np.cumsum(sizes)])[offsets]
