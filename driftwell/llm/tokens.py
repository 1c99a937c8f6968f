"""Byte-level BPE of a whole corpus by prefix-sharing trie traversal (problem 7).

The last token of the encoding of a byte string is unique, and two neighbours of a valid encoding
are valid on their own: a sequence is the encoding exactly if the encoding of each pair of
neighbours is that pair. So the encoding of a prefix is the encoding of a shorter prefix plus one
token, and all prefixes of a word are encoded on the way. The distinct words of a batch are put
into a trie whose depth-first walk carries the last-token states: a prefix that words share is
encoded once. (In the walk the words stand in byte order; the common prefix with the word before
is the path kept on the stack.)

No shuffle: texts are encoded where they are read, by Arrow batches. The vocabulary (under 1 MB) is
broadcast; its path is a parameter. Null and empty texts give an empty list.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose encodings a Python worker keeps; beyond it they are computed again.
KEPT_WORDS = 200_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file: the folder in DRIFTWELL_TOKENIZERS, else the installed package's."""
    folder = os.environ.get("DRIFTWELL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


# Fixed value: the pattern that splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TrieBPE:
    """Encoder of words by a depth-first walk over their trie."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.suffixes = {t[k:] for t in self.rank for k in range(len(t))}
        self.split = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of a short string: the lowest rank first. Decides which pairs are valid."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def valid(self, before: int, token: int) -> bool:
        """Whether *token* may follow *before* (-1: begins a word)."""
        if before < 0:
            if (ok := self.whole.get(token)) is None:
                ok = self.whole[token] = self.merge(self.bytes[token]) == [token]
            return ok
        if (ok := self.fits.get((before, token))) is None:
            if len(self.fits) > 4 * KEPT_WORDS:
                self.fits.clear()
            ok = self.fits[before, token] = self.merge(self.bytes[before] + self.bytes[token]) == [before, token]
        return ok

    def last(self, word: bytes, end: int, states: list[int]) -> int:
        """Last token of the encoding of word[:end], given those of all shorter prefixes."""
        rank, suffixes = self.rank, self.suffixes
        found, start = [], end - 1
        while start >= 0 and (piece := word[start:end]) in suffixes:
            if (token := rank.get(piece)) is not None:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if self.valid(states[start], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def walk(self, words: list[str]) -> None:
        """Encode *words* (distinct) into ``known`` by a depth-first walk over their trie."""
        before, states = b"", [-1]  # the path from the root: states[i] is the last token of its first i bytes
        for raw, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = len(os.path.commonprefix((before, raw)))
            del states[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                states.append(self.last(raw, end, states))
            out, end = [], len(raw)
            while end:
                out.append(states[end])
                end -= len(self.bytes[states[end]])
            self.known[text] = tuple(out[::-1])
            before = raw

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = {w for ws in split for w in ws}
        self.walk(list(new))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in split]


_ENCODERS: dict[tuple[str, str], TrieBPE] = {}


def _encoder(broadcast, key: str, pattern: str) -> TrieBPE:
    """One encoder a Python worker, however many tasks it runs."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS[key, pattern] = TrieBPE(broadcast.value, pattern)
    return _ENCODERS[key, pattern]


def _bytes_of_tokens(key: str, pattern: str) -> dict[int, bytes]:
    """Of the worker's encoder (a function of the module, so that tasks see the module's table and no copy of it)."""
    return _ENCODERS[key, pattern].bytes


def _over_batches(df: DataFrame, text: str, schema: str, make, path: str | None, pattern: str) -> DataFrame:
    path = path or tokenizer_path()
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the memory of long texts
                part = batch.slice(at, 256)
                yield make(part, bpe.encode_batch(part.column(part.schema.get_field_index(text)).to_pylist()))

    return df.mapInArrow(run, schema)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """key, ids of every row; null and empty texts give an empty list. Other columns are not read."""

    def make(part: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return _over_batches(documents.select(key, text), text, f"`{key}` {kind}, ids array<int>", make, path, pattern)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """key, n_tokens of every row (0 for null and empty texts), by the same traversal."""

    def make(part: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64())], names=[key, "n_tokens"])

    kind = dict(documents.dtypes)[key]
    return _over_batches(documents.select(key, text), text, f"`{key}` {kind}, n_tokens bigint", make, path, pattern)


def spelled(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """key, has_ids, whole of every row: whether it has ids, and whether their bytes are its text again (null as empty)."""

    def make(part: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
        spell = _bytes_of_tokens(path_, pattern)
        whole = [b"".join(spell[i] for i in x) == (t or "").encode("utf-8") for x, t in zip(ids, part.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([bool(x) for x in ids]), pa.array(whole, pa.bool_())], names=[key, "has_ids", "whole"])

    path_ = path or tokenizer_path()
    kind = dict(documents.dtypes)[key]
    return _over_batches(documents.select(key, text), text, f"`{key}` {kind}, has_ids boolean, whole boolean", make, path_, pattern)
