"""Corpus encoding with a public byte-level BPE vocabulary.

A pre-token's bytes are the leaves of a segment tree that keeps, for every range, the leftmost pair of least
merge rank. The root is the next merge; a merge touches two pairs, so it costs logarithmic time, and encoding a
piece of n bytes costs O(n log n) whatever its content. Pieces repeat heavily in text, so every worker remembers
the ids of the pieces it has met, within a bound.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_PIECES = 400_000  #: pieces a worker remembers before it starts anew
MEMO_CHARS = 64  #: longer pieces are encoded each time

#: how the vocabulary's texts were cut before merging (fixed)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# the same cut for ASCII text, where the standard engine is faster
_SPACE = r" \t\n\r\x0b\x0c"
_ascii_find = re.compile(rf" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
# no piece reaches over a line end that follows a visible character, so texts may be cut there
_line_cut = re.compile(r"(?<=[!-~])(?=\n)").split

NO_RANK = 1 << 60


def vocabulary_path(path: str | None = None) -> str:
    """Place of the vocabulary: the given path, else the installed public tokenizers."""
    if path:
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path(VOCABULARY)
    except ImportError:
        return os.path.join("/opt/tokenizers", VOCABULARY)


class PairTree:
    """Segment tree over adjacent pair ranks; ``tree[1]`` is the leftmost least (rank, place) of the whole."""

    def __init__(self, ranks: list[int]):
        n = 1
        while n < len(ranks):
            n *= 2
        self.leaves = n
        # rank and place in one integer, so that the least one is the leftmost of least rank
        self.tree = [NO_RANK] * (2 * n)
        for i, r in enumerate(ranks):
            self.tree[n + i] = (r << 32) | i if r < NO_RANK else NO_RANK
        for i in range(n - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def set(self, place: int, rank: int) -> None:
        i = self.leaves + place
        self.tree[i] = (rank << 32) | place if rank < NO_RANK else NO_RANK
        i >>= 1
        while i:
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            low = a if a <= b else b
            if self.tree[i] == low:
                break
            self.tree[i] = low
            i >>= 1


class ByteBPE:
    """Encoder for a vocabulary given as ranks of byte strings; ids are the ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        n = len(data)
        if n == 1:
            return (ranks[data],)
        start = list(range(n))  # parts as start offsets; after[i] is the next part's start
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        get = ranks.get
        tree = PairTree([get(data[i:i + 2], NO_RANK) for i in range(n - 1)])
        top = tree.tree
        while top[1] < NO_RANK:
            i = top[1] & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            after[i] = k
            start[j] = -1
            if j < n - 1:
                tree.set(j, NO_RANK)
            if k < n:
                before[k] = i
                tree.set(i, get(data[i:after[k]], NO_RANK))
            else:
                tree.set(i, NO_RANK)
            h = before[i]
            if h >= 0:
                tree.set(h, get(data[h:k], NO_RANK))
        out = []
        i = 0
        while i < n:
            out.append(ranks[data[i:after[i]]])
            i = after[i]
        return tuple(out)

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else self.merge(data)
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii():
            return _ascii_find(text)
        out: list[str] = []
        for part in _line_cut(text):
            out += _ascii_find(part) if part.isascii() else self.find(part)
        return out

    def encode(self, text: str) -> list[int]:
        memo, piece = self.memo, self.piece
        return list(chain.from_iterable([memo.get(p) or piece(p) for p in self.pieces(text)]))

    def count(self, text: str) -> int:
        memo, piece = self.memo, self.piece
        return sum([len(memo.get(p) or piece(p)) for p in self.pieces(text)])


_loaded: dict[str, ByteBPE] = {}


def encoder(path: str | None = None) -> ByteBPE:
    """The worker's encoder of a vocabulary, loaded once."""
    place = vocabulary_path(path)
    if place not in _loaded:
        _loaded[place] = ByteBPE(place)
    return _loaded[place]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): each row's token ids; special tokens' strings are ordinary text.

    Null and empty texts get an empty list; equal rows are kept; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            offsets, parts = [0], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t) if t else []
                parts.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
            values = np.concatenate(parts) if parts else np.array([], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=[key, "ids"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): the length of each row's encoding; 0 for null and empty texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [enc.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of token ids (round trip for whole encodings)."""
    enc = encoder(path)
    back = {v: k for k, v in enc.ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
