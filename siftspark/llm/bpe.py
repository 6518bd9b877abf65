"""Byte-level byte-pair encoding with the ranks of a public tokenizer."""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; a parameter everywhere.
FOLDER = "/opt/tokenizers"
#: The split of texts into words that byte_bpe_50k was made with (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128  #: bytes up to which a word's ranks are scanned; beyond, a heap finds the minimum
_KEPT = 400_000  #: encoded words a worker keeps
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: boundaries and the ranks of adjacent parts lie in two arrays; the least rank's boundary goes, its neighbours are ranked anew."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    bounds = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del bounds[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            rank[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same result in n log n: a heap of (rank, start) over linked parts; stale entries are skipped."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i):
        j = end[i]
        return ranks.get(word[i : end[j]], _NONE) if j < n else _NONE

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], _NONE)) != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i, upto = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != upto:
            continue
        j = end[i]
        alive[j] = False
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)) != _NONE:
                heapq.heappush(heap, (p, k, end[end[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; keeps the ids of short words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, whole, without special tokens; strings that look like such are ordinary. None or empty: no ids."""
        out: list[int] = []
        if text:
            known = self.known
            for word in self.split(text):
                ids = known.get(word)
                out += self._new(word) if ids is None else ids
        return out

    def _new(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        if len(raw) > SHORT:
            return merge_long(raw, self.ranks)
        ids = merge_short(raw, self.ranks)
        if len(self.known) >= _KEPT:
            self.known.clear()
        self.known[word] = ids
        return ids


def encoded(docs: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row, nulls in ``key`` included; an empty or null text gives an empty list. One narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def apply(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            # few texts at a time, so that one Arrow batch of very long texts stays small
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = pa.array(np.fromiter((v for x in ids for v in x), np.int32, int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["key", "ids"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(apply, f"key {kind}, ids array<int>")
    return rows.withColumnRenamed("key", key)
