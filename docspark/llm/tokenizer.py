"""Encoding with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash finds whole pre-tokens that are in the vocabulary; for the others, a heap merges linked
bytes in order of rank. Text between single spaces is looked up as a whole, as a pre-token never reaches over one: each
distinct word is split, hashed or merged once and then counted or copied.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed: the published pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered in a worker, beyond which the memory is emptied and fills again, and the longest word remembered.
REMEMBERED, LONGEST = 300_000, 80


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys, n slots (hash and displace).

    Keys fall into buckets of two on average; from the largest bucket on, each gets the first displacement that moves its
    keys to free slots. A bucket of one key takes any free slot. `get` compares the key found, so other strings give None.
    """

    def __init__(self, keys: list[bytes], shift: list[int] | None = None):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        self.keys: list[bytes | None] = [None] * n
        self.shift = shift or [0] * self.buckets
        if shift:  # built before, for the same keys
            for k in keys:
                d = shift[self._bucket(k)]
                self.keys[-1 - d if d < 0 else self._slot(k, d)] = k
            return
        groups: dict[int, list[bytes]] = {}
        for k in keys:
            groups.setdefault(self._bucket(k), []).append(k)
        order, free = sorted(groups, key=lambda b: (-len(groups[b]), b)), 0
        for b in order:
            own, d = groups[b], 1
            if len(own) == 1:
                while self.keys[free] is not None:
                    free += 1
                self.shift[b], self.keys[free] = -1 - free, own[0]
                continue
            while len(slots := {self._slot(k, d) for k in own}) < len(own) or any(self.keys[s] is not None for s in slots):
                d += 1
            self.shift[b] = d
            for k in own:
                self.keys[self._slot(k, d)] = k

    def _bucket(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key) % self.buckets

    def _slot(self, key: bytes, d: int) -> int:
        return xxhash.xxh3_64_intdigest(key, d) % self.n

    def get(self, key: bytes) -> int | None:
        """The slot of a key, None for other strings."""
        if not self.n:
            return None
        d = self.shift[self._bucket(key)]
        slot = -1 - d if d < 0 else self._slot(key, d)
        return slot if self.keys[slot] == key else None


class _Memory(dict):
    """Results by key; what is missing is computed."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """Encoder of one vocabulary: `encode(text)` and `count(text)`. Text that spells a special token is ordinary text."""

    def __init__(self, path: str, shift: list[int] | None = None):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.hash = PerfectHash(list(ranks), shift)
        self.ids = [ranks[k] for k in self.hash.keys]
        self.pattern = regex.compile(PATTERN)
        self.irregular = re.compile(r" \s|\s ").search
        self.lines = re.compile(r"(?<=\S)\n(?=\S)").split
        self.pretokens = _Memory(self._pretoken)
        self.words = _Memory(lambda w: self._split(f" {w}"))

    def _id(self, token: bytes) -> int | None:
        slot = self.hash.get(token)
        return None if slot is None else self.ids[slot]

    def _pretoken(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self._id(data)
        return (whole,) if whole is not None else tuple(self.merge(data))

    def merge(self, data: bytes) -> list[int]:
        """Merges adjacent parts by lowest rank, leftmost first; a heap holds the pairs, a linked list the parts."""
        n = len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part starts at its index; end 0: it was merged away
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := self._id(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != stop:
                continue  # one of the parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self._id(data[i : end[i]]))
            i = end[i]
        return out

    def _split(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, self.pattern.findall(text))))

    def _runs(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids in runs. A line end between two visible characters is a pre-token of its own, so lines stand alone."""
        if not self.irregular(text):
            first, *rest = text.split(" ")
            return chain((self._split(first),), map(self.words.__getitem__, rest))
        if len(lines := self.lines(text)) == 1:
            return iter((self._split(text),))
        end = self._split("\n")
        parts = (chain((end,), self._runs(x)) for x in lines[1:])
        return chain(self._runs(lines[0]), chain.from_iterable(parts))

    def encode(self, text: str | None) -> list[int]:
        """Token ids; none for null and empty text."""
        return list(chain.from_iterable(self._runs(text))) if text else []

    def count(self, text: str | None) -> int:
        """len(encode(text)) without the ids."""
        return sum(map(len, self._runs(text))) if text else 0


_LOADED: dict[str, ByteBPE] = {}


def load(path: str, shift: list[int] | None = None) -> ByteBPE:
    """The encoder of a vocabulary file, once in each worker. The driver builds the hash and sends its displacements."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path, shift)
    return _LOADED[path]


def encode(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(key long, ids array<int>): one row for each row of `df`, repeated keys included; a null text has no ids.

    Row-local, nothing is shuffled. The vocabulary's file must be at `path` on every worker. Other columns are ignored.
    """

    shift = load(path).hash.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, shift)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [bpe.encode(x) for x in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(x) for x in rows], out=offsets[1:])
                values = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(key long, n_tokens long), as `encode` but with the number of ids only."""

    shift = load(path).hash.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, shift)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.count(x) for x in part.column(1).to_pylist()], pa.int64())], ["key", "n"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, n long").withColumnsRenamed({"key": key, "n": "n_tokens"})
