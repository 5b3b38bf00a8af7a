"""Byte-level BPE encoding and decoding with a two-tier lookup.

Text is split by the vocabulary's pattern. A pre-token that is itself in the
vocabulary is resolved by a minimal perfect hash over all entries: one seed
per small group of keys sends every entry to a slot of its own, and the entry
stored there is compared. A miss is merged: a heap holds the ranks of
adjacent pairs over a doubly linked list of its bytes, and the lowest rank is
merged first (leftmost on ties), as the rank file prescribes. Resolved
pre-tokens are cached (bounded).

The vocabulary (50k entries) is read on the driver from ``ranks_path`` and
sent with the task: its size does not depend on the data.

Cases: a null or empty text has no tokens and decodes to empty bytes; texts of
any length are encoded whole; strings that look like special tokens are
ordinary text; repeated rows each get their result; other columns pass
through, clashing ``token_ids`` / ``decoded`` columns are replaced; ids
outside the vocabulary or null ids raise ValueError on decoding (a null list
decodes to empty bytes).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilens.llm.common import prepare, to_bytes

_KEEP = 450_000  # cached pre-tokens in each of two generations
_PLACES = list(range(514))
_NONE = 1 << 31  # an id that no pair has
_ROWS = 256  # rows per output batch


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, by id. Ids must be 0..n-1."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    entries = [b""] * len(pairs)
    for token, rank in pairs:
        entries[int(rank)] = base64.b64decode(token)
    return entries


class PerfectHash:
    """Minimal perfect hash over byte strings (hash and displace)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.groups = n // 4 + 1
        groups: list[list[int]] = [[] for _ in range(self.groups)]
        first = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(first):
            groups[h % self.groups].append(i)
        self.seed = np.zeros(self.groups, np.uint32)
        self.slot = np.full(n, -1, np.int32)
        for g in sorted(range(self.groups), key=lambda g: -len(groups[g])):
            members = groups[g]
            if not members:
                continue
            seed = 0
            while True:
                seed += 1
                at = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in members]
                if len(set(at)) == len(at) and all(self.slot[a] < 0 for a in at):
                    break
            self.seed[g] = seed
            for i, a in zip(members, at):
                self.slot[a] = i

    def candidate(self, key: bytes) -> int:
        """The only entry that ``key`` can be (compare it), or -1."""
        seed = int(self.seed[xxhash.xxh3_64_intdigest(key) % self.groups])
        return int(self.slot[xxhash.xxh3_64_intdigest(key, seed) % self.n])


class Vocabulary:
    """Entries, their perfect hash, the ids of single bytes and, for every
    split of an entry into two entries, the id of the whole."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.hash = PerfectHash(entries)
        self.bytes = [self.rank(bytes([b])) for b in range(256)]
        if -1 in self.bytes:
            raise ValueError("a byte is not in the vocabulary")
        self.pairs: dict[int, int] = {}
        for whole, entry in enumerate(entries):
            for k in range(1, len(entry)):
                left = self.rank(entry[:k])
                right = self.rank(entry[k:]) if left >= 0 else -1
                if right >= 0:
                    self.pairs[left << 32 | right] = whole
        self.two_bytes = [[self.rank(bytes([a, b])) for b in range(256)] for a in range(256)]
        self.encoders: dict[str, Encoder] = {}

    def encoder(self, pattern: str) -> Encoder:
        """One per pattern: tasks that run in the same Python worker share
        what it has cached."""
        if pattern not in self.encoders:
            self.encoders[pattern] = Encoder(self, pattern)
        return self.encoders[pattern]

    def rank(self, piece: bytes) -> int:
        i = self.hash.candidate(piece)
        return i if i >= 0 and self.entries[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry. A part starts at byte i, has
        the id ids[i] and is followed by the part at after[i]; pair[i] is the
        id of both together (-1: no entry). The heap holds id << 32 | i."""
        two, get, pop, push = self.two_bytes, self.pairs.get, heapq.heappop, heapq.heappush
        n = len(piece)
        pair = [two[x][y] for x, y in zip(piece, piece[1:])]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        # two spare places: no part follows the last one, none precedes the first
        ids = [*map(self.bytes.__getitem__, piece), _NONE, _NONE]
        pair += (-1, -1, -1)
        after = _PLACES[1 : n + 2] if n < 512 else list(range(1, n + 2))
        before = [n + 1, *_PLACES[:n]] if n < 512 else [n + 1, *range(n)]
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFF
            r = x >> 32
            if pair[i] != r:
                continue  # one of the two parts has been merged since
            j = after[i]
            k = after[i] = after[j]
            h = before[i]
            ids[i] = r
            ids[j] = pair[j] = -1
            before[k] = i
            pair[i] = x = get(r << 32 | ids[k], -1)
            if x >= 0:
                push(heap, x << 32 | i)
            pair[h] = x = get(ids[h] << 32 | r, -1)
            if x >= 0:
                push(heap, x << 32 | h)
        return [x for x in ids[:n] if x >= 0]


class Encoder(dict):
    """Pre-token -> its ids as 32-bit integers in bytes, cached. When the
    cache is full it becomes the older generation, from which entries still in
    use are taken over."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            piece = to_bytes(token)
            r = self.vocabulary.rank(piece)
            ids = array("i", (r,) if r >= 0 else self.vocabulary.merge(piece)).tobytes()
        if len(token) < 64:
            if len(self) >= _KEEP:
                self.older = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text or ""))), np.int32)


def _fields(df: DataFrame, drop: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name.lower() != drop]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids array<int>``."""
    prepare(df.sparkSession)
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    fields = _fields(df, "token_ids")
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.value.encoder(pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                ids = [encoder.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], lists], names=[*names, "token_ids"])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of its ids."""
    prepare(df.sparkSession)
    entries = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = _fields(df, "decoded")
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, none = entries.value, pa.array([], pa.int32())
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                out = []
                for x in b.column(b.schema.get_field_index(ids)):
                    own = x.values if x.is_valid else none
                    numbers = own.to_numpy(zero_copy_only=False)
                    if own.null_count or len(own) and not (numbers.min() >= 0 and numbers.max() < len(table)):
                        raise ValueError("an id is outside the vocabulary")
                    out.append(b"".join(map(table.__getitem__, numbers.tolist())))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in names], pa.array(out, pa.binary())], names=[*names, "decoded"]
                )

    return df.mapInArrow(run, schema)
