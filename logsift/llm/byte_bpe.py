"""Byte-level BPE encoding and decoding by a rank file.

A text is cut into pre-tokens by the pattern that belongs to the ranks; each is encoded on its own. Two tiers resolve a
pre-token: a minimal perfect hash over the vocabulary finds those that are tokens as a whole; the others are merged, lowest
rank first and leftmost first, by a heap over the linked list of their bytes. What a worker has resolved it remembers, up to
a bound; forgetting changes the time only.

Null and empty texts have no ids and decode to empty bytes. A text of any length is encoded whole, in time n log n. Repeated
rows give repeated rows. Rows keep their other columns; `ids` and `decoded` replace columns of these names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logsift.llm.spans import slices

REMEMBERED = 1 << 18
#: Fixed value: the pattern for which a text may be cut before single white space. Others are matched over the whole text.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that the pattern leaves alone after letters; a fast path only.
PLAIN_MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank: lines of a base64 token and its rank. Ranks are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


class PerfectHash:
    """Hash and displace: a hash picks a bucket, and with the bucket's seed a slot that no other key has.

    There are as many slots as keys. Buckets are placed largest first; a bucket of one key takes any free slot, written as a
    negative number. Each slot has its key, so that a string that is no key is told apart.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.slots: list[bytes | None] = [None] * n
        self.values = [-1] * n
        self.seeds = [0] * max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(key) for key in keys]
        buckets: list[list[int]] = [[] for _ in self.seeds]
        for i, h in enumerate(hashes):
            buckets[h % len(buckets)].append(i)
        free = n
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) > 1:
                seed = 1
                while True:
                    places = [(hashes[i] * (2 * seed + 1) >> 20) % n for i in own]
                    if len(set(places)) == len(own) and all(self.slots[p] is None for p in places):
                        break
                    seed += 1
            elif own:
                free -= 1
                while self.slots[free] is not None:
                    free -= 1
                places, seed = [free], -free - 1
            else:
                continue
            self.seeds[b] = seed
            for i, p in zip(own, places):
                self.slots[p], self.values[p] = keys[i], i

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.slots:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % len(self.seeds)]
        place = -seed - 1 if seed < 0 else (h * (2 * seed + 1) >> 20) % len(self.slots)
        return self.values[place] if self.slots[place] == key else -1


class Bpe:
    """Encoder and decoder; small enough to be broadcast."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.whole = PerfectHash(tokens)
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "whole": self.whole, "_ready": False}

    def _prepare(self) -> None:
        ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        # The rank of what two tokens make together, by both ids.
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.split = regex.compile(self.pattern).findall
        self.runs = regex.compile(r"\s\s").search if self.pattern == CUTTABLE else lambda text: True
        self.pieces = Memory(self.piece)
        self.plain = Words(self.chunk, {mark: self.piece(mark) for mark in PLAIN_MARKS})
        self.spaced = Words(lambda chunk: self.chunk(" " + chunk), self.plain.marks)
        self._ready = True

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token, as packed 32-bit numbers."""
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.whole.find(raw)
        return array("i", [rank] if rank >= 0 else self.merge(raw)).tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost first, until none has a rank.

        A part is known by its first byte's place; `after` and `before` link the parts. A heap entry is a rank and a place in
        one number. It is out of date if the part at that place and the next one don't make that rank any more.
        """
        n, pair = len(raw), self.pairs.get
        ids = list(map(self.byte_ids.__getitem__, raw))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 40 | i for i in range(n - 1) if (rank := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            gone = after[i]
            if ids[i] < 0 or gone >= n or pair(ids[i] << 32 | ids[gone]) != rank:
                continue
            ids[i], ids[gone] = rank, -1
            after[i] = end = after[gone]
            if end < n:
                before[end] = i
                if (other := pair(rank << 32 | ids[end])) is not None:
                    heappush(heap, other << 40 | i)
            left = before[i]
            if left >= 0 and (other := pair(ids[left] << 32 | rank)) is not None:
                heappush(heap, other << 40 | left)
        return [x for x in ids if x >= 0]

    def chunk(self, text: str) -> bytes:
        """The ids of a text that may be encoded apart."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return self.piece(text)  # letters only: one pre-token
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as packed 32-bit numbers.

        No pre-token of CUTTABLE goes on from other characters into white space. Where all white space is single, the text can
        thus be cut before each, and a line feed is a pre-token of its own.
        """
        if not text:
            return b""
        if not self._ready:
            self._prepare()
        if self.runs(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append((self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)))
        return self.pieces["\n"].join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Memory(dict):
    """Answers already worked out. When there are too many, those not asked for since the last time go."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
            if len(key) > 64:
                return value
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Memory):
    """Pieces between white space. A word with a mark behind it is looked up without the mark, which is a pre-token of its own."""

    def __init__(self, work, marks: dict[str, bytes]):
        super().__init__(work)
        self.marks = marks

    def __missing__(self, key):
        if key[-1:] in PLAIN_MARKS and key[:-1].isalpha():
            return self[key[:-1]] + self.marks[key[-1]]
        return super().__missing__(key)


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], [*names, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """Add `ids`, an array of token ids."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield encoded(batch, shared.value, text)

    return df.mapInArrow(run, _with(df, "ids", T.ArrayType(T.IntegerType())))


def encoded(batch: pa.RecordBatch, bpe: Bpe, text: str) -> pa.RecordBatch:
    packed = list(map(bpe.encode, batch.column(text).to_pylist()))
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
    return _put(batch, "ids", pa.ListArray.from_arrays(pa.array(offsets), ids))


def decoded(batch: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
    column = batch.column("ids")
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().tolist()
    return _put(batch, "decoded", pa.array([bpe.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()))


def decode(df: DataFrame, bpe: Bpe) -> DataFrame:
    """Add `decoded`, the bytes that `ids` stand for. Null ids decode to empty bytes."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decoded(batch, shared.value)

    return df.mapInArrow(run, _with(df, "decoded", T.BinaryType()))


def round_trip(df: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """Add `ids` and, decoded from them, `decoded`, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)
    schema = _with(df, "ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([f for f in schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield decoded(encoded(batch, shared.value, text), shared.value)

    return df.mapInArrow(run, schema)
