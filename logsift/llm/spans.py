"""Words and lines of whole Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python loop per word.

A span's hash is a polynomial over its bytes with random byte values, modulo the prime 2^31 - 1 at two random points, taken
from prefix sums, then mixed. Over a prime field two spans of n bytes agree at a random point with a chance of at most n in
2^31, whatever their bytes; modulo a power of two there are texts that agree at every point. A second lane has other
points. The constants are fixed, so all workers agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
SLICE_BYTES = 2 << 20
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; null is empty."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `limit` bytes of text, so that what is made from a piece stays small. A row is never cut."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


@lru_cache(maxsize=None)
def _point(lane: int, fold: bool, point: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Byte values, powers of the point and of its inverse, and the point."""
    rng = np.random.default_rng([7919, lane, point])
    table = rng.integers(1, PRIME, 256).astype(np.uint64)
    if fold:
        table[65:91] = table[97:123]
    base = int(rng.integers(1 << 20, PRIME))
    return table, _powers(base), _powers(pow(base, -1, PRIME)), base


def _powers(base: int) -> np.ndarray:
    """The powers from 0 to SEGMENT, by doubling."""
    out, step = np.ones(1, np.uint64), base
    while len(out) <= SEGMENT:
        out, step = np.concatenate([out, out * np.uint64(step) % _P]), step * step % PRIME
    return out[:SEGMENT + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _prefix(data: np.ndarray, at: list[np.ndarray], table: np.ndarray, powers: np.ndarray, base: int) -> list[np.ndarray]:
    """The sums, modulo the prime, of value times power over all bytes before each position, for sorted arrays of positions."""
    out = [np.zeros(len(x), np.uint64) for x in at]
    total, scale, step = 0, 1, pow(base, SEGMENT, PRIME)
    for s in range(0, len(data) + 1, SEGMENT):
        piece = data[s:s + SEGMENT]
        terms = table[piece]
        terms *= powers[:len(piece)]
        high = terms >> _BITS
        terms &= _P
        terms += high  # below 2^32 each, so that a segment's sum stays below 2^50
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        for x, o in zip(at, out):
            i, j = np.searchsorted(x, [s, s + SEGMENT])
            o[i:j] = (np.uint64(total) + np.uint64(scale) * (sums[x[i:j] - s] % _P)) % _P
        total, scale = (total + scale * (int(sums[-1]) % PRIME)) % PRIME, scale * step % PRIME
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0, fold: bool = False) -> np.ndarray:
    """A hash for each span of bytes; `fold` reads A-Z as a-z. Starts and ends are sorted."""
    both = []
    for point in range(2):
        table, powers, inverse, base = _point(lane, fold, point)
        before, upto = _prefix(data, [starts, ends], table, powers, base)
        far = np.array([pow(base, -SEGMENT * i, PRIME) for i in range(len(data) // SEGMENT + 1)], np.uint64)
        back = inverse[starts % SEGMENT] * far[starts // SEGMENT] % _P
        both.append((upto + _P - before) % _P * back % _P)
    return mix((both[0] << _BITS) | both[1])


def _separators(chars: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(chars)] = False
    return table


SPACE = _separators(b"\x20\x09\x0a\x0b\x0c\x0d")


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which `inside` holds, and the first word's index of each row (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line feeds, and the first line's index of each row. A row has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    return starts, ends, np.arange(len(offsets)) + np.searchsorted(feeds, offsets)


def sequences(hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """A hash for each run of `length` consecutive hashes, by its first; shorter by `length` - 1 than the input."""
    n = max(0, len(hashes) - length + 1)
    factors = np.random.default_rng(104729 + lane).integers(0, 1 << 64, length, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out += hashes[i:i + n] * factors[i]
        return mix(out)
