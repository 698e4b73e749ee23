"""Vectorised words and word hashes over Arrow string batches.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Every UTF-8 continuation byte is above
that range, so byte-level boundaries are exact. A word's hash is a polynomial over random byte
values modulo 2**64, taken for all words of a piece from one prefix sum, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        tables = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            tables.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


@dataclass
class Words:
    """All words of a batch: hashes, byte spans, and for each row its range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _cut(data: np.ndarray, at: int, end: int, offsets: np.ndarray) -> int:
    """The first place from ``at`` on where no word is cut."""
    edge = int(offsets[np.searchsorted(offsets, at)]) if at < end else end
    while at < edge:
        part = SPACE[data[at : min(edge, at + 4096)]]
        if part.any():
            return at + int(part.argmax())
        at = min(edge, at + 4096)
    return min(at, end)


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Words of every row; ``fold`` lower-cases A-Z in the hashes."""
    values = _FOLDED if fold else _VALUES
    pos, end = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    while pos < end:
        stop = _cut(data, min(pos + PIECE, end), end, offsets)
        piece = data[pos:stop]
        solid = ~SPACE[piece]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > pos) & (offsets < stop)] - pos
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(a):
            power, inverse = _power_tables(len(piece))
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[piece] * power[: len(piece)], out=sums[1:])
            hashes.append(mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)))
            starts.append(a + pos)
            ends.append(b + pos)
        pos = stop
    none = np.empty(0, np.int64)
    starts = np.concatenate(starts) if starts else none
    return Words(
        np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
        starts,
        np.concatenate(ends) if ends else none,
        np.searchsorted(starts, offsets),
    )


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words inside one row, and each run's first word."""
    n = len(words.hashes)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = words.hashes[: n - width + 1].copy()
    for k in range(1, width):
        h *= STEP
        h += words.hashes[k : n - width + 1 + k]
    limit = np.repeat(words.bounds[1:], words.counts)[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= limit)
    return mix(h[at]), at


def as_signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return h.view(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20):
    """Split a batch into runs of rows of about ``limit`` text bytes at most."""
    index = batch.schema.get_field_index(column)
    _, offsets = text_bytes(batch.column(index))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), batch.num_rows)
        yield batch.slice(row, stop - row)
        row = stop
