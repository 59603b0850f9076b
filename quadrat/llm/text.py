"""Helpers for text inside Arrow tasks: bounded slices, word splitting and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

# Words of letters, digits and everything outside ASCII; A-Z become a-z and all else a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            before = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def blobs(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; NULL becomes empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def append_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns.keys()]
    )


_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, for ``n`` positions."""
    if not _powers or len(_powers[0]) < n:
        steps = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(max(n, 2 * _CHUNK), base, dtype=np.uint64)
            step[0] = 1
            steps.append(np.cumprod(step, dtype=np.uint64))
        _powers[:] = steps
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    return h * _MIX


def hashed_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and the index of its text, in order.

    ``table`` maps bytes; what it maps to a space separates words. The hash is a polynomial over the
    word's bytes, so all words of a slice are hashed by one running sum.
    """
    data = b" ".join(texts).translate(table) + b" "
    bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    hashes, positions = [], []
    start = 0
    while start < len(data):
        end = data.rfind(b" ", start, start + _CHUNK) + 1 or data.find(b" ", start) + 1
        a = np.frombuffer(data, np.uint8, end - start, start)
        power, inverse = _power_tables(len(a))
        word = a != 32
        edge = np.flatnonzero(np.diff(word, prepend=False))
        first, stop = edge[::2], edge[1::2]
        total = np.cumsum(a.astype(np.uint64) * power[: len(a)], dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        hashes.append(mixed((total[stop - 1] - before) * inverse[first]))
        positions.append(first + start)
        start = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(bounds, np.concatenate(positions), side="right")


def prefix_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position the hash of the bytes from ``starts`` up to it, itself not included."""
    power, inverse = _power_tables(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], total[:-1]])
    return mixed((before - before[starts]) * inverse[starts])
