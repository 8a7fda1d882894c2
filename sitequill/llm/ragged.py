"""Ragged numpy helpers shared by the per-batch operators.

All of them work on one bounded chunk of texts at a time; nothing here keeps
data between chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at once. A longer single text forms a chunk of its own.
CHUNK_CHARS = 1 << 20

_U = np.uint64
PRIME = _U((1 << 61) - 1)
_LOW30, _LOW31 = _U((1 << 30) - 1), _U((1 << 31) - 1)


def size_chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges [i, j) whose sizes sum to at most ``limit``, one item at least."""
    start, end, total = 0, 0, 0
    for size in sizes:
        if end > start and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def batch_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a record batch with their texts (null read as empty); only one
    slice's texts leave Arrow at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, j in size_chunks(sizes, limit):
        part = batch.slice(i, j - i)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, similar ones scatter."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime 2**61 - 1, for factors below it."""
    a_high, a_low = a >> _U(31), a & _LOW31
    b_high, b_low = b >> _U(31), b & _LOW31
    middle = a_low * b_high + a_high * b_low
    total = ((a_high * b_high) << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a_low * b_low
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _U(61))
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """base**i and base**-i modulo PRIME, grown as needed."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, int(PRIME)))
        self._clear()

    def _clear(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            more = min(m, n - m) if n >= 4 * CHUNK_CHARS else m
            for name, base in zip(("up", "down"), self.bases, strict=True):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, mulmod(held[:more], _U(pow(base, m, int(PRIME))))]))
        up, down = self.up[:n], self.down[:n]
        if len(self.up) > 4 * CHUNK_CHARS:  # do not keep what one long text needed
            self._clear()
        return up, down


POWERS = Powers(0x19E3779B97F4A7C1)
#: A second base, for hashes that must not fail together with the first.
OTHER_POWERS = Powers(0x0F58476D1CE4E5B9)


def prefix_sums(values: np.ndarray, powers: Powers = POWERS) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i modulo PRIME, and base**-i, for
    ``slice_hash``. The modulus is a prime: modulo 2**64 long Thue-Morse words
    of the same length would share one hash, whatever the base."""
    up, down = powers.of(len(values) + 1)
    terms = mulmod(values >> _U(3), up[:-1])
    sums = np.zeros(len(values) + 1, np.uint64)
    # Halves of 32 and 29 bits, so that sums of 2**32 terms do not overflow.
    high = _reduced(np.cumsum(terms >> _U(32), dtype=np.uint64))
    low = _reduced(np.cumsum(terms & _U(0xFFFFFFFF), dtype=np.uint64))
    sums[1:] = _reduced(mulmod(high, _U(1 << 32)) + low)
    return sums, down


def slice_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash of values[start:end], mixed."""
    inside = _reduced(sums[end] + (PRIME - sums[start]))
    return mix(mulmod(inside, down[start]) + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def disjoint_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each of the slices values[start:end], none of which may
    overlap: the sum of scattered (value, place in the slice) pairs."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    at = ragged_index(start, size)
    place = (at - np.repeat(start, size)).astype(np.uint64)
    terms = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(mix(values[at] + place * _U(0x9E3779B97F4A7C15) + _U(seed)), out=terms[1:])
    edge = np.cumsum(size)
    return mix(terms[edge] - terms[edge - size] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]], empty segments included."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
